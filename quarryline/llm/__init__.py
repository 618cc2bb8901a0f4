"""Operators that prepare text for training language models.

The subpackage stands alone: it imports nothing of the rest of the library and
nothing of the rest imports it.
"""
