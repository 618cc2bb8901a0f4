"""Byte-level BPE over the rank file of a public tokenizer.

A text is split by the tokenizer's pattern; a part that isn't in the vocabulary
as a whole is merged by a priority queue of merge ranks over a doubly linked
list of symbols. Entries of the queue that an earlier merge made stale are
skipped when they come up, so a part of n bytes costs O(n log n) however long
it is. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import regex

#: Fixed value: the pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts whose ids a worker remembers; the memory is dropped and begun anew beyond that.
REMEMBERED_PARTS = 300_000
#: Longer parts aren't remembered.
REMEMBERED_CHARS = 64


def merge(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one part."""
    whole = ranks.get(part)
    if whole is not None:
        return [whole]
    n = len(part)
    end = list(range(1, n + 1))  # a symbol is named by its first byte and reaches to end[first]
    before = list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(part[i : i + 2])) is not None]
    heapify(queue)
    while queue:
        _, left, stop = heappop(queue)
        if not alive[left]:
            continue
        right = end[left]
        if right >= n or end[right] != stop:  # one of the two has grown since
            continue
        end[left] = stop
        alive[right] = 0
        if stop < n:
            before[stop] = left
            if (r := ranks.get(part[left : end[stop]])) is not None:
                heappush(queue, (r, left, end[stop]))
        if (prior := before[left]) >= 0 and (r := ranks.get(part[prior:stop])) is not None:
            heappush(queue, (r, prior, stop))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[part[at : end[at]]])
        at = end[at]
    return ids


class _Parts(dict):
    """Ids by part, filled as parts are met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = tuple(merge(part.encode("utf-8"), self.ranks))
        if len(part) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED_PARTS:
                self.clear()
            self[part] = ids
        return ids


class Tokenizer:
    """Of a rank file or its bytes: base64 of a string's bytes and its rank on each line."""

    def __init__(self, source: str | bytes):
        raw = rank_file(source) if isinstance(source, str) else source
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.strings = {i: s for s, i in self.ranks.items()}
        self.hash = hashlib.sha256(raw).hexdigest()[:16]
        self.parts = _Parts(self.ranks)
        self._exact = regex.compile(PATTERN).findall
        # The standard library's matcher is twice as fast and agrees where a text has no number other than
        # decimal digits, none of the four separators that it alone takes for white space, and nothing
        # beyond the basic plane, where looking for such characters would be slow.
        self._fast = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        odd = "".join(re.escape(c) for c in map(chr, range(0x10000)) if (c.isalnum() and not (c.isalpha() or c.isdecimal())) or "\x1c" <= c <= "\x1f" or unicodedata.category(c) == "Cn")
        self._odd = re.compile(f"[{odd}]").search
        self._beyond = re.compile("[\U00010000-\U0010ffff]").search

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self._fast(text) if not self._odd(text) else self._exact(text)
        return self._exact(text) if self._beyond(text) or self._odd(text) else self._fast(text)

    def ids(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null text."""
        return list(chain.from_iterable(map(self.parts.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.parts.__getitem__, self.split(text)))) if text else 0

    def flat_ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and their number by text."""
        rows = [self.ids(t) for t in texts]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.int32, int(lengths.sum())), lengths

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """Of a process that has the file; read once."""
    return Tokenizer(path)


#: Bytes up to which a rank file is sent to the tasks.
LARGEST_FILE = 64 << 20


def rank_file(path: str) -> bytes:
    """The file's bytes, for the driver to send along, so that only its machine needs the file."""
    with open(path, "rb") as f:
        raw = f.read(LARGEST_FILE + 1)
    if len(raw) > LARGEST_FILE:
        raise ValueError(f"{path} has more than {LARGEST_FILE} bytes")
    return raw


@lru_cache(maxsize=4)
def _of(digest: str) -> list:
    return []


def received(raw: bytes) -> Tokenizer:
    """The tokenizer of bytes that were sent; a worker builds it once, and keeps what it has learnt."""
    held = _of(hashlib.sha256(raw).hexdigest())
    if not held:
        held.append(Tokenizer(raw))
    return held[0]
