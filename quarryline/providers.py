"""What may be plugged in, and the forms that need neither network nor model."""

from __future__ import annotations

import re
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_word = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


class LLM(Protocol):
    """Answers prompts, as many texts as prompts; as_json asks for one JSON object each. Created on the driver, it is sent to the tasks."""

    def complete(self, prompts: list[str], as_json: bool = True) -> list[str | None]: ...


class EchoLLM:
    """A model that needs no network: it answers with what a function makes of the prompt, for tests and dry runs."""

    def __init__(self, answer):
        self.answer = answer

    def complete(self, prompts: list[str], as_json: bool = True) -> list[str | None]:
        return [self.answer(p) for p in prompts]


class HashingEmbedder:
    """Signed hashing of words and word pairs, of unit length; the same text always gives the same vector."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            w = _word.findall((t or "").lower())
            for x in [*w, *map(" ".join, zip(w, w[1:]))]:
                h = xxhash.xxh3_64_intdigest(x)
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def row_mean(vectors: np.ndarray) -> np.ndarray:
    """Vectors of texts: of a batch of vectors by token (texts x tokens x dimensions) their mean, one by text as it is."""
    return vectors.mean(axis=1) if vectors.ndim == 3 else vectors


EMBEDDERS = {"hash": HashingEmbedder}


def get_embedder(name: str, **options) -> Embedder:
    """By name; an unknown name is an error."""
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; there are {sorted(EMBEDDERS)}")
    return EMBEDDERS[name](**options)


def embed(c: Column, embedder: Embedder | None = None) -> Column:
    """Vectors of a text column, a batch at a time; a null text has a zero vector."""
    e = embedder or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def vectors(s: pd.Series) -> pd.Series:
        return pd.Series(list(row_mean(np.asarray(e.encode(s.fillna("").tolist())))))

    return vectors(c)
