"""Problem 7: the whole corpus as token ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import rank_file, received
from .common import list_array, map_batches

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encode(df: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K, ids: str = "ids") -> DataFrame:
    """One row (key, ids) for each row of df: the ids of its whole text, without special tokens.

    A null and an empty text give an empty list; repeated rows give repeated rows. Other columns are not read.
    Runs where the rows are read, with no shuffle. Long texts cost O(n log n).
    """
    source = df.select(df[key].alias("k"), df[text].alias("t"))
    kind = df.schema[key].dataType.simpleString()

    shared = df.sparkSession.sparkContext.broadcast(rank_file(path))

    def make():
        t = received(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, lengths = t.flat_ids(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), list_array(flat, lengths, pa.int32())], names=[key, ids])

        return step

    return map_batches(source, f"`{key}` {kind}, `{ids}` array<int>", make)


def count_tokens(df: DataFrame, text: str, path: str = BYTE_BPE_50K, count: str = "n_tokens") -> DataFrame:
    """df without the text but with its number of tokens (0 for null and empty); clashing columns are replaced."""
    rest = [c for c in df.columns if c not in (text, count)]
    source = df.select(*rest, df[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text")

    shared = df.sparkSession.sparkContext.broadcast(rank_file(path))

    def make():
        t = received(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = pa.array([t.count(x) for x in batch.column(len(rest)).to_pylist()], pa.int64())
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*rest, count])

        return step

    return map_batches(source, schema + ("," if schema else "") + f" `{count}` bigint", make)


def decode(df: DataFrame, key: str, ids: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, text) of token lists; an empty or null list gives an empty text."""
    kind = df.schema[key].dataType.simpleString()

    shared = df.sparkSession.sparkContext.broadcast(rank_file(path))

    def make():
        t = received(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

        return step

    return map_batches(df.select(key, ids), f"`{key}` {kind}, text string", make)
