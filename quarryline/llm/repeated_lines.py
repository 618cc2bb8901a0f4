"""Problem 3: lines and blocks of lines that one source repeats over its documents.

Each task concatenates the line ids of its documents by source, sorts the
suffixes into a suffix array and reads the repeated blocks off the common
prefixes of neighbours. A block is reported with at most `spread` of its
documents; as only "in at least `spread` documents" is asked, uniting these
partial sets over all tasks is exact, however often a block occurs and however
large its source is. No source, line or block is ever gathered in one task.

A block counts from `least_words` words on: one line of as many, or several
shorter ones that follow each other (a menu, a share prompt with its buttons).
What is wanted is the union of all blocks that span `spread` documents. Every
part of such a block spans as many, so each line of it lies in a part that
has enough words but, without its first line or without its last one, too few;
as a line has a word at least, such a part has at most `least_words` lines.
Suffixes are therefore compared to that depth and no further, and only such
parts are reported: no longer block is lost by it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

_digits = re.compile(r"\d+")
#: Suffixes that are sorted at a time.
SUFFIXES = 400_000


def line_keys(content: str) -> list[tuple[int, str, int]]:
    """(line number, compared form, words) of the lines that aren't blank: trimmed, blanks squeezed, lower case, each run of digits a 0."""
    out = []
    for no, line in enumerate(_digits.sub("0", content.lower()).split("\n")):
        words = line.split()
        if words:
            out.append((no, " ".join(words), len(words)))
    return out


def _h(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class _Lines:
    """Reads batches of (document, source, text) into arrays: source hash, document, line number, line id, words, whether a text begins."""

    def __init__(self):
        self.sources: dict[str, int] = {}

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        s, k, no, ids, words, first = [], [], [], [], [], []
        for document, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = line_keys(text)
            if source not in self.sources:
                if len(self.sources) > 100_000:
                    self.sources.clear()
                self.sources[source] = _h(" ".join(source.split()).lower())
            s += [self.sources[source]] * len(found)
            k += [document] * len(found)
            no += [n for n, _, _ in found]
            ids += [_h(line) for _, line, _ in found]
            words += [w for _, _, w in found]
            first += [True] * bool(found) + [False] * (len(found) - 1)
        return np.array(s, np.int64), np.array(k, np.int64), np.array(no, np.int32), np.array(ids, np.int64), np.array(words, np.int64), np.array(first, bool)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _reach(first: np.ndarray) -> np.ndarray:
    """Lines from each one to its text's end."""
    edge = np.append(np.flatnonzero(first), len(first))
    return np.repeat(edge[1:], np.diff(edge)) - np.arange(len(first))


def _parts(words: np.ndarray, reach: np.ndarray, depth: int, least_words: int, every: bool = False):
    """For each depth j: which suffixes begin with j + 1 lines that are a part to report, or a block if every one is asked for."""
    n = len(words)
    sums = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    for j in range(depth):
        end = np.minimum(at + j + 1, n)
        whole, tail, front = sums[end] - sums[at], sums[end] - sums[np.minimum(at + 1, n)], sums[np.maximum(end - 1, 0)] - sums[at]
        yield (reach > j) & (whole >= least_words) & (every or (j == 0) | (tail < least_words) | (front < least_words))


def suffix_blocks(s: np.ndarray, k: np.ndarray, ids: np.ndarray, words: np.ndarray, first: np.ndarray, depth: int, spread: int, least_words: int, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(source, length, block, document) of the parts of 1 to `depth` lines, each with up to `spread` documents.

    The rows are the concatenated lines of documents, a document's lines together and in order. A block's hash is
    built line by line, so that equal hashes are equal prefixes.
    """
    n = len(ids)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    reach = _reach(first)
    wanted = list(_parts(words, reach, depth, least_words, every))
    u = ids.view(np.uint64)
    ahead = []
    for j in range(depth):
        column = np.zeros(n, np.uint64)
        column[: max(0, n - j)] = u[j:]
        column[reach <= j] = 0
        ahead.append(column)
    array = np.lexsort([k, *reversed(ahead), s])  # the suffix array
    s, k = s[array], k[array]
    common = np.ones(n, bool)  # with the suffix before
    common[0] = False
    common[1:] = s[1:] == s[:-1]
    prefix = s.view(np.uint64)
    out = []
    for j in range(depth):
        column = ahead[j][array]
        common[1:] &= column[1:] == column[:-1]
        prefix = _mixed(prefix, column)
        run = np.cumsum(~common)
        long = np.flatnonzero(wanted[j][array])
        by_document = long[np.lexsort([k[long], run[long]])]
        r, d = run[by_document], k[by_document]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1])
        pick = by_document[new]
        r = run[pick]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.empty(0, int)
        nth = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
        pick = pick[nth < spread]
        out.append((s[pick], np.full(len(pick), j + 1, np.int32), prefix[pick].view(np.int64), k[pick]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def _read(df: DataFrame, key: str, source: str, content: str) -> DataFrame:
    return df.where(df[source].isNotNull() & df[content].isNotNull() & df[key].isNotNull()).select(df[key].cast("long").alias("k"), df[source].alias("s"), df[content].alias("t"))


def repeated_blocks(df: DataFrame, key: str, source: str, content: str, spread: int, least_words: int, depth: int, every: bool = True) -> DataFrame:
    """(s, length, block) of the blocks of up to `depth` lines that at least `spread` documents of a source hold; without `every` the parts that cover them."""

    def run(batches):
        lines, held, size = _Lines(), [], 0

        def flush():
            s, k, i, w, f = (np.concatenate([h[c] for h in held]) for c in (0, 1, 3, 4, 5))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in suffix_blocks(s, k, i, w, f, depth, spread, least_words, every)], names=["s", "length", "block", "k"])

        for batch in batches:
            held.append(lines(batch))
            size += len(held[-1][0])
            if size >= SUFFIXES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    partial = _read(df, key, source, content).mapInArrow(run, "s bigint, length int, block bigint, k bigint")
    # At most `spread` rows of a block come here from a task.
    return partial.distinct().groupBy("s", "length", "block").agg(F.count("*").alias("n")).where(F.col("n") >= spread).select("s", "length", "block")


def _marked(df: DataFrame, key: str, source: str, content: str, spread: int, least_words: int, depth: int | None, counted: bool) -> DataFrame:
    """(k, line_no) of the lines of repeated blocks; of those that count by themselves only, if asked."""
    depth = depth or least_words
    blocks = repeated_blocks(df, key, source, content, spread, least_words, depth, False).select("block")

    def make():
        lines = _Lines()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s, k, no, ids, words, first = lines(batch)
            n = len(ids)
            reach = _reach(first)
            prefix = s.view(np.uint64)
            counts = words >= least_words
            out = []
            for j, wanted in enumerate(_parts(words, reach, depth, least_words)):
                ahead = np.zeros(n, np.uint64)
                ahead[: max(0, n - j)] = ids.view(np.uint64)[j:]
                prefix = _mixed(prefix, ahead)
                at = np.flatnonzero(wanted)
                if not counted:
                    out.append((k[at], no[at], no[at + j], prefix[at].view(np.int64)))
                    continue
                for o in range(j + 1):
                    here = at[counts[at + o]]
                    out.append((k[here], no[here + o], no[here + o], prefix[here].view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(4)], names=["k", "line_no", "last", "block"])

        return step

    lines = map_batches(_read(df, key, source, content), "k bigint, line_no int, last int, block bigint", make)
    return lines.join(blocks, "block", "left_semi").select("k", F.explode(F.sequence("line_no", "last")).alias("line_no")).distinct()


def repeated_lines(df: DataFrame, key: str = "article_id", source: str = "source", content: str = "content", spread: int = 6, least_words: int = 5, depth: int | None = None) -> DataFrame:
    """(key, line_no) of each line that counts within a block of lines that at least `spread` documents of its source hold.

    Sources and lines are compared trimmed, squeezed and lower-cased, lines with each run of digits as one 0. Rows with
    a null key, source or content, and lines of fewer than `least_words` words, never count; repeated rows of a document
    count once. Extra columns are ignored; an empty table gives no rows.
    """
    return _marked(df, key, source, content, spread, least_words, depth, True).withColumnRenamed("k", key)


def without_repeated_lines(df: DataFrame, key: str = "article_id", source: str = "source", content: str = "content", spread: int = 6, least_words: int = 5, depth: int | None = None) -> DataFrame:
    """df with `content` freed of the blocks of lines that at least `spread` documents of its source hold, and n_removed (int), the lines taken out.

    Short lines and blank ones go with a block of several lines. The other lines stay as they are; a null content stays
    null. Every row comes back, repeated rows too. `depth` limits the lines of a block that is looked for; by default no
    block is lost.
    """
    gone = _marked(df, key, source, content, spread, least_words, depth, False).groupBy("k").agg(F.collect_set("line_no").alias("__gone")).withColumnRenamed("k", "__k")
    joined = df.join(gone, df[key].cast("long") == F.col("__k"), "left")
    # A row without a source never counts, so it stays whole even if another row of its document has one.
    gone_here = F.when(F.col(source).isNull() | F.col("__gone").isNull(), F.array().cast("array<int>")).otherwise(F.col("__gone"))
    lines = F.split(F.col(content), "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: ~F.array_contains(gone_here, p["i"]))
    text = F.when(F.size(gone_here) == 0, F.col(content)).otherwise(F.array_join(F.transform(kept, lambda p: p["x"]), "\n"))
    return joined.withColumns({content: text, "n_removed": F.size(gone_here).cast("int")}).select(*[c for c in df.columns if c != "n_removed"], "n_removed")
