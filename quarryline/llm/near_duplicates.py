"""Problem 2: records that share most of their text.

A text's fingerprint is a word of 64 symbols, its minimum hashes: two texts of
similarity J agree in each symbol with probability J, so similar texts are
words of small Hamming distance. Texts are compared where they meet: on a line,
four places of the fingerprint, in all of whose symbols they agree. The lines
are those of the affine space AG(3,4) over the 64 places; any two share at most
one place, which makes the lines' chances of being agreed upon nearly
independent: 48 of them (3 parallel classes) miss two texts of similarity 0.6
with probability 0.0074, of 0.65 with 0.0013, of 0.7 with 0.0001 (`miss_rate`),
all 336 (`classes=21`) with less than one in a million.

This isn't the anchor-point covering that the problem names: a covering code
whose anchors take every fingerprint within covering radius plus threshold.
At a similarity of 0.6 that can't be had (see `code_cost` and the README). What
is kept of it is that fingerprints are replicated to points and compared point
by point ("anchors" below); its guarantee is replaced by the miss rate above.

Who agrees in whole fingerprints well enough is compared by the exact sets of
shingles. The texts of an anchor where very many meet form blocks; pairs of
blocks are compared by tasks of their own, and only pairs whose fingerprints
are close leave them.
"""

from __future__ import annotations

import itertools
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

_word = re.compile(r"[^\W_]+")
SYMBOLS = 64
#: Texts at one anchor beyond which they are compared in pairs of blocks.
CROWDED = 64
#: Texts of a block.
BLOCK = 2_000
#: Exact copies of one text up to which all their pairs are listed; beyond, each copy is paired with the first one.
COPIES = 32


@lru_cache
def design(classes: int = 3) -> np.ndarray:
    """Lines of AG(3,4) in so many parallel classes of 16: place numbers, four a line; two lines share a place at most."""
    times = [[0, 0, 0, 0], [0, 1, 2, 3], [0, 2, 3, 1], [0, 3, 1, 2]]  # of the field of four elements; its sum is xor
    points = list(itertools.product(range(4), repeat=3))
    number = {p: i for i, p in enumerate(points)}
    directions = [d for d in points if any(d) and next(x for x in d if x) == 1]
    lines = []
    for d in directions[:classes]:
        seen: set = set()
        for p in points:
            if p not in seen:
                line = [tuple(a ^ times[k][b] for a, b in zip(p, d)) for k in range(4)]
                seen.update(line)
                lines.append([number[x] for x in line])
    return np.array(lines)


def miss_rate(similarity: float, classes: int = 3, trials: int = 200_000, seed: int = 0) -> float:
    """Measured probability that two texts agree on no line."""
    agree = np.random.default_rng(seed).random((trials, SYMBOLS)) < similarity
    return float(1 - np.any([agree[:, line].all(axis=1) for line in design(classes)], axis=0).mean())


def code_cost(allowed: int, length: int = 23, radius: int = 3, anchors: int = 4096) -> tuple[float, float]:
    """(anchors a fingerprint goes to, share of all fingerprints at an anchor) for one part of an anchor-point covering.

    By default a part is 23 bits and the code the perfect binary Golay code. A fingerprint goes to every anchor within
    radius + allowed, where allowed is the distance that two similar fingerprints may have in the part.
    """
    ball = sum(math.comb(length, r) for r in range(min(length, radius + allowed) + 1))
    return ball * anchors / 2**length, ball / 2**length


def words_of(text: str) -> list[str]:
    """Longest runs of letters and digits of the lower-cased text."""
    return _word.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed runs of `width` words, for many texts at once."""

    def __init__(self, width: int, least_words: int):
        self.width, self.least = width, least_words
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the texts that are long enough, their shingles in a row, where each text's begin)."""
        known = self.known
        if len(known) > 500_000:
            known.clear()
        rows, flat, sizes = [], [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            w = words_of(t)
            if len(w) < max(self.least, self.width):
                continue
            for x in w:
                h = known.get(x)
                if h is None:
                    h = known[x] = xxhash.xxh3_64_intdigest(x)
                flat.append(h)
            rows.append(i)
            sizes.append(len(w))
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.array(flat, np.uint64)
        n = np.array(sizes)
        ends = np.cumsum(n)
        mixed = np.zeros(len(h) - self.width + 1, np.uint64)
        for k in range(self.width):
            mixed = _mix(mixed + h[k : k + len(mixed)] * np.uint64(2 * k + 3))
        text = np.repeat(np.arange(len(rows)), n)[: len(mixed)]
        inside = np.arange(len(mixed)) + self.width <= ends[text]
        mixed, text = mixed[inside], text[inside]
        order = np.lexsort([mixed, text])
        mixed, text = mixed[order], text[order]
        fresh = np.ones(len(mixed), bool)
        fresh[1:] = (mixed[1:] != mixed[:-1]) | (text[1:] != text[:-1])
        mixed, text = mixed[fresh], text[fresh]
        return np.array(rows), mixed, np.searchsorted(text, np.arange(len(rows)))


@lru_cache
def _seeds() -> np.ndarray:
    return _mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprints(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text 64 symbols of 16 bits."""
    out = np.empty((len(starts), SYMBOLS), np.uint16)
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for k, seed in enumerate(_seeds()):
        a, b = np.uint32(int(seed) & 0xFFFFFFFF | 1), np.uint32(int(seed) >> 32)
        x = (low ^ b) * a
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        smallest = np.minimum.reduceat(x, starts)
        smallest ^= smallest >> np.uint32(12)
        smallest *= np.uint32(0x297A2D39)
        out[:, k] = (smallest >> np.uint32(15)).astype(np.uint16)
    return out


def _fingerprinted(df: DataFrame, key: str, text: str, width: int, least_words: int) -> DataFrame:
    """(id, digest, raw, print): a row for each row whose text has enough words; digest tells apart the sets of shingles, raw the texts."""

    def make():
        shingler = Shingler(width, least_words)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows, shingles, starts = shingler(batch.column(1).to_pylist())
            if not len(rows):
                return None
            prints = fingerprints(shingles, starts)
            digest = np.add.reduceat(_mix(shingles), starts) ^ _mix(np.diff(np.append(starts, len(shingles))).astype(np.uint64))
            data = pa.py_buffer(np.ascontiguousarray(prints))
            binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * SYMBOLS), len(rows), [None, data]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(digest.view(np.int64)), batch.column(2).take(pa.array(rows)), binary], names=["id", "digest", "raw", "print"])

        return step

    base = df.where(df[key].isNotNull() & df[text].isNotNull()).select(df[key].cast("string").alias("id"), df[text].alias("t"), F.xxhash64(df[text]).alias("raw"))
    return map_batches(base, "id string, digest bigint, raw bigint, print binary", make)


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _anchors(prints: DataFrame, classes: int) -> DataFrame:
    """(anchor, digest): replicates each fingerprint to its anchors."""

    def make():
        lines = design(classes)
        salt = _mix(np.arange(len(lines), dtype=np.uint64) + np.uint64(77))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = _prints(batch.column(1)).astype(np.uint64)[:, lines]  # texts x lines x 4
            word = p[:, :, 0] | p[:, :, 1] << np.uint64(16) | p[:, :, 2] << np.uint64(32) | p[:, :, 3] << np.uint64(48)
            anchor = _mix(word + salt).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(anchor.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), len(lines)))], names=["anchor", "digest"])

        return step

    return map_batches(prints.select("digest", "print"), "anchor bigint, digest bigint", make)


#: One in so many texts is looked at to know the hottest anchors before any rows are sorted by anchor; an anchor is hot if it
#: holds more than this share of them, so that at most the lines over this share are.
HOT_SAMPLE, HOT_SHARE, HOT_LEAST = 64, 1e-4, 50


def _hot(marked: DataFrame, classes: int) -> np.ndarray:
    """The hottest anchors, in order, by a sample: their texts go to blocks at once. Only the plan depends on it, never the pairs."""
    sample = materialize(marked.where(F.pmod(F.xxhash64("digest"), F.lit(HOT_SAMPLE)) == 0).dropDuplicates(["digest"]), "sample")
    counted = _anchors(sample, classes).groupBy("anchor").count()
    n = sample.count()
    rows = counted.where(F.col("count") >= max(HOT_LEAST, HOT_SHARE * n)).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in rows], np.int64))


def _met(anchored: DataFrame, crowded: int, hot: np.ndarray) -> DataFrame:
    """(a, b, anchor): pairs a < b that meet at an anchor; where more than `crowded` meet, or which is hot, (a, null, anchor) of each instead.

    Reads each partition in the order of anchors, a batch at a time, and keeps no more than an uncrowded anchor. Rows of
    hot anchors pass by unsorted, where they are.
    """
    spark = anchored.sparkSession
    if len(hot):
        shared = spark.sparkContext.broadcast(hot)

        def split(batches):
            hot = shared.value
            for batch in batches:
                a = batch.column(0).to_numpy()
                at = np.minimum(np.searchsorted(hot, a), len(hot) - 1)
                is_hot = hot[at] == a
                n = int(is_hot.sum())
                if n:
                    d = batch.column(1).to_numpy()[is_hot]
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(np.zeros(n, np.int64)), pa.array(a[is_hot]), pa.array(np.zeros(n, bool))], names=["a", "b", "anchor", "pair"])

        def cool(batches):
            hot = shared.value
            for batch in batches:
                a = batch.column(0).to_numpy()
                yield batch.take(pa.array(np.flatnonzero(hot[np.minimum(np.searchsorted(hot, a), len(hot) - 1)] != a)))

        passed = anchored.mapInArrow(split, "a bigint, b bigint, anchor bigint, pair boolean")
        return passed.unionByName(_met(anchored.mapInArrow(cool, anchored.schema), crowded, hot[:0]))
    ordered = anchored.repartition("anchor").sortWithinPartitions("anchor", "digest")

    def run(batches):
        held_anchor, held, over = None, np.empty(0, np.int64), False  # the anchor that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, digest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            sizes = np.diff(np.append(starts, len(anchor)))
            a_, b_, c_ = [], [], []

            def close(at, members):
                m = np.unique(members)
                if len(m) > crowded:
                    a_.append(m)
                    b_.append(np.zeros(len(m), np.int64))
                    c_.append((np.full(len(m), at), np.zeros(len(m), bool)))
                elif len(m) > 1:
                    i, j = np.triu_indices(len(m), 1)
                    a_.append(m[i])
                    b_.append(m[j])
                    c_.append((np.full(len(i), at), np.ones(len(i), bool)))

            def crowd(at, members):
                m = np.unique(members)
                a_.append(m)
                b_.append(np.zeros(len(m), np.int64))
                c_.append((np.full(len(m), at), np.zeros(len(m), bool)))

            last = len(starts) - 1
            # runs of two, by far the most, at once
            twos = np.flatnonzero((sizes == 2) & (np.arange(len(starts)) > 0) & (np.arange(len(starts)) < last))
            x, y = digest[starts[twos]], digest[starts[twos] + 1]
            differ = x != y
            a_.append(x[differ])
            b_.append(y[differ])
            c_.append((anchor[starts[twos]][differ], np.ones(int(differ.sum()), bool)))
            rest = [0, *np.flatnonzero((sizes > 2) & (np.arange(len(starts)) > 0) & (np.arange(len(starts)) < last))]
            if last:
                rest.append(last)
            for r in rest:
                at, members = anchor[starts[r]], digest[starts[r] : starts[r] + sizes[r]]
                if r == 0 and at == held_anchor:
                    if over:
                        crowd(at, members)
                        if last:
                            held_anchor, held, over = None, np.empty(0, np.int64), False
                        continue
                    members = np.unique(np.concatenate([held, members]))
                elif r == 0 and held_anchor is not None:
                    if not over:
                        close(held_anchor, held)
                    held_anchor, held, over = None, np.empty(0, np.int64), False
                if r == last:
                    members = np.unique(members)
                    over = len(members) > crowded
                    held_anchor, held = at, members
                    if over:
                        crowd(at, members)
                        held = np.empty(0, np.int64)
                else:
                    close(at, members)
                    if r == 0:
                        held_anchor, held, over = None, np.empty(0, np.int64), False
            if a_:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_)), pa.array(np.concatenate(b_)), pa.array(np.concatenate([c for c, _ in c_])), pa.array(np.concatenate([p for _, p in c_]))], names=["a", "b", "anchor", "pair"])
        if held_anchor is not None and not over and len(held) > 1:
            i, j = np.triu_indices(len(held), 1)
            yield pa.RecordBatch.from_arrays([pa.array(held[i]), pa.array(held[j]), pa.array(np.full(len(i), held_anchor)), pa.array(np.ones(len(i), bool))], names=["a", "b", "anchor", "pair"])

    return ordered.mapInArrow(run, "a bigint, b bigint, anchor bigint, pair boolean")


def _close(pairs: DataFrame, prints: DataFrame, floor: int) -> DataFrame:
    """Pairs whose fingerprints agree in at least so many symbols."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            agree = (_prints(batch.column(2)) == _prints(batch.column(3))).sum(axis=1) >= floor
            keep = np.flatnonzero(agree)
            return batch.select(["a", "b"]).take(pa.array(keep))

        return step

    p = prints.select("digest", "print")
    both = pairs.join(p.select(F.col("digest").alias("a"), F.col("print").alias("pa")), "a").join(p.select(F.col("digest").alias("b"), F.col("print").alias("pb")), "b")
    return map_batches(both.select("a", "b", "pa", "pb"), "a bigint, b bigint", make)


def _similar_classes(df: DataFrame, key: str, text: str, similarity: float, width: int, least_words: int, classes: int, crowded: int, block: int, floor: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the classes of records with one set of shingles: (id, digest, raw, print) by row, (digest, id, n) with the first record, and (a, b) of the similar ones."""
    floor = _floor(similarity) if floor is None else floor
    marked = materialize(_fingerprinted(df, key, text, width, least_words), "fingerprints")
    heads = marked.select("id", "digest").distinct().groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    heads = materialize(heads, "classes")
    repeats = marked.select("id", "digest").groupBy("digest").agg(F.count("*").alias("rows")).where("rows > 1")
    # One fingerprint a class: rows alone in theirs pass by, the others are reduced to one.
    prints = marked.select("digest", "print").join(repeats.select("digest"), "digest", "left_anti")
    prints = prints.unionByName(marked.join(repeats.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("print").alias("print")))
    met = materialize(_met(_anchors(prints, classes), crowded, _hot(marked, classes)), "met")
    pairs = met.where("pair").select("a", "b")
    busy = met.where("not pair").select("anchor", F.col("a").alias("digest")).distinct()
    if not busy.isEmpty():
        crowds = materialize(_crowds(busy, prints, classes, floor, block), "crowds")
        pairs = pairs.unionByName(crowds)
    near = materialize(_close(pairs.distinct(), prints, floor), "near")

    texts = df.where(df[key].isNotNull() & df[text].isNotNull()).select(df[key].cast("string").alias("id"), df[text].alias("t"))
    named = near.join(heads.select(F.col("digest").alias("a"), F.col("id").alias("ia")), "a").join(heads.select(F.col("digest").alias("b"), F.col("id").alias("ib")), "b")
    named = materialize(named, "named")
    wanted = named.select(F.col("ia").alias("id")).union(named.select(F.col("ib").alias("id"))).distinct()
    read = texts.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    sides = named.join(read.select(F.col("id").alias("ia"), F.col("t").alias("ta")), "ia").join(read.select(F.col("id").alias("ib"), F.col("t").alias("tb")), "ib")
    return marked, heads, materialize(_verified(sides, width, least_words, similarity), "pairs")


def similar_pairs(df: DataFrame, key: str = "evidence_id", text: str = "text", similarity: float = 0.6, width: int = 3, least_words: int = 12, classes: int = 3, crowded: int = CROWDED, copies: int = COPIES, block: int = BLOCK, every_copy: bool = False, floor: int | None = None) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: records whose sets of runs of `width` words share at least `similarity` of their union.

    Both texts have at least `least_words` words. Rows with a null key or text are left out; rows that repeat a key must
    repeat its text and count once. Different texts give all pairs of their records. More than `copies` records of the very
    same text are paired with the first of them only, and with other texts that one stands for all unless `every_copy` is
    set; then each copy is paired with each record of other texts, but two texts of as many records, all of whose pairs
    would be their product, with the first of the other (see `copy_classes` for the membership). classes=21 and floor=0 look at every line and leave out no pair that meets
    before its sets of shingles are compared; by default some are missed at the stated rates. Extra columns are ignored; an empty table gives no rows.
    """
    marked, heads, checked = _similar_classes(df, key, text, similarity, width, least_words, classes, crowded, block, floor)
    members = marked.select("id", "digest").distinct()
    small = members.join(heads.where((F.col("n") <= copies) & (F.col("n") > 1)).select("digest"), "digest", "left_semi")
    within = small.select("digest", F.col("id").alias("x")).join(small.select("digest", F.col("id").alias("y")), "digest").where("x < y").select("x", "y")
    large = heads.where(F.col("n") > copies).select("digest")
    shown = members
    if not large.isEmpty():
        # Classes of many records by their texts: different texts meet text by text, so that no copies meet in vain.
        own = materialize(marked.select("id", "digest", "raw").join(large, "digest", "left_semi").distinct(), "large")
        texts = materialize(own.groupBy("digest", "raw").agg(F.min("id").alias("first"), F.count("*").alias("n")), "texts")
        placed = own.join(texts, ["digest", "raw"])
        few = placed.where(F.col("n") <= copies).select("digest", "raw", "id")
        star = placed.where((F.col("n") > copies) & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"))
        same = few.select("digest", "raw", F.col("id").alias("x")).join(few.select("digest", "raw", F.col("id").alias("y")), ["digest", "raw"]).where("x < y").select("x", "y")
        seen = own if every_copy else placed.where((F.col("n") <= copies) | (F.col("id") == F.col("first"))).select("id", "digest", "raw")
        side = lambda d: texts.select(*[F.col(c).alias(c + d) for c in ("digest", "raw", "first", "n")])
        two = side("a").join(side("b").withColumnRenamed("digestb", "digesta"), "digesta").where("rawa < rawb").withColumn("digestb", F.col("digesta"))
        if every_copy:  # two large classes meet by their texts as well
            both = checked.join(large.select(F.col("digest").alias("a")), "a", "left_semi").join(large.select(F.col("digest").alias("b")), "b", "left_semi")
            checked = checked.join(both, ["a", "b"], "left_anti")
            two = two.unionByName(both.select(F.col("a").alias("digesta"), F.col("b").alias("digestb")).join(side("a"), "digesta").join(side("b"), "digestb"))
        else:
            shown = members.join(large, "digest", "left_anti").unionByName(seen.select("digest", "id"))
        within = within.unionByName(star).unionByName(same).unionByName(_of_texts(materialize(two, "texts"), seen, copies))
    across = checked.join(shown.select(F.col("digest").alias("a"), F.col("id").alias("x")), "a").join(shown.select(F.col("digest").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _of_texts(two: DataFrame, seen: DataFrame, copies: int) -> DataFrame:
    """(x, y): the records of pairs of different texts. Of two texts with more than `copies` records each, all records of one meet the first of the other."""
    record = lambda d, name: seen.select(F.col("digest").alias("digest" + d), F.col("raw").alias("raw" + d), F.col("id").alias(name))
    many = (F.col("na") > copies) & (F.col("nb") > copies)
    every = two.where(~many).join(record("a", "x"), ["digesta", "rawa"]).join(record("b", "y"), ["digestb", "rawb"]).select("x", "y")
    one = two.where(many).join(record("a", "x"), ["digesta", "rawa"]).select("x", F.col("firstb").alias("y"))
    other = two.where(many).join(record("b", "y"), ["digestb", "rawb"]).select(F.col("firsta").alias("x"), "y")
    return every.unionByName(one).unionByName(other)


def copy_classes(df: DataFrame, key: str = "evidence_id", text: str = "text") -> DataFrame:
    """(id, class_id, class_size) of each record with a text: the records of the very same text, named by their smallest id.

    With it the pairs that similar_pairs leaves out for very many copies can be had. Null keys and texts are left out;
    repeated rows count once. Texts are told apart by 256 bits.
    """
    rows = df.where(df[key].isNotNull() & df[text].isNotNull()).select(df[key].cast("string").alias("id"), F.unhex(F.sha2(df[text], 256)).alias("h")).distinct()
    rows = materialize(rows, "copies")
    sizes = rows.groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    # Rows alone in their class needn't be joined, and few classes have several.
    several = sizes.where("class_size > 1")
    return rows.join(several, "h", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def similar_groups(df: DataFrame, key: str = "evidence_id", text: str = "text", similarity: float = 0.6, width: int = 3, least_words: int = 12, classes: int = 3, crowded: int = CROWDED, block: int = BLOCK) -> DataFrame:
    """(id, group_id, n_links): connected groups of all similar records and how many records each is similar to, counted by classes.

    Groups are named by their smallest id; records without a similar one are groups of one. Null keys are left out.
    """
    marked, heads, checked = _similar_classes(df, key, text, similarity, width, least_words, classes, crowded, block)
    both = materialize(checked.select("a", "b").unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b"))), "linked")
    linked = both.join(heads.select(F.col("digest").alias("b"), "n"), "b").groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("others"))
    ends = checked.join(heads.select(F.col("digest").alias("a"), F.col("id").alias("id_a")), "a").join(heads.select(F.col("digest").alias("b"), F.col("id").alias("id_b")), "b")
    named = classes_of(ends.select("id_a", "id_b"), heads.select("id")).select("id", "group_id")
    whole = heads.join(named, "id").join(linked, "digest", "left").select("digest", "group_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    known = df.select(df[key].cast("string").alias("id")).where("id is not null").distinct()
    joined = known.join(marked.select("id", "digest").distinct(), "id", "left").join(whole, "digest", "left")
    return joined.select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _floor(similarity: float) -> int:
    """Symbols in which all but one in 30,000 pairs of the similarity agree."""
    return int(SYMBOLS * similarity - 4.0 * (SYMBOLS * similarity * (1 - similarity)) ** 0.5)


def _crowds(busy: DataFrame, prints: DataFrame, classes: int, floor: int, block: int) -> DataFrame:
    """(a, b): pairs within crowded anchors whose fingerprints are close.

    An anchor's texts form blocks by hash, and each pair of blocks is compared by itself, so that no task holds more than
    two blocks however crowded the anchor is. A pair is given only by the first line on which its texts agree.
    """
    sizes = busy.groupBy("anchor").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = busy.join(sizes, "anchor").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own"), "digest").join(prints, "digest")
    ordered = spread.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "digest").select("anchor", "i", "j", "own", "digest", "print")

    def run(batches):
        lines = design(classes)
        salt = _mix(np.arange(len(lines), dtype=np.uint64) + np.uint64(77))
        key, held = None, []

        def compare():
            anchor, i, j = key
            own = np.concatenate([h[0] for h in held])
            digest = np.concatenate([h[1] for h in held])
            p = np.concatenate([h[2] for h in held])
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            a_, b_ = [], []
            for r in left:
                others = right[right > r] if i == j else right
                near = others[(p[others] == p[r]).sum(axis=1) >= floor]
                if not len(near):
                    continue
                agreed = (p[near][:, lines] == p[r][lines]).all(axis=2)
                first = agreed.argmax(axis=1)
                w = p[r].astype(np.uint64)[lines]
                word = w[:, 0] | w[:, 1] << np.uint64(16) | w[:, 2] << np.uint64(32) | w[:, 3] << np.uint64(48)
                near = near[_mix(word + salt).view(np.int64)[first] == anchor]
                a_.append(np.full(len(near), digest[r]))
                b_.append(digest[near])
            if a_:
                x, y = np.concatenate(a_), np.concatenate(b_)
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            return None

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, i, j, own, digest = (batch.column(c).to_numpy() for c in range(5))
            p = _prints(batch.column(5))
            edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
            for x, y in zip(edge[:-1], edge[1:]):
                now = (anchor[x], i[x], j[x])
                if now != key:
                    if key is not None and (out := compare()) is not None:
                        yield out
                    key, held = now, []
                held.append((own[x:y], digest[x:y], p[x:y]))
        if key is not None and (out := compare()) is not None:
            yield out

    return ordered.mapInArrow(run, "a bigint, b bigint")


def _verified(sides: DataFrame, width: int, least_words: int, similarity: float) -> DataFrame:
    """Pairs of digests whose texts' exact sets of shingles are similar enough."""

    def make():
        def shingles(t: str) -> set[tuple[str, ...]]:
            w = words_of(t)
            return set(zip(*(w[k:] for k in range(width))))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                a, b = shingles(x), shingles(y)
                both = len(a & b)
                if both >= similarity * (len(a) + len(b) - both) - 1e-12:
                    keep.append(i)
            return batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

        return step

    return map_batches(sides.select("a", "b", "ta", "tb"), "a bigint, b bigint", make)


def classes_of(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, group_id, n_links): connected groups of the pairs, named by their smallest id; records without a pair are groups of one.

    Each round a record takes the smallest name among its neighbours' and its name's own name, so that chains halve. Rounds
    go on until no name changes.
    """
    edges = materialize(pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).unionByName(pairs.select(F.col("id_b").alias("u"), F.col("id_a").alias("v"))), "edges")
    links = edges.groupBy("u").agg(F.count("*").alias("n_links"))
    names = materialize(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("name")), "names")
    while True:
        offered = edges.join(names.select(F.col("u").alias("v"), F.col("name").alias("offer")), "v").groupBy("u").agg(F.min("offer").alias("offer"))
        jumped = names.join(names.select(F.col("u").alias("name"), F.col("name").alias("far")), "name", "left")
        after = materialize(jumped.join(offered, "u", "left").select("u", F.least("name", F.coalesce("far", "name"), F.coalesce("offer", "name")).alias("name"), F.col("name").alias("old")), "names")
        names = after.select("u", "name")
        if after.where("name <> old").isEmpty():
            break
    known = ids.select(ids[ids.columns[0]].cast("string").alias("id")).where("id is not null").distinct()
    joined = known.join(names.withColumnRenamed("u", "id"), "id", "left").join(links.withColumnRenamed("u", "id"), "id", "left")
    return joined.select("id", F.coalesce("name", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
