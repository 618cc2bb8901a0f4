"""Problem 6: oversized items into pieces at natural boundaries.

An item is worked on in ranges of characters (of bytes for files), each with a
halo that shows how the text before it ends. A range finds its word starts and
how natural a cut before each of them is. Prefix sums of the ranges' words and
characters give every word its number in the item, and cuts are chosen by
number alone: cut k is the most natural one of the words in the window
(k * stride - slack, k * stride], whichever ranges it lies in. So cuts need no
chain through the text, and pieces are taken from the ranges by offset. Nothing
ever loads a whole item or file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import list_array, map_batches, materialize

_word = re.compile(r"\S+")
_sentence = tuple(".!?…。！？؟۔;:")
#: A section starts after a blank line where a line of ASCII letters, white space, commas, brackets or hyphens follows.
_section = re.compile(r"\n\n(?=[A-Z](?:[A-Za-z,()\-]|[^\S\n])+(?:\n|\Z))")


@dataclass(frozen=True)
class Limits:
    """Pieces have at most `words` words, `overlap` of them from the piece before; a cut may move back by `slack` words."""

    words: int = 500
    overlap: int = 50
    slack: int = 150
    range_chars: int = 1 << 16
    halo: int = 256

    @property
    def stride(self) -> int:
        return self.words - self.overlap - self.slack


def sections(content: str) -> list[str]:
    """Trimmed bodies of an article's sections, without their headings; empty ones stay, so that places are numbers."""
    out = []
    for part in _section.split(content):
        part = part.strip()
        first, _, rest = part.partition("\n")
        first = first.strip()
        heading = len(first) < 40 and not first.endswith(".") and not first.startswith("-")
        out.append(rest.strip() if heading else part)
    return out


def article_sections(df: DataFrame, key: str = "article_id", content: str = "content") -> DataFrame:
    """(item_kind, item_id, section_no, text) of the sections of each row; a null content has none."""
    source = df.where(df[content].isNotNull() & df[key].isNotNull()).select(df[key].cast("string").alias("i"), df[content].alias("t"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, nos, texts = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = sections(t)
                ids += [i] * len(parts)
                nos += range(len(parts))
                texts += parts
            return pa.RecordBatch.from_arrays([pa.array(["article"] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], names=["item_kind", "item_id", "section_no", "text"])

        return step

    return map_batches(source, "item_kind string, item_id string, section_no int, text string", make)


def evidence_sections(df: DataFrame, key: str = "evidence_id", section: str = "section") -> DataFrame:
    """The same for the values of evidence sections, which are items with number 0; null ones are none."""
    return df.where(df[section].isNotNull() & df[key].isNotNull()).select(F.lit("evidence").alias("item_kind"), df[key].cast("string").alias("item_id"), F.lit(0).cast("int").alias("section_no"), df[section].alias("text"))


ITEM = ["item_kind", "item_id", "section_no"]
#: Ranges of files that a task reads on average, and that it gives at a time.
TASK_RANGES, AT_A_TIME = 256, 16
#: Ranges whose sums one task works out.
BLOCK = 1024
_RANGE = "item_kind string, item_id string, section_no int, range_no bigint, single boolean, text string, before string"


def ranges(items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Cuts each item into ranges of characters with what comes before them; null texts are left out, repeated items kept once."""

    def make():
        n = limits.range_chars

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [], [], [], [], [], [], []
            for kind, i, no, text in zip(*(c.to_pylist() for c in batch.columns)):
                for r in range(max(1, -(-len(text) // n))):
                    for to, x in zip(rows, (kind, i, no, r, len(text) <= n, text[r * n : (r + 1) * n], text[max(0, r * n - limits.halo) : r * n])):
                        to.append(x)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=[*ITEM, "range_no", "single", "text", "before"])

        return step

    return map_batches(items.where("text is not null").select(*ITEM, "text"), _RANGE, make)


def files_in(spark: SparkSession, folder: str) -> list[str]:
    """Paths of a folder's files of some size, as file_ranges takes them."""
    from pyarrow import fs

    folder = re.sub(r"^file:/+", "/", folder)
    system, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    scheme = folder[: len(folder) - len(at)] if folder.endswith(at) else ""
    return sorted(scheme + f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.size and not f.base_name.startswith((".", "_")))


def file_ranges(spark: SparkSession, paths: list[str], limits: Limits = Limits()) -> DataFrame:
    """The same for UTF-8 files, by byte ranges: a range owns the characters that begin in it, and seeks to them.

    item_kind is `file`, item_id the path. Paths are read through pyarrow's file systems (local paths and URIs).
    """
    from pyarrow import fs

    rows = []
    for path in paths:
        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        size = system.get_file_info(at).size or 0
        rows.append((path, size))
    n = limits.range_chars
    listed = spark.createDataFrame(rows, "path string, size bigint")
    # The list is small whatever lies behind it: tasks are made by the ranges to read, and give a few of them at a time.
    tasks = max(1, -(-sum(-(-size // n) for _, size in rows) // TASK_RANGES))
    spread = listed.select("path", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / n)))).alias("range_no")).repartition(tasks, "path", "range_no")

    def make():
        open_files: dict[str, object] = {}
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string()]

        def read(path: str, size: int, r: int) -> tuple:
            if path not in open_files:
                if len(open_files) >= 64:
                    open_files.popitem()[1].close()
                system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                open_files[path] = system.open_input_file(at)
            low, begin, end = max(0, r * n - 4 * limits.halo), r * n, min(size, (r + 1) * n)
            data = open_files[path].read_at(min(size, end + 3) - low, low)
            a, b = begin - low, end - low
            while a < len(data) and a > 0 and data[a] & 0xC0 == 0x80:
                a += 1
            while b < len(data) and data[b] & 0xC0 == 0x80:
                b += 1
            return "file", path, 0, r, size <= n, data[a:b].decode("utf-8", "replace"), data[:a].decode("utf-8", "ignore")[-limits.halo :]

        def step(batch: pa.RecordBatch):
            wanted = list(zip(*(c.to_pylist() for c in batch.columns)))
            for at in range(0, len(wanted), AT_A_TIME):
                rows = zip(*(read(*x) for x in wanted[at : at + AT_A_TIME]))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=[*ITEM, "range_no", "single", "text", "before"])

        return step

    return map_batches(spread.select("path", "size", "range_no"), _RANGE, make)


def boundaries(text: str, before: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words that begin in the range, and how natural a cut before each is: 3 blank line, 2 line, 1 sentence, 0."""
    starts, levels = [], []
    end = 0
    lead = before.rstrip()
    tail, gap = lead[-1:], before[len(lead) :]
    inside = bool(before) and not gap
    for m in _word.finditer(text):
        a = m.start()
        if not (a == 0 and inside):
            space = gap + text[end:a] if not starts and not end else text[end:a]
            breaks = space.count("\n")
            starts.append(a)
            levels.append(3 if breaks > 1 else 2 if breaks else 1 if tail in _sentence and tail else 0)
        end = m.end()
        tail = text[end - 1]
    return np.array(starts, np.int64), np.array(levels, np.int8)


def _counted(cut: DataFrame, limits: Limits, keep_small: bool) -> DataFrame:
    """Ranges with their word table; ranges of items that are surely small are dropped unless kept."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            texts, before, single = (batch.column(i).to_pylist() for i in (5, 6, 4))
            rows, starts, levels, words = [], [], [], []
            for r, (t, b, one) in enumerate(zip(texts, before, single)):
                if one and not keep_small and len(t.split(None, limits.words)) <= limits.words:
                    continue
                s, v = boundaries(t, b)
                rows.append(r)
                starts.append(s)
                levels.append(v)
                words.append(len(s))
            if not rows:
                return None
            taken = batch.take(pa.array(rows))
            n = np.array(words, np.int64)
            chars = pa.array([len(texts[r]) for r in rows], pa.int64())
            return pa.RecordBatch.from_arrays([*[taken.column(i) for i in (0, 1, 2, 3, 5)], pa.array(n), chars, list_array(np.concatenate(starts).astype(np.int32), n, pa.int32()), list_array(np.concatenate(levels), n, pa.int8())], names=[*ITEM, "range_no", "text", "n_words", "n_chars", "starts", "levels"])

        return step

    return map_batches(cut, "item_kind string, item_id string, section_no int, range_no bigint, text string, n_words bigint, n_chars bigint, starts array<int>, levels array<tinyint>", make)


def oversized(cut: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(item_kind, item_id, section_no, n_words) of the items of more than limits.words words: the stitched sums of their ranges."""
    counted = _counted(cut, limits, False).groupBy(*ITEM, "range_no").agg(F.max("n_words").alias("n_words"))  # repeats of an item
    return counted.groupBy(*ITEM).agg(F.sum("n_words").alias("n_words")).where(F.col("n_words") > limits.words)


def _stitched(table: DataFrame) -> DataFrame:
    """Ranges with what the item has before them (word0, char0) and in all (words, chars).

    Sums go by blocks of BLOCK ranges and over the blocks, so that no task sees more of an item than a block's ranges or
    a row for each of its blocks.
    """
    narrow = table.select(*ITEM, "range_no", F.floor(F.col("range_no") / BLOCK).alias("block"), "n_words", "n_chars")
    before = lambda *by: Window.partitionBy(*ITEM, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sum_ = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = narrow.groupBy(*ITEM, "block").agg(F.sum("n_words").alias("bw"), F.sum("n_chars").alias("bc"))
    item = Window.partitionBy(*ITEM)
    blocks = blocks.select(*ITEM, "block", sum_("bw", before("block")).alias("w0"), sum_("bc", before("block")).alias("c0"), F.sum("bw").over(item).alias("words"), F.sum("bc").over(item).alias("chars"))
    inside = narrow.select(*ITEM, "block", "range_no", sum_("n_words", before("block", "range_no")).alias("w1"), sum_("n_chars", before("block", "range_no")).alias("c1"))
    sums = inside.join(blocks, [*ITEM, "block"]).select(*ITEM, "range_no", (F.col("w0") + F.col("w1")).alias("word0"), (F.col("c0") + F.col("c1")).alias("char0"), "words", "chars")
    return table.join(sums, [*ITEM, "range_no"])


def split(cut: DataFrame, limits: Limits = Limits(), keep_small: bool = False, with_text: bool = True) -> DataFrame:
    """Pieces: item_kind, item_id, section_no, piece_no (int), start_pos, end_pos, n_words (bigint), text.

    A piece has at most limits.words words and begins with the limits.overlap last words of the one before. Positions
    count the item's characters; joined without their overlaps, the pieces' words are the item's. Items within the
    limit come out, as one piece, only with keep_small; empty texts then give one empty piece. Repeated items come once.
    Without texts only the offsets come, for who reads the pieces where they lie; end_pos is then the next word's beginning.
    """
    table = _counted(cut, limits, keep_small).dropDuplicates([*ITEM, "range_no"])
    table = table if with_text else table.drop("text")
    table = materialize(table, "ranges")
    placed = _stitched(table)
    if not keep_small:
        placed = placed.where(F.col("words") > limits.words)

    stride, slack, span = limits.stride, limits.slack, limits.words - limits.overlap

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, k_, level_, word_ = [], [], [], []
            # Each number k up to the item's last has a cut: its window lies within the item's words.
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            levels = cols["levels"]
            for r, (w0, total) in enumerate(zip(cols["word0"].to_pylist(), cols["words"].to_pylist())):
                v = np.asarray(levels[r].values.to_numpy(zero_copy_only=False)) if len(levels[r]) else np.empty(0, np.int8)
                for k in range(max(1, -(-w0 // stride)), (w0 + len(v) + slack) // stride + 1):
                    # words numbered (k * stride - slack, k * stride], as far as they lie here
                    a, b = max(k * stride - slack + 1, w0, 1), min(k * stride, w0 + len(v) - 1, total - 1)
                    if a > b or k * stride > total - 1:
                        continue
                    part = v[a - w0 : b - w0 + 1]
                    at = len(part) - 1 - int(part[::-1].argmax())
                    rows.append(r)
                    k_.append(k)
                    level_.append(int(part[at]))
                    word_.append(a + at)
            taken = batch.take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([*[taken.column(n) for n in (*ITEM, "words", "chars")], pa.array(k_, pa.int64()), pa.array(level_, pa.int32()), pa.array(word_, pa.int64())], names=[*ITEM, "words", "chars", "k", "level", "word"])

        return step

    found = map_batches(placed.select(*ITEM, "levels", "word0", "words", "chars"), "item_kind string, item_id string, section_no int, words bigint, chars bigint, k bigint, level int, word bigint", make)
    cuts = found.groupBy(*ITEM, "k").agg(F.max(F.struct("level", "word")).alias("c"), F.max("words").alias("words"), F.max("chars").alias("chars")).select(*ITEM, "k", F.col("c.word").alias("cut"), "words", "chars")
    if keep_small:
        cuts = cuts.where(F.col("words") > limits.words)
    heads = placed.where("range_no = 0").select(*ITEM, F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("cut"), "words", "chars")
    # Piece k lies from cut k to the next; a cut tells its neighbours by number, so that items needn't be gathered. The last
    # cut is left out if the piece before it may run to the end.
    told = heads.unionByName(cuts).withColumn("to", F.explode(F.array(*[F.struct((F.col("k") + d).alias("k"), F.lit(d).alias("d")) for d in (-1, 0, 1)])))
    told = told.groupBy(*ITEM, F.col("to.k").alias("k")).agg(*[F.max(F.when(F.col("to.d") == d, F.col("cut"))).alias(name) for name, d in (("cut", 0), ("prior", 1), ("next", -1))], F.max("words").alias("words"), F.max("chars").alias("chars")).where("cut is not null")
    last = (F.col("k") > 0) & (F.col("k") * stride <= F.col("words") - 1) & ((F.col("k") + 1) * stride > F.col("words") - 1)
    told = told.where(~last | (F.col("words") - F.col("prior") > span))
    over = ((F.col("k") + 1) * stride <= F.col("words") - 1) & ((F.col("k") + 2) * stride > F.col("words") - 1) & (F.col("words") - F.col("cut") <= span)  # the next is left out
    small = F.col("words") <= limits.words
    pieces = told.select(*ITEM, F.col("k").cast("int").alias("piece_no"), F.greatest(F.col("cut") - limits.overlap, F.lit(0)).alias("first"), F.when(over | small, F.col("words")).otherwise(F.coalesce("next", "words")).alias("stop"), "words", "chars")

    # Numbers of words to offsets: by buckets of numbers, so that an item of any size takes no more than equi-joins.
    pieces = materialize(pieces, "pieces")
    ends = pieces.select(*ITEM, "piece_no", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("first").alias("w")), F.struct(F.lit(1).alias("which"), F.col("stop").alias("w")))).alias("e")).select(*ITEM, "piece_no", "e.*").withColumn("bucket", F.floor(F.col("w") / 4096))
    covered = placed.where("n_words > 0").select(*ITEM, "starts", "word0", "char0", F.explode(F.sequence(F.floor(F.col("word0") / 4096), F.floor((F.col("word0") + F.col("n_words") - 1) / 4096))).alias("bucket"))
    skip = F.greatest(F.col("bucket") * 4096 - F.col("word0"), F.lit(0)).cast("int")  # a bucket gets its own words only
    upto = ((F.col("bucket") + 1) * 4096 - F.col("word0") - skip).cast("int")
    covered = covered.select(*ITEM, "bucket", "char0", F.slice("starts", skip + 1, upto).alias("starts"), (F.col("word0") + skip).alias("word0")).withColumn("n_words", F.size("starts"))
    offsets = ends.join(covered, [*ITEM, "bucket"]).where("w >= word0 and w < word0 + n_words").select(*ITEM, "piece_no", "which", (F.col("char0") + F.get("starts", (F.col("w") - F.col("word0")).cast("int"))).alias("at"))
    offsets = offsets.groupBy(*ITEM, "piece_no").agg(F.max(F.when(F.col("which") == 0, F.col("at"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("at"))).alias("b"))
    spans = pieces.join(offsets, [*ITEM, "piece_no"], "left").select(*ITEM, "piece_no", "first", "stop", F.coalesce("a", F.lit(0).cast("long")).alias("a"), F.coalesce("b", "chars").alias("b"))

    if not with_text:
        return spans.select(*ITEM, "piece_no", F.col("a").alias("start_pos"), F.col("b").alias("end_pos"), (F.col("stop") - F.col("first")).alias("n_words"))
    size = limits.range_chars
    wanted = spans.select("*", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor(F.greatest(F.col("a"), F.col("b") - 1) / size))).alias("bucket"))
    held = placed.select(*ITEM, "range_no", "text", "char0", "n_chars", F.explode(F.sequence(F.floor(F.col("char0") / size), F.floor(F.greatest(F.col("char0"), F.col("char0") + F.col("n_chars") - 1) / size))).alias("bucket"))
    parts = wanted.join(held, [*ITEM, "bucket"]).where("char0 < b and char0 + n_chars > a or (a = b and range_no = 0)")
    here = F.greatest(F.col("a") - F.col("char0"), F.lit(0))
    parts = parts.select(*ITEM, "piece_no", "first", "stop", "a", "range_no", F.substr("text", (here + 1).cast("int"), (F.least(F.col("b") - F.col("char0"), F.col("n_chars")) - here).cast("int")).alias("t")).distinct()
    joined = parts.groupBy(*ITEM, "piece_no", "first", "stop", "a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "t"))), lambda p: p["t"]), "").alias("t"))
    text = F.regexp_replace("t", r"(?U)[\s\x{1c}-\x{1f}]+$", "")
    return joined.select(*ITEM, "piece_no", F.col("a").alias("start_pos"), (F.col("a") + F.length(text)).alias("end_pos"), (F.col("stop") - F.col("first")).alias("n_words"), text.alias("text"))
