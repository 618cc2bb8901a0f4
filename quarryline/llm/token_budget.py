"""Problem 1: how many tokens each source, language and host provides.

The state is three tables: `counts` (content hash and tokenizer hash -> tokens),
`placed` (what each document last contributed) and `cube` (totals by slice). An
update hashes the current documents, encodes only contents whose hash the count
table doesn't have, and adds signed deltas to the cube: +1 for what is new or
changed, -1 for what was there before and for documents that are gone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import rank_file, received
from .common import map_batches, materialize, squeezed
from .encoding import BYTE_BPE_50K

UNKNOWN = "unknown"
SLICE = ["source", "lang", "host"]
#: Up to so many unseen contents their hashes (32 bytes each) are sent to the executors; beyond, a shuffled join.
BROADCAST_HASHES = 200_000


def clean_source(c: Column) -> Column:
    return F.coalesce(F.nullif(squeezed(c), F.lit("")), F.lit(UNKNOWN))


def clean_lang(c: Column) -> Column:
    """Primary subtag in lower case; `und`, empty and null are unknown."""
    tag = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(c.isNull() | (tag == "") | (tag == "und"), UNKNOWN).otherwise(tag)


def clean_host(c: Column) -> Column:
    """Host of a URL in lower case without user, port, a leading www. or m. and a final dot; unknown if there is none."""
    host = F.lower(F.regexp_extract(F.trim(c), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^(?:www|m)\.(?=[^.]+\.)", "")
    return F.coalesce(F.nullif(host, F.lit("")), F.lit(UNKNOWN))


#: Contents that a task remembers to have counted.
REMEMBERED = 1_000_000


@dataclass
class Ledger:
    """counts has what earlier updates counted, fresh what the last one did; their contents are different."""

    counts: DataFrame | None = None
    placed: DataFrame | None = None
    cube: DataFrame | None = None
    fresh: DataFrame | None = None

    def all_counts(self) -> DataFrame | None:
        parts = [x for x in (self.counts, self.fresh) if x is not None]
        return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else None


def save(ledger: Ledger, path: str, opened: str | None = None) -> None:
    """Writes a ledger down. Into the folder that it was opened from go the fresh counts only, beside a new state of the documents.

    The state that holds is the last one with its mark of success; counts that were appended before a failure do no harm.
    """
    if opened == path:
        ledger.fresh.write.mode("append").parquet(f"{path}/counts")
    else:
        ledger.all_counts().write.mode("overwrite").parquet(f"{path}/counts")
    spark = ledger.cube.sparkSession
    number = max(_states(spark, path), default=-1) + 1
    ledger.placed.write.mode("overwrite").parquet(f"{path}/state-{number}/placed")
    ledger.cube.write.mode("overwrite").parquet(f"{path}/state-{number}/cube")


def _states(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the states that are whole: the cube is written last."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [x.getPath() for x in fs.listStatus(root) if x.getPath().getName().startswith("state-")]
    return [int(x.getName()[6:]) for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.toString() + "/cube/_SUCCESS"))]


def open_ledger(spark: SparkSession, path: str) -> Ledger:
    """What was saved last; an empty ledger if nothing was."""
    states = _states(spark, path)
    if not states:
        return Ledger()
    counts = spark.read.parquet(f"{path}/counts").dropDuplicates(["h", "tokenizer"])
    return Ledger(counts, spark.read.parquet(f"{path}/state-{max(states)}/placed"), spark.read.parquet(f"{path}/state-{max(states)}/cube"))


def count_tokens(texts: DataFrame, text: str, path: str) -> DataFrame:
    """(h, n_tokens) of the texts; what a task has counted already it doesn't count again."""
    shared = texts.sparkSession.sparkContext.broadcast(rank_file(path))

    def make():
        t = received(shared.value)
        seen: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, counts = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(h)
                    hashes.append(h)
                    counts.append(t.count(text))
            return pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(counts, pa.int64())], names=["h", "n_tokens"])

        return step

    return map_batches(texts.select("h", text), "h binary, n_tokens bigint", make)


def _documents(articles: DataFrame) -> DataFrame:
    """Narrow rows of the latest version of each article: id, h, source, lang, host."""
    h = F.unhex(F.sha2(articles["content"], 256))
    rows = articles.select(
        F.coalesce(articles["article_id"].cast("string"), F.concat(F.lit("?"), F.sha2(F.concat_ws("\x1f", "url", "title", "content"), 256))).alias("id"),
        F.struct(articles["cleaned_at"].cast("timestamp").alias("at"), h.alias("h"), clean_source(articles["source"]).alias("source"), clean_lang(articles["lang"]).alias("lang"), clean_host(articles["url"]).alias("host")).alias("v"),
    )
    return rows.groupBy("id").agg(F.max("v").alias("v")).select("id", "v.h", *[f"v.{c}" for c in SLICE])


def update(ledger: Ledger, articles: DataFrame, path: str = BYTE_BPE_50K) -> Ledger:
    """The ledger after the documents have become `articles`.

    Each article_id counts once, with its version of the latest cleaned_at (null: the oldest; ties: the greater content
    hash); a row without id is an article by itself unless it repeats another. A null content has no tokens. Sources
    are trimmed, squeezed and lower-cased, languages cut to their primary subtag, hosts freed of scheme, case, www. and
    m.; what is missing is `unknown`. Extra columns are ignored. An empty table gives an empty cube, or takes all
    earlier documents out again.
    """
    mark = hashlib.sha256(rank_file(path)).hexdigest()[:16]
    now = materialize(_documents(articles), "documents")
    wanted = now.where("h is not null").select("h").distinct()
    texts = articles.where(articles["content"].isNotNull()).select(F.unhex(F.sha2("content", 256)).alias("h"), articles["content"].alias("t"))
    counts = ledger.all_counts()
    if counts is not None:
        unseen = materialize(wanted.join(counts.where(F.col("tokenizer") == mark), "h", "left_anti"), "unseen")
        few = unseen.count() <= BROADCAST_HASHES
        texts = texts.join(F.broadcast(unseen) if few else unseen, "h", "left_semi")
    fresh = materialize(count_tokens(texts, "t", path).groupBy("h").agg(F.max("n_tokens").alias("n_tokens")).withColumn("tokenizer", F.lit(mark)), "counts")
    counted = fresh if counts is None else counts.unionByName(fresh)
    priced = now.join(counted.where(F.col("tokenizer") == mark).select("h", "n_tokens"), "h", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    placed = materialize(priced.select("id", *SLICE, "n_tokens"), "placed")
    deltas = signed_deltas(ledger.placed, placed)
    cube = deltas if ledger.cube is None else deltas.unionByName(ledger.cube)
    cube = cube.groupBy(*SLICE).agg(F.sum("n_articles").alias("n_articles"), F.sum("n_tokens").alias("n_tokens")).where("n_articles <> 0")
    return Ledger(counts, placed, materialize(cube, "cube"), fresh)


def signed_deltas(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """Changes by slice from one state of the documents to the next; unchanged documents cancel before the sum."""
    plus = after.select("id", *SLICE, "n_tokens", F.lit(1).cast("long").alias("sign"))
    if before is None:
        rows = plus
    else:
        minus = before.select("id", *SLICE, "n_tokens", F.lit(-1).cast("long").alias("sign"))
        same = ["id", *SLICE, "n_tokens"]
        rows = plus.unionByName(minus).groupBy(*same).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    return rows.groupBy(*SLICE).agg(F.sum("sign").alias("n_articles"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))


def totals(cube: DataFrame) -> DataFrame:
    """The cube with its sub-totals: a column that is summed over holds `*`."""
    rolled = cube.cube(*SLICE).agg(F.sum("n_articles").alias("n_articles"), F.sum("n_tokens").alias("n_tokens"))
    return rolled.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in SLICE], "n_articles", "n_tokens")


def token_budget(spark: SparkSession, articles: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """source, lang, host, n_articles, n_tokens of one load into an empty ledger."""
    return update(Ledger(), articles, path).cube
