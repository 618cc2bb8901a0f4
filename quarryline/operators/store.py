"""Tables on a shared folder: intermediate ones, collections of points, and keyed state."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset a temporary one (local runs only)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="quarryline-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_written: list[str] = []


def clean_up(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this process has written, and gives their number. Nothing that was made of them may be used afterwards."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: worked out once, and there for a lost executor's tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


# Collections --------------------------------------------------------------------------------------------------------


class MissingCollection(LookupError):
    """Names the collections that there are."""


@dataclass(frozen=True)
class Collections:
    """Collections of points under one folder. A collection is a folder of generations and a pointer to the one that holds.

    A new generation is written as a whole before the pointer moves to it by a rename, so that readers see one or the
    other and a job that fails leaves the old one standing.
    """

    spark: SparkSession
    root: str

    def names(self) -> list[str]:
        fs, root = _path(self.spark, self.root)
        return sorted(x.getPath().getName() for x in fs.listStatus(root) if self._current(x.getPath().getName())) if fs.exists(root) else []

    def _current(self, name: str) -> str | None:
        fs, folder = _path(self.spark, f"{self.root}/{name}")
        if not fs.exists(folder):
            return None
        marks = sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().startswith("current-"))
        return marks[-1].split("-", 2)[2] if marks else None

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def create(self, name: str, schema: str, mode: str = "upsert") -> None:
        """mode clean drops what there is, upsert creates the collection only if it is missing."""
        if mode not in ("clean", "upsert"):
            raise ValueError(f"no mode {mode!r}; there are clean and upsert")
        if mode == "clean" or not self.exists(name):
            self._publish(name, self.spark.createDataFrame([], schema))

    def read(self, name: str) -> DataFrame:
        generation = self._current(name)
        if generation is None:
            raise MissingCollection(f"no collection {name!r}; there are {self.names()}")
        return self.spark.read.parquet(f"{self.root}/{name}/{generation}")

    def _publish(self, name: str, df: DataFrame) -> None:
        old, generation = self._current(name), f"g{uuid.uuid4().hex}"
        folder = f"{self.root}/{name}"
        fs, mark = _path(self.spark, f"{folder}/.mark-{generation}")
        df.write.parquet(f"{folder}/{generation}")
        fs.create(mark).close()
        number = 1 + max((int(x.getPath().getName().split("-")[1]) for x in fs.listStatus(_path(self.spark, folder)[1]) if x.getPath().getName().startswith("current-")), default=0)
        if not fs.rename(mark, _path(self.spark, f"{folder}/current-{number:012d}-{generation}")[1]):
            raise OSError(f"could not publish {folder}/{generation}")
        for x in fs.listStatus(_path(self.spark, folder)[1]):  # what no longer holds; the generation before stays for readers that have it open
            n = x.getPath().getName()
            if n.startswith("current-") and not n.endswith(generation):
                fs.delete(x.getPath(), True)
            elif n.startswith("g") and n not in (generation, old):
                fs.delete(x.getPath(), True)

    def upsert(self, name: str, points: DataFrame, key: str = "point_id", dry_run: bool = False) -> DataFrame:
        """Puts the points in, replacing stored ones of the same key; gives (state, n): new, updated and kept.

        Points come once a key, else any one of them is taken. A dry run counts only.
        """
        stored = self.read(name)
        fresh = points.where(F.col(key).isNotNull()).dropDuplicates([key]).select(*stored.columns)
        kept = stored.join(fresh.select(key), key, "left_anti").select(*stored.columns)
        counts = (
            stored.select(key, F.lit(1).alias("s")).join(fresh.select(key, F.lit(1).alias("f")), key, "full_outer")
            .select(F.when(F.col("s").isNull(), "new").when(F.col("f").isNull(), "kept").otherwise("updated").alias("state")).groupBy("state").agg(F.count("*").alias("n"))
        )
        counts = materialize(counts, "counts")
        if not dry_run:
            self._publish(name, kept.unionByName(fresh))
        return counts

    def lookup(self, name: str, ids: DataFrame, key: str = "point_id", without: tuple[str, ...] = ("vector",)) -> DataFrame:
        """The points of the given keys, without their vectors."""
        return looked_up(self.read(name), ids, key, without)

    def scroll(self, name: str, first: int | None = None, key: str = "point_id") -> DataFrame:
        """All points, or the first by key."""
        return scrolled(self.read(name), first, key)


def looked_up(points: DataFrame, ids: DataFrame, key: str = "point_id", without: tuple[str, ...] = ("vector",)) -> DataFrame:
    """The points of the given keys, without their vectors."""
    kept = points.drop(*without)
    return kept.join(ids.select(key).distinct(), key, "left_semi").select(*kept.columns)


def scrolled(points: DataFrame, first: int | None = None, key: str = "point_id") -> DataFrame:
    """All points, or the first by key."""
    return points if first is None else points.orderBy(key).limit(first)


def collection_stats(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(collection, n, n_ids) of each named table with its key."""
    parts = [df.agg(F.count("*").alias("n"), F.count_distinct(F.col(key)).alias("n_ids")).select(F.lit(name).alias("collection"), "n", "n_ids") for name, (df, key) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def outcome_counts(rows: DataFrame, status: Column) -> DataFrame:
    """One row of total, processed, skipped and failed, by a status of these names; any other one is in the total only."""
    return rows.select(status.alias("s")).agg(F.count("*").alias("total"), *[F.count_if(F.col("s") == s).alias(s) for s in ("processed", "skipped", "failed")])


# Keyed state --------------------------------------------------------------------------------------------------------


def state_now(log: DataFrame) -> DataFrame:
    """(namespace, key, value) that holds after a log of (namespace, key, value, at, deleted): the last entry of each key, if it puts something.

    value is JSON; ties of time go to the greater value, deletions last. The latest entry is an aggregate, so that a key
    with very many entries costs a row a task. Null namespaces or keys are left out.
    """
    last = log.where("namespace is not null and key is not null").groupBy("namespace", "key").agg(F.max(F.struct("at", F.coalesce("deleted", F.lit(False)).alias("gone"), "value")).alias("v"))
    return last.where("not v.gone").select("namespace", "key", "v.value")


def state_list(state: DataFrame, namespace: str, **equal: str) -> DataFrame:
    """(key, value) of one namespace whose JSON values have the given texts in the given fields."""
    rows = state.where(F.col("namespace") == namespace)
    for field, value in equal.items():
        rows = rows.where(F.get_json_object("value", f"$.{field}") == value)
    return rows.select("key", "value")


def state_get(state: DataFrame, namespace: str, keys: DataFrame) -> DataFrame:
    """(key, value) of the keys asked for; value is null where there is none."""
    rows = state.where(F.col("namespace") == namespace).select("key", "value")
    return keys.select("key").distinct().join(rows, "key", "left")


def listed(rows: DataFrame, **equal) -> DataFrame:
    """Rows that have the given values in the given columns."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows
