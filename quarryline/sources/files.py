"""JSON articles and catalogues in, tables out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import numbered

ARTICLE = "title string, url string, source string, content string"


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file, in any depth of folders: title, url, source, content, source_dir (the file's folder) and file.

    Broken files give a row of nulls with their name, so that they can be counted.
    """
    rows = spark.read.schema(ARTICLE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").json(path)
    file = F.col("_metadata.file_path")
    return rows.select("*", F.element_at(F.split(file, "/"), -2).alias("source_dir"), file.alias("file"))


def stream_articles(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream: each file once, by the checkpoint of the query that reads it."""
    return spark.readStream.schema(ARTICLE).option("multiLine", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).json(path)


def write_articles(df: DataFrame, path: str, by: str = "source_dir", mode: str = "overwrite") -> None:
    """JSON lines in a folder for each value of `by`; committed as a whole."""
    df.write.mode(mode).partitionBy(by).json(path)


def in_file_order(rows: DataFrame) -> DataFrame:
    """Adds file_no: the rows of read_articles in the order of their files' paths, from 0."""
    return numbered(rows, ["file"], "file_no")


def write_points(df: DataFrame, path: str, dry_run: bool = False) -> int:
    """Writes a table and gives its number of rows; a dry run only counts."""
    if not dry_run:
        df.write.mode("overwrite").parquet(path)
        df = df.sparkSession.read.parquet(path)
    return df.count()


def replace_table(df: DataFrame, path: str) -> None:
    """Puts df in the place of a table as a whole: it is written beside it first, and a failure before the rename leaves the old one."""
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    target, source = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, aside))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"could not put {aside} in the place of {path}")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
