"""Helpers shared by the corpus operators: shared scratch tables, ranks without a single task, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word rule: space and the five control characters U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session without that setting gets a folder of its own;
    a cluster without it is an error, as its executors would write to disks that nobody else sees.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="terrakey-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/terrakey/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: lineage ends here, and a lost executor costs only the tasks that read its blocks."""
    path = written(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> str:
    """``df`` as a new table in the shared folder: its path."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of this library that nothing reads any more, through the file system that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Batches of few rows for what is run within, so that a task's memory does not follow the length of ten thousand texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str, per_bucket: int = 20_000) -> DataFrame:
    """Adds a gapless rank from 0 within ``keys``, without bringing a key's rows into one task.

    Rows are dealt into hash buckets of about ``per_bucket`` rows; a bucket's first rank is the sum of the sizes of
    the key's earlier buckets, and rows are numbered inside each bucket. ``df`` must give the same rows each time it is
    read (a stored table), since it is read once for the sizes and once for the rows. Nulls in keys form a key.
    """
    n = df.count()
    buckets = max(1, -(-n // per_bucket))
    b = f"_{rank}_b"
    df = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    by = [*keys, b]
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    right = sizes.select(*(F.col(k).alias(f"_r_{k}") for k in by), "_first")
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in by]
    numbered = df.withColumn("_in", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    out = numbered.join(right, on, "left")
    return out.withColumn(rank, F.col("_first") + F.col("_in")).drop(b, "_in", "_first", *(f"_r_{k}" for k in by))
