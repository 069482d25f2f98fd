"""Rounds of iterative operators: each one's result is checkpointed, so plans stay short and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Rows, and bytes of images and arrays in them, that leave a task together.
ROWS, BYTES = 64, 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, of ``spark.checkpoint.dir``; only a local session without it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rounds-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tasks(items: int, few: int = 4, most: int = 64) -> int:
    """Tasks for heavy items on few bytes: ``few`` items in each where that keeps all cores busy, up to ``most`` of many.

    Blocks of a shuffle are the product of its tasks on both sides, so tasks that grow as fast as the items would let them grow with the square.
    """
    return max(1, min(-(-items // few), max(512, -(-items // most))))


def framed(rows: Iterable[dict], columns: Sequence[str], dtype: object = None) -> Iterator[pd.DataFrame]:
    """Rows as data frames of some rows each: a frame for every row would take as long as what is in it."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(v.nbytes if isinstance(v, np.ndarray) else len(v) for v in row.values() if isinstance(v, (bytes, np.ndarray)))
        if len(held) >= ROWS or size > BYTES:
            yield pd.DataFrame(held, columns=columns, dtype=dtype)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=dtype)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Without that setting a local session takes a folder of its own; on a cluster it is an error, as executors share no such folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
