"""Stored runs and catalogues: retention, lookup, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what an identifier may look like.
IDENTIFIER = r"^[A-Za-z0-9_.-]{1,128}$"


def latest(rows: DataFrame, by: list[str], order: list[str], keep: int) -> DataFrame:
    """The last ``keep`` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_r", rank).where(F.col("_r") <= keep).drop("_r")


def one(rows: DataFrame, column: str, identifier: str) -> DataFrame:
    """Rows with an identifier; one that is not well-formed is an error before anything is read."""
    import re

    if not re.match(IDENTIFIER, identifier):
        raise ValueError(f"not an identifier: {identifier!r}")
    return rows.where(F.col(column) == identifier)


def merged(old: DataFrame, new: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Old rows of other families with the new rows of the named ones; columns that only one side has are null on the other."""
    return old.where(~F.col(column).isin(values)).unionByName(new.where(F.col(column).isin(values)), allowMissingColumns=True)
