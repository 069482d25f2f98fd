"""Catalogues of scenes, and tables of results that are written once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_IMAGE = "struct<url: string, sensor: string, gsd_m: double, sun_elevation: double, sun_azimuth: double>"
CATALOGUE = (
    "generated_utc string, scenarios array<struct<id: string, title: string, provenance: string, challenge: string, notes: string, "
    f"image_a: {_IMAGE}, image_b: {_IMAGE}, ground_truth_homography: array<array<double>>>>"
)


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """One row for each scene of the catalogues (JSON objects) below ``path``; none where nothing was built there yet.

    Fields that a scene lacks are null, as is the known map ``h`` (nine entries, row by row) where there is none.
    """
    try:
        found = spark.read.schema(CATALOGUE).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CATALOGUE)
    return found.select("generated_utc", F.inline("scenarios")).withColumn("h", F.flatten("ground_truth_homography")).drop("ground_truth_homography")


def write_once(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Results as CSV with exactly these columns, in this order; a path that exists is an error, never overwritten.

    A column that the rows lack is empty; one that is not listed is left out.
    """
    have = {c.lower() for c in rows.columns}
    out = rows.select(*(F.col(f"`{c}`") if c.lower() in have else F.lit(None).cast("string").alias(c) for c in columns))
    out.write.mode("errorifexists").option("header", True).csv(path)


def write_matches(matches: DataFrame, path: str) -> None:
    """Correspondences (run, idx_a, xa, ya, idx_b, xb, yb, err) as Parquet by run, so that one run is read alone; written once.

    Rows are dealt by run and a hash of the index, so a run with very many matches is several tasks' work.
    """
    part = F.pmod(F.xxhash64("idx_a"), F.lit(16))
    matches.select("run", "idx_a", "xa", "ya", "idx_b", "xb", "yb", "err").repartition("run", part).write.mode("errorifexists").partitionBy("run").parquet(path)
