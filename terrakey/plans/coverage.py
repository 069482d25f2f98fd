"""Queries on coverage: events as inlier points of a 500 x 500 image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.functions.scoring import coverage_class, uniformity_label
from terrakey.operators import coverage as ops
from terrakey.plans import matching
from terrakey.plans.common import Registry, r, table
from terrakey.plans.matching import _AB, _XY

query = Registry()
SIDE = 500.0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("run"), (F.col("value") % SIDE).cast("double").alias("x"), (F.col("event_id") % 500).cast("double").alias("y"), (F.col("value") / 500).alias("weight"))


def _cells(grid: int) -> str:
    return f"""WITH p AS (SELECT event_type AS run, (value % 500)::DOUBLE AS x, (event_id % 500)::DOUBLE AS y, value / 500 AS weight FROM events),
c AS (SELECT run, greatest(least(CAST(floor(x / 500 * {grid}) AS INTEGER), {grid - 1}), 0) AS cx, greatest(least(CAST(floor(y / 500 * {grid}) AS INTEGER), {grid - 1}), 0) AS cy, count(*) AS n, sum(weight) AS w FROM p GROUP BY ALL)"""


@query(f"{_cells(4)}, t AS (SELECT run, sum(n) AS total FROM c GROUP BY run) SELECT run, round(sum(least(n / (total / 16), 1)) / 16, 6) AS uniformity FROM c JOIN t USING (run) GROUP BY run")
def uniformity_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.uniformity_even(points(spark, sf_dir), ["run"], SIDE, SIDE).select("run", r("uniformity").alias("uniformity"))


@query(f"{_cells(4)} SELECT run, round(count(*) / 16, 4) AS unif_cells FROM c GROUP BY run")
def uniformity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.uniformity_cells(points(spark, sf_dir), ["run"], SIDE, SIDE).select("run", r("unif_cells", 4).alias("unif_cells"))


#: Width and height of the image of the density queries, and the reach of their blur: half of round(8 sigma + 1), made odd.
WIDE, HIGH = 131, 96
_SIGMA = 0.04 * WIDE
_REACH = (round(8 * _SIGMA + 1) | 1) // 2
_DENSITY = f"""WITH p AS (SELECT event_type AS run, greatest(least(value, {WIDE - 1}), 0)::DOUBLE AS x, event_id % 100 AS y, value / 500 AS weight FROM events),
z AS (SELECT run, CAST(floor(x) AS INTEGER) AS px, CAST(least(y, {HIGH - 1}) AS INTEGER) AS py, sum(weight) AS v FROM p GROUP BY ALL),
k AS (SELECT i, exp(-0.5::DOUBLE * pow(i / {_SIGMA}, 2)) AS g FROM (SELECT unnest(range(-{_REACH}, {_REACH + 1})) AS i)),
n AS (SELECT i, g / (SELECT sum(g) FROM k) AS g FROM k),
mx AS (SELECT q AS px, CASE WHEN q + i < 0 THEN -(q + i) WHEN q + i > {WIDE - 1} THEN 2 * {WIDE - 1} - q - i ELSE q + i END AS source, sum(g) AS g FROM (SELECT unnest(range(0, {WIDE})) AS q), n GROUP BY ALL),
my AS (SELECT q AS py, CASE WHEN q + i < 0 THEN -(q + i) WHEN q + i > {HIGH - 1} THEN 2 * {HIGH - 1} - q - i ELSE q + i END AS source, sum(g) AS g FROM (SELECT unnest(range(0, {HIGH})) AS q), n GROUP BY ALL),
a AS (SELECT run, py, mx.px, sum(v * g) AS v FROM z JOIN mx ON z.px = mx.source GROUP BY ALL),
b AS (SELECT run, px, my.py, sum(v * g) AS v FROM a JOIN my ON a.py = my.source GROUP BY ALL),
t AS (SELECT run, max(v) AS peak FROM b GROUP BY run),
c AS (SELECT run, py // {HIGH // 8} AS row, px // {WIDE // 8} AS col, sum(v / peak) / {(HIGH // 8) * (WIDE // 8)} AS density FROM b JOIN t USING (run) WHERE py < {HIGH // 8 * 8} AND px < {WIDE // 8 * 8} GROUP BY ALL),
e AS (SELECT r.run, y.row, x.col, coalesce(density, 0) AS density FROM (SELECT DISTINCT run FROM z) r, (SELECT unnest(range(0, 8)) AS row) y, (SELECT unnest(range(0, 8)) AS col) x LEFT JOIN c ON c.run = r.run AND c.row = y.row AND c.col = x.col)"""


def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("value").cast("double").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), (F.col("value") / 500).alias("weight"))
    return ops.density_cells(e, "run", WIDE, HIGH)


@query(f"{_DENSITY} SELECT run, row, col, col * {WIDE // 8} AS x, row * {HIGH // 8} AS y, round(density, 4) AS density, CASE WHEN density > 0.40 THEN 'high' WHEN density > 0.12 THEN 'medium' ELSE 'low' END AS class FROM e")
def density_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the blurred, weighted point density with their class."""
    return densities(spark, sf_dir).select("run", "row", "col", "x", "y", r("density", 4).alias("density"), coverage_class(F.col("density")).alias("class"))


@query(f"{_DENSITY} SELECT run, count(*) FILTER (WHERE density > 0.40) AS n_high, round(count(*) FILTER (WHERE density > 0.40) / 64, 4) AS coverage FROM e GROUP BY run")
def density_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cells with a high density."""
    high = F.count_if(coverage_class(F.col("density")) == "high")
    return densities(spark, sf_dir).groupBy("run").agg(high.alias("n_high"), r(high / F.count(F.lit(1)), 4).alias("coverage"))


@query(f"{_cells(4)}, t AS (SELECT run, sum(n) AS total FROM c GROUP BY run), u AS (SELECT run, sum(least(n / (total / 16), 1)) / 16 AS u FROM c JOIN t USING (run) GROUP BY run) SELECT run, CASE WHEN u > 0.70 THEN 'excellent' WHEN u > 0.50 THEN 'good' WHEN u > 0.30 THEN 'fair' ELSE 'poor' END AS label FROM u")
def coverage_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ops.uniformity_even(points(spark, sf_dir), ["run"], SIDE, SIDE)
    return u.select("run", uniformity_label(F.col("uniformity")).alias("label"))


@query("WITH p AS (SELECT event_id, value AS x, event_id % 700 AS y FROM events) SELECT event_id, round(x, 6) AS x, CAST(y AS BIGINT) AS y FROM p WHERE x >= 0 AND x < 400 AND y >= 0 AND y < 500")
def matched_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within the image."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"), (F.col("event_id") % 700).cast("long").alias("y"))
    return e.where((F.col("x") >= 0) & (F.col("x") < 400) & (F.col("y") >= 0) & (F.col("y") < 500)).select("event_id", r("x").alias("x"), "y")


@query(f"{_AB}{_XY} SELECT run, idx_a, round(xa, 6) AS x, round(ya, 6) AS y, round(least(greatest(1 - d1 / d2, 0), 1), 6) AS confidence FROM e WHERE err <= 0.5")
def inlier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the inliers of a run lie in its first image: its matches joined with its keypoints; a match without a keypoint gives none."""
    a, _ = matching.keypoints(spark, sf_dir)
    kept = matching.residuals(spark, sf_dir).where("err <= 0.5").select("run", "idx_a", "confidence")
    return ops.matched_points(a, kept).select("run", "idx_a", r("x").alias("x"), r("y").alias("y"), r("confidence").alias("confidence"))


@query()
def hull_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hull_area(points(spark, sf_dir), "run", SIDE, SIDE).select("run", r("hull", 4).alias("hull"))
