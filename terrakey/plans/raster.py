"""Queries on rasters in long form (tile, x, y, v), made from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.operators import raster as ops
from terrakey.plans.common import Registry, r, table

query = Registry()
SIDE = 64


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 64 x 64 cells of mean order prices; cells without an order have no row."""
    o = table(spark, sf_dir, "orders")
    tile = F.floor(F.col("o_orderkey") / SIDE) % 4
    return o.groupBy(tile.alias("tile"), (F.col("o_orderkey") % SIDE).alias("x"), (F.col("o_custkey") % SIDE).alias("y")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_linenumber").alias("band"), (F.col("l_orderkey") % SIDE).alias("x"), (F.col("l_partkey") % SIDE).alias("y")).agg(F.round(F.avg("l_extendedprice"), 4).alias("v"))


_P = "WITH px AS (SELECT CAST(floor(o_orderkey / 64) AS BIGINT) % 4 AS tile, o_orderkey % 64 AS x, o_custkey % 64 AS y, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY ALL)"
_B = "WITH bd AS (SELECT l_linenumber AS band, l_orderkey % 64 AS x, l_partkey % 64 AS y, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY ALL)"
_U = """, lim AS (SELECT tile, round(quantile_cont(v, 0.01), 6) AS lo, round(quantile_cont(v, 0.99), 6) AS hi, min(v) AS vmin, max(v) AS vmax FROM px GROUP BY tile),
u AS (SELECT tile, x, y, CASE WHEN hi > lo THEN CAST(floor(least(greatest((v - lo) / (hi - lo), 0), 1) * 255) AS INTEGER) WHEN vmax > vmin THEN CAST(floor(least(greatest((v - vmin) / (vmax - vmin), 0), 1) * 255) AS INTEGER) ELSE 0 END AS u FROM px JOIN lim USING (tile))"""
_T = """, f AS (SELECT g.tile, g.x, g.y, coalesce(u, 0) AS u FROM (SELECT tile, x, y FROM (SELECT DISTINCT tile FROM px), (SELECT unnest(range(0, 64)) AS x), (SELECT unnest(range(0, 64)) AS y)) g LEFT JOIN u USING (tile, x, y)),
gr AS (SELECT tile, CASE WHEN lag(u) OVER wx IS NULL THEN lead(u) OVER wx - u WHEN lead(u) OVER wx IS NULL THEN u - lag(u) OVER wx ELSE (lead(u) OVER wx - lag(u) OVER wx) / 2.0 END AS gx,
  CASE WHEN lag(u) OVER wy IS NULL THEN lead(u) OVER wy - u WHEN lead(u) OVER wy IS NULL THEN u - lag(u) OVER wy ELSE (lead(u) OVER wy - lag(u) OVER wy) / 2.0 END AS gy
  FROM f WINDOW wx AS (PARTITION BY tile, y ORDER BY x), wy AS (PARTITION BY tile, x ORDER BY y)),
tx AS (SELECT tile, avg(sqrt(gx * gx + gy * gy)) AS texture FROM gr GROUP BY tile), us AS (SELECT tile, avg(CASE WHEN u > 4 AND u < 252 THEN 1.0 ELSE 0.0 END) AS usable FROM f GROUP BY tile)"""


@query(f"{_P}{_U} SELECT tile, x, y, u FROM u")
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.to_uint8(pixels(spark, sf_dir))


@query(f"{_P}{_U}{_T} SELECT tile, round(usable, 6) AS usable FROM us")
def usable_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.usable_fraction(ops.filled(ops.to_uint8(pixels(spark, sf_dir)), SIDE, SIDE)).select("tile", r("usable").alias("usable"))


@query(f"{_P}{_U}{_T} SELECT tile, round(texture, 6) AS texture FROM tx")
def texture_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.texture_score(ops.filled(ops.to_uint8(pixels(spark, sf_dir)), SIDE, SIDE)).select("tile", r("texture").alias("texture"))


@query(f"{_P}{_U}{_T} SELECT tile, CASE WHEN usable < 0.55 THEN 'unusable' WHEN texture < 3 THEN 'flat' ELSE 'good' END AS quality FROM us JOIN tx USING (tile)")
def tile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tile_quality(ops.filled(ops.to_uint8(pixels(spark, sf_dir)), SIDE, SIDE))


@query(f"{_P}{_U} SELECT tile, round(avg(u), 4) AS mean, round(stddev_pop(u), 4) AS std, round(avg(CASE WHEN u > 10 THEN 0.0 ELSE 1.0 END), 4) AS shadow_fraction FROM u GROUP BY tile")
def shadow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    return ops.to_uint8(pixels(spark, sf_dir)).groupBy("tile").agg(r(F.avg(u), 4).alias("mean"), r(F.stddev_pop(u), 4).alias("std"), r(F.avg((u <= 10).cast("int")), 4).alias("shadow_fraction"))


@query(f"{_B} SELECT a.band AS band, CASE WHEN count(*) >= 1000 THEN round(corr(a.v, b.v), 6) END AS ncc FROM bd a JOIN bd b ON a.x = b.x AND a.y = b.y AND b.band = 1 GROUP BY a.band")
def ncc_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each band with the first, over cells that both have; null below 1000 cells."""
    b = bands(spark, sf_dir)
    first = b.where("band = 1").select("x", "y", F.col("v").alias("w"))
    return ops.masked_ncc(b.join(first, ["x", "y"]), ["band"], "v", "w").select("band", r("ncc").alias("ncc"))


@query(f"{_B} SELECT x, y, round(avg(v), 6) AS v FROM bd WHERE band >= 2 AND band < 5 GROUP BY x, y")
def band_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of bands 2 to 4 (half-open to 5)."""
    return ops.band_mean(bands(spark, sf_dir), 2, 5).select("x", "y", r("v", 6).alias("v"))


@query(f"{_B}, two AS (SELECT a.x, a.y, a.v AS va, b.v AS vb FROM bd a JOIN bd b ON a.x = b.x AND a.y = b.y AND a.band = 1 AND b.band = 2) SELECT x, y, CASE WHEN (y // 8 + x // 8) % 2 = 0 THEN va ELSE vb END AS v, va AS red, vb AS green, vb AS blue FROM two")
def checkerboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternate cells of two bands, and the false-colour overlay of both."""
    b = bands(spark, sf_dir)
    two = b.where("band = 1").select("x", "y", F.col("v").alias("va")).join(b.where("band = 2").select("x", "y", F.col("v").alias("vb")), ["x", "y"])
    even = (F.floor(F.col("y") / 8) + F.floor(F.col("x") / 8)) % 2 == 0
    return two.select("x", "y", F.when(even, F.col("va")).otherwise(F.col("vb")).alias("v"), F.col("va").alias("red"), F.col("vb").alias("green"), F.col("vb").alias("blue"))


@query(f"{_B} SELECT x, y, CAST(round_even(0.114 * max(v) FILTER (WHERE band = 1) + 0.587 * max(v) FILTER (WHERE band = 2) + 0.299 * max(v) FILTER (WHERE band = 3), 0) AS BIGINT) AS gray FROM bd WHERE band <= 3 GROUP BY x, y HAVING count(*) = 3")
def gray_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sum of blue, green and red (bands 1 to 3) of cells that have all three."""
    b = bands(spark, sf_dir).where("band <= 3").groupBy("x", "y").agg(*(F.max(F.when(F.col("band") == i, F.col("v"))).alias(n) for i, n in ((1, "b"), (2, "g"), (3, "r"))))
    gray = F.bround(0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r")).cast("long")
    return b.where("b is not null and g is not null and r is not null").select("x", "y", gray.alias("gray"))


@query(f"{_P} SELECT tile, x // 4 AS x, y // 4 AS y, round(avg(v), 6) AS v FROM px GROUP BY ALL")
def area_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block means over 4 x 4 cells."""
    return ops.area_resize(pixels(spark, sf_dir), 4).select("tile", "x", "y", r("v", 6).alias("v"))


@query(f"""{_P}, m AS (SELECT tile, arg_max(struct_pack(x := x, y := y), struct_pack(v := v, a := -x, b := -y)) AS p, max(v) AS peak, avg(v) AS mean, stddev_pop(v) AS std FROM px GROUP BY tile),
q AS (SELECT px.tile, max(CASE WHEN pow(px.x - p.x, 2) + pow(px.y - p.y, 2) <= 64 THEN 0 ELSE v END) AS runner FROM px JOIN m USING (tile) GROUP BY px.tile)
SELECT tile, p.x AS peak_x, p.y AS peak_y, round(peak, 4) AS peak, round(peak / runner, 6) AS ratio, round((peak - mean) / std, 6) AS z FROM m JOIN q USING (tile)""")
def peak_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak of a correlation surface, against the best value outside its disc and against the spread."""
    return ops.peak_ambiguity(pixels(spark, sf_dir), 8).select("tile", "peak_x", "peak_y", r("peak", 4).alias("peak"), r("ratio").alias("ratio"), r("z").alias("z"))
