"""Queries on projective maps made from parts: one map per part key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.functions import homography as hg
from terrakey.plans.common import Registry, r, table

query = Registry()
WIDTH = HEIGHT = 1024.0


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, scale, degrees, dx, dy, h): a similarity about the middle of a 1024 x 1024 image, slightly tilted."""
    k = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select(k.alias("id"), (0.9 + k % 20 * 0.01).alias("scale"), (k % 90 - 45.0).alias("degrees"), (k % 41 - 20.0).alias("dx"), (k % 31 - 15.0).alias("dy"))
    h = hg.similarity(F.col("scale"), F.col("degrees"), F.col("dx"), F.col("dy"), F.lit(WIDTH), F.lit(HEIGHT))
    return df.withColumn("h", F.array(*hg.with_tilt(h, (F.col("id") % 5) * 1e-6)))


_M = """WITH p AS (SELECT p_partkey AS id, 0.9::DOUBLE + (p_partkey % 20) * 0.01::DOUBLE AS s, radians((p_partkey % 90) - 45.0::DOUBLE) AS t, (p_partkey % 41) - 20.0::DOUBLE AS dx, (p_partkey % 31) - 15.0::DOUBLE AS dy, (p_partkey % 5) * 1e-6::DOUBLE AS tilt FROM part),
q AS (SELECT *, s * cos(t) AS c, s * sin(t) AS n FROM p),
m AS (SELECT id, c AS h0, -n AS h1, 512 - c * 512 + n * 512 + dx AS h2, n AS h3, c AS h4, 512 - n * 512 - c * 512 + dy AS h5, tilt AS h6, 0.4::DOUBLE * tilt AS h7, 1.0::DOUBLE AS h8 FROM q),
k AS (SELECT *, (h4 * h8 - h5 * h7) AS a0, (h2 * h7 - h1 * h8) AS a1, (h1 * h5 - h2 * h4) AS a2, (h5 * h6 - h3 * h8) AS a3, (h0 * h8 - h2 * h6) AS a4, (h2 * h3 - h0 * h5) AS a5, (h3 * h7 - h4 * h6) AS a6, (h1 * h6 - h0 * h7) AS a7, (h0 * h4 - h1 * h3) AS a8,
  h0 * (h4 * h8 - h5 * h7) - h1 * (h3 * h8 - h5 * h6) + h2 * (h3 * h7 - h4 * h6) AS det FROM m)"""


@query(f"{_M} SELECT id, round(h0, 9) AS h0, round(h1, 9) AS h1, round(h2, 6) AS h2, round(h3, 9) AS h3, round(h4, 9) AS h4, round(h5, 6) AS h5, round(h6, 9) AS h6, round(h7, 9) AS h7 FROM m")
def similarity_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity and perspective maps about the middle."""
    h = hg.entries(F.col("h"))
    return maps(spark, sf_dir).select("id", *(r(h[i], 6 if i in (2, 5) else 9).alias(f"h{i}") for i in range(8)))


@query(f"{_M}, pts AS (SELECT *, (id * 37) % 1024 AS x, (id * 91) % 1024 AS y FROM m) SELECT id, round((h0 * x + h1 * y + h2) / (h6 * x + h7 * y + h8), 6) AS x, round((h3 * x + h4 * y + h5) / (h6 * x + h7 * y + h8), 6) AS y FROM pts")
def homography_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = hg.apply(hg.entries(F.col("h")), (F.col("id") * 37) % 1024, (F.col("id") * 91) % 1024)
    return maps(spark, sf_dir).select("id", r(x).alias("x"), r(y).alias("y"))


@query(f"{_M} SELECT id, round(a0 / det, 6) AS i0, round(a1 / det, 6) AS i1, round(a2 / det, 4) AS i2, round(a3 / det, 6) AS i3, round(a4 / det, 6) AS i4, round(a5 / det, 4) AS i5, round(det, 6) AS det FROM k")
def homography_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hg.entries(F.col("h"))
    i = hg.inverse(h)
    return maps(spark, sf_dir).select("id", *(r(i[j], 4 if j in (2, 5) else 6).alias(f"i{j}") for j in range(6)), r(hg.determinant(h)).alias("det"))


@query(f"""{_M} SELECT id, round(sqrt(h0 * h0 + h3 * h3), 6) AS scale_x, round(sqrt(h1 * h1 + h4 * h4), 6) AS scale_y, round(degrees(atan2(h3, h0)), 6) AS rotation_deg,
round(degrees(atan2(h0 * h1 + h3 * h4, h0 * h4 - h1 * h3)), 6) AS shear_deg, round(h2, 6) AS tx, round(h5, 6) AS ty, round(h6, 9) AS perspective_x, round(h7, 9) AS perspective_y FROM m""")
def homography_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hg.decompose(hg.entries(F.col("h")))
    return maps(spark, sf_dir).select("id", *(r(c, 9 if k.startswith("persp") else 6).alias(k) for k, c in d.items()))


@query(f"""{_M}, c AS (SELECT id, j, CASE WHEN j IN (1, 3) THEN 1023 ELSE 0 END AS x, CASE WHEN j >= 2 THEN 1023 ELSE 0 END AS y, h0, h1, h2, h3, h4, h5, h6, h7, h8 FROM m, (SELECT unnest(range(0, 4)) AS j)),
e AS (SELECT id, sqrt(pow((h0 * x + h1 * y + h2) / (h6 * x + h7 * y + h8) - (x + id % 41 - 20), 2) + pow((h3 * x + h4 * y + h5) / (h6 * x + h7 * y + h8) - (y + id % 31 - 15), 2)) AS err FROM c)
SELECT id, round(avg(err), 6) AS mean_px, round(max(err), 6) AS max_px FROM e GROUP BY id""")
def corner_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest distance of the image's corners between a map and the pure shift that it contains."""
    corners = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for y in (0.0, HEIGHT - 1) for x in (0.0, WIDTH - 1))))
    df = maps(spark, sf_dir).withColumn("c", corners)
    x, y = hg.apply(hg.entries(F.col("h")), F.col("c.x"), F.col("c.y"))
    err = F.hypot(x - (F.col("c.x") + F.col("dx")), y - (F.col("c.y") + F.col("dy")))
    return df.select("id", err.alias("e")).groupBy("id").agg(r(F.avg("e")).alias("mean_px"), r(F.max("e")).alias("max_px"))


@query(f"""{_M}, g AS (SELECT k.*, i * 1023 / 15.0::DOUBLE AS qx, j * 1023 / 15.0::DOUBLE AS qy FROM k, (SELECT unnest(range(0, 16)) AS i), (SELECT unnest(range(0, 16)) AS j)),
e AS (SELECT id, sqrt(pow((a0 * qx + a1 * qy + a2) / (a6 * qx + a7 * qy + a8) - (qx - (id % 41 - 20)), 2) + pow((a3 * qx + a4 * qy + a5) / (a6 * qx + a7 * qy + a8) - (qy - (id % 31 - 15)), 2)) AS d FROM g)
SELECT id, round(avg(d), 6) AS grid_px FROM e GROUP BY id""")
def grid_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance over a 16 x 16 grid of the second image between two maps' origins of each grid point.

    The inverse is taken once a map; grid points are made and summed again in one stage, so a row a map is shuffled.
    """
    i = hg.inverse(hg.entries(F.col("h")))
    df = maps(spark, sf_dir).select("id", "dx", "dy", *(x.alias(f"i{j}") for j, x in enumerate(i)), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("n"))
    n = F.col("n")
    away = _away([F.col(f"i{j}") for j in range(9)], F.floor(n / 16) * 1023 / 15.0, (n % 16) * 1023 / 15.0)
    return df.select("id", away.alias("d")).groupBy("id").agg(r(F.avg("d")).alias("grid_px"))


def _away(i: hg.H, x: F.Column, y: F.Column) -> F.Column:
    ax, ay = hg.apply(i, x, y)
    return F.hypot(ax - (x - F.col("dx")), ay - (y - F.col("dy")))


@query(f"{_M} SELECT id, round(h0 * 2, 9) AS h0, round(h2 * 2, 6) AS h2, round(h5 * 2, 6) AS h5, round(h6, 12) AS h6, h8 FROM (SELECT id, h0 / 4 AS h0, h2, h5, h6 / 4 AS h6, h8 FROM m)")
def rescale_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map between grids refined 4 times on the first side and 2 times on the second."""
    h = hg.rescaled(hg.entries(F.col("h")), F.lit(4.0), F.lit(2.0))
    return maps(spark, sf_dir).select("id", r(h[0], 9).alias("h0"), r(h[2]).alias("h2"), r(h[5]).alias("h5"), r(h[6], 12).alias("h6"), h[8].alias("h8"))
