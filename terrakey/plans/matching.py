"""Queries on matching and maps: embeddings as descriptors, a copy of them under a known map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.functions import homography as hg
from terrakey.operators.matching import error_stats as residual_stats
from terrakey.operators.matching import keypoint_budget as strongest
from terrakey.operators.matching import knn, ratio_test
from terrakey.plans.common import Registry, r, table

query = Registry()

#: The known map of the fixture, row by row.
KNOWN = [0.98, 0.05, 12.0, -0.04, 1.01, -7.0, 1e-5, -2e-5, 1.0]
_H = "[" + ", ".join(f"{x!r}::DOUBLE" for x in KNOWN) + "]"


def known() -> hg.H:
    return [F.lit(x) for x in KNOWN]


def keypoints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keypoints of either image: run (label), idx, x, y, desc."""
    e = table(spark, sf_dir, "embeddings")
    desc = F.col("embedding").cast("array<double>")
    a = e.select(F.col("label").alias("run"), F.col("vec_id").alias("idx"), desc.alias("desc"))
    a = a.select("run", "idx", "desc", (512 + 100 * F.get("desc", F.lit(0))).alias("x"), (512 + 100 * F.get("desc", F.lit(1))).alias("y"))
    x, y = hg.apply(known(), F.col("x"), F.col("y"))
    near = F.transform("desc", lambda v, i: v + 0.05 * F.sin(F.col("idx") + i + 1))
    return a, a.select("run", "idx", near.alias("desc"), x.alias("x"), y.alias("y"))


_AB = """WITH a AS (SELECT label AS run, vec_id AS idx, list_transform(embedding, lambda v: v::DOUBLE) AS d FROM embeddings),
b AS (SELECT run, idx, list_transform(d, lambda v, i: v + 0.05 * sin(idx + i)) AS d FROM a),
k AS (SELECT a.run, a.idx AS idx_a, b.idx AS idx_b, list_distance(a.d, b.d) AS dist, row_number() OVER (PARTITION BY a.run, a.idx ORDER BY list_distance(a.d, b.d), b.idx) AS rank FROM a JOIN b USING (run)),
t AS (SELECT * FROM k WHERE rank <= 2),
m AS (SELECT p.run, p.idx_a, p.idx_b, p.dist AS d1, q.dist AS d2 FROM t p JOIN t q ON p.run = q.run AND p.idx_a = q.idx_a AND p.rank = 1 AND q.rank = 2 WHERE q.dist > 0 AND p.dist / q.dist < 0.8)"""
_XY = f""", pa AS (SELECT run, idx, 512 + 100 * d[1] AS x, 512 + 100 * d[2] AS y FROM a),
pb AS (SELECT run, idx, ({_H}[1] * x + {_H}[2] * y + {_H}[3]) / ({_H}[7] * x + {_H}[8] * y + {_H}[9]) AS x, ({_H}[4] * x + {_H}[5] * y + {_H}[6]) / ({_H}[7] * x + {_H}[8] * y + {_H}[9]) AS y FROM pa),
g AS (SELECT m.*, pa.x AS xa, pa.y AS ya, pb.x AS xb, pb.y AS yb FROM m JOIN pa ON pa.run = m.run AND pa.idx = m.idx_a JOIN pb ON pb.run = m.run AND pb.idx = m.idx_b),
e AS (SELECT *, sqrt(pow(({_H}[1] * xa + {_H}[2] * ya + {_H}[3]) / ({_H}[7] * xa + {_H}[8] * ya + {_H}[9]) + (idx_a % 7 - 3) * 0.25 - xb, 2) + pow(({_H}[4] * xa + {_H}[5] * ya + {_H}[6]) / ({_H}[7] * xa + {_H}[8] * ya + {_H}[9]) - yb, 2)) AS err FROM g)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = keypoints(spark, sf_dir)
    return ratio_test(knn(a.select("run", "idx", "desc"), b.select("run", "idx", "desc")))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with both points and the distance of the mapped first point, off by a known shift, to the second."""
    a, b = keypoints(spark, sf_dir)
    pa = a.select("run", F.col("idx").alias("idx_a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    pb = b.select("run", F.col("idx").alias("idx_b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    df = matches(spark, sf_dir).join(pa, ["run", "idx_a"]).join(pb, ["run", "idx_b"])
    x, y = hg.apply(known(), F.col("xa"), F.col("ya"))
    return df.withColumn("err", F.hypot(x + (F.col("idx_a") % 7 - 3) * 0.25 - F.col("xb"), y - F.col("yb")))


@query(f"{_AB}{_XY} SELECT run, count(*) AS n, round(sqrt(avg(err * err)), 6) AS rmse, round(median(err), 6) AS median, round(quantile_cont(err, 0.9), 6) AS p90, round(max(err), 6) AS max FROM e GROUP BY run")
def match_ratio_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: nearest neighbours, ratio test, known map, residual statistics by run."""
    out = residual_stats(residuals(spark, sf_dir), ["run"])
    return out.select("run", "n", *(r(c).alias(c) for c in ("rmse", "median", "p90", "max")))


@query(f"{_AB} SELECT run, idx_a, idx_b, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM t")
def knn_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = keypoints(spark, sf_dir)
    return knn(a.select("run", "idx", "desc"), b.select("run", "idx", "desc")).select("run", "idx_a", "idx_b", "rank", r("dist").alias("dist"))


@query(f"{_AB} SELECT run, idx_a, idx_b, round(d1, 6) AS d1, round(d2, 6) AS d2, round(least(greatest(1 - d1 / d2, 0), 1), 6) AS confidence FROM m")
def lowe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("run", "idx_a", "idx_b", *(r(c).alias(c) for c in ("d1", "d2", "confidence")))


@query(f"{_AB} SELECT run, idx_a, idx_b, round(1 - d1 / d2, 6) AS confidence FROM m WHERE 1 - d1 / d2 >= 0.6")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).where("confidence >= 0.6").select("run", "idx_a", "idx_b", r("confidence").alias("confidence"))


@query("WITH p AS (SELECT label AS run, vec_id AS idx, embedding[3]::DOUBLE AS response FROM embeddings) SELECT run, idx, round(response, 6) AS response FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY response DESC, idx) AS rn FROM p) WHERE rn <= 20")
def keypoint_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select(F.col("label").alias("run"), F.col("vec_id").alias("idx"), F.get("embedding", F.lit(2)).cast("double").alias("response"))
    return strongest(p, 20).select("run", "idx", r("response").alias("response"))


@query("SELECT vec_id AS id, round(1.25 * (512 + 100 * embedding[1]::DOUBLE), 6) AS x, round(1.25 * (512 + 100 * embedding[2]::DOUBLE), 6) AS y FROM embeddings WHERE 512 + 100 * embedding[1]::DOUBLE < 520 AND 512 + 100 * embedding[2]::DOUBLE < 520")
def keypoints_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoints that do not lie in the padding, in the full image's pixels."""
    a, _ = keypoints(spark, sf_dir)
    return a.where("x < 520 and y < 520").select(F.col("idx").alias("id"), r(1.25 * F.col("x")).alias("x"), r(1.25 * F.col("y")).alias("y"))


@query(f"{_AB}{_XY} SELECT run, idx_a, idx_b, err <= 0.5 AS inlier FROM e")
def inlier_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = residuals(spark, sf_dir)
    inliers = df.where("err <= 0.5").select("run", "idx_a", "idx_b", F.lit(True).alias("hit"))
    return df.join(inliers, ["run", "idx_a", "idx_b"], "left").select("run", "idx_a", "idx_b", F.coalesce("hit", F.lit(False)).alias("inlier"))


@query(f"""{_AB}{_XY}, z AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY idx_a, idx_b) - 1 AS match_index FROM e)
SELECT run, CAST(match_index AS INTEGER) AS match_index, round(xa, 3) AS x_a, round(ya, 3) AS y_a, round(xb, 3) AS x_b, round(yb, 3) AS y_b, round(1 - d1 / d2, 4) AS confidence, err <= 0.5 AS is_inlier, CASE WHEN err <= 0.5 THEN round(err, 4) END AS residual_px FROM z""")
def match_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of matches for export; residuals of inliers only."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("run").orderBy("idx_a", "idx_b")) - 1
    points = [r(F.col(c), 3).alias(n) for c, n in (("xa", "x_a"), ("ya", "y_a"), ("xb", "x_b"), ("yb", "y_b"))]
    inlier = F.col("err") <= 0.5
    return residuals(spark, sf_dir).select("run", at.alias("match_index"), *points, r("confidence", 4).alias("confidence"), inlier.alias("is_inlier"), F.when(inlier, r("err", 4)).alias("residual_px"))


@query(f"{_AB}{_XY} SELECT run, idx_a, round(err, 6) AS err FROM e")
def reprojection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals(spark, sf_dir).select("run", "idx_a", r("err").alias("err"))


@query(f"{_AB}{_XY} SELECT idx_a % 13 AS part, round(sqrt(avg(err * err)), 6) AS rmse, round(median(err), 6) AS median, round(quantile_cont(err, 0.9), 6) AS p90, round(max(err), 6) AS max, count(err) AS n FROM (SELECT idx_a, CASE WHEN idx_a % 13 = 5 THEN NULL ELSE err END AS err FROM e) GROUP BY ALL")
def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by part; one part has no residual at all and gets nulls."""
    df = residuals(spark, sf_dir).select((F.col("idx_a") % 13).alias("part"), F.when(F.col("idx_a") % 13 != 5, F.col("err")).alias("err"))
    return residual_stats(df, ["part"]).select("part", *(r(c).alias(c) for c in ("rmse", "median", "p90", "max")), "n")


@query(f"""{_AB}{_XY} SELECT run, count(*) AS n_matches, count(*) FILTER (WHERE err <= 0.5) AS n_inliers, round(count(*) FILTER (WHERE err <= 0.5) / greatest(count(*), 1), 4) AS inlier_ratio,
round(sqrt(avg(err * err)) * 0.25, 6) AS rmse_m FROM e GROUP BY run""")
def metrics_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    inliers = F.count_if(F.col("err") <= 0.5)
    out = residuals(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("n_matches"), inliers.alias("n_inliers"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"))
    return out.select("run", "n_matches", "n_inliers", r(F.col("n_inliers") / F.greatest("n_matches", F.lit(1)), 4).alias("inlier_ratio"), r(F.col("rmse") * 0.25).alias("rmse_m"))
