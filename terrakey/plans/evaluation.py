"""Queries on evaluation runs: lineitem rows grouped into one run per order and return flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.functions import scoring
from terrakey.operators import evaluation as ops
from terrakey.plans.common import Registry, r, table

query = Registry()


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, arm, family, err, n_inliers, texture, rmse, agree_px, heldout, ncc_gain, has_model, degenerate, unif_cells, total_ms, status, split); no error without a model."""
    line = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    err = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount").cast("double") * 100)
    df = line.groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("arm")).agg(
        F.min("l_linestatus").alias("family"),
        F.min(err).alias("err"),
        F.min("l_quantity").cast("int").alias("n_inliers"),
        F.max("l_extendedprice").cast("double").alias("texture"),
        F.max("l_partkey").alias("pk"),
    )
    pk, key = F.col("pk"), F.col("id")
    return df.select(
        "id", "arm", "family", F.when(pk % 17 != 0, F.col("err")).alias("err"), "n_inliers", "texture",
        (pk % 30 * 0.1).alias("rmse"), (key % 9 * 0.75).alias("agree_px"), (pk % 13 * 0.5).alias("heldout"), (pk % 11 * 0.02 - 0.06).alias("ncc_gain"),
        (pk % 17 != 0).alias("has_model"), (pk % 19 == 0).alias("degenerate"), (pk % 17 / 16).alias("unif_cells"), (pk % 997 * 0.5).alias("total_ms"),
        F.when(key % 23 == 0, "FILL").when(key % 29 == 0, "DUPLICATE").when(key % 31 == 0, "NO_LOCK").otherwise("OK").alias("status"),
        F.when(key % 3 == 0, "test").otherwise("dev").alias("split"),
    )


_R = """WITH g AS (SELECT l_orderkey AS id, l_returnflag AS arm, min(l_linestatus) AS family, min(CASE WHEN l_linenumber % 5 <> 0 THEN l_discount::DOUBLE * 100 END) AS err, CAST(min(l_quantity) AS INTEGER) AS n_inliers,
  max(l_extendedprice)::DOUBLE AS texture, max(l_partkey) AS pk FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
r AS (SELECT id, arm, family, CASE WHEN pk % 17 <> 0 THEN err END AS err, n_inliers, texture, pk % 17 / 16 AS unif_cells, pk % 997 * 0.5::DOUBLE AS total_ms, pk % 30 * 0.1::DOUBLE AS rmse, id % 9 * 0.75::DOUBLE AS agree_px, pk % 13 * 0.5::DOUBLE AS heldout, pk % 11 * 0.02::DOUBLE - 0.06::DOUBLE AS ncc_gain, pk % 17 <> 0 AS has_model, pk % 19 = 0 AS degenerate,
  CASE WHEN id % 23 = 0 THEN 'FILL' WHEN id % 29 = 0 THEN 'DUPLICATE' WHEN id % 31 = 0 THEN 'NO_LOCK' ELSE 'OK' END AS status, CASE WHEN id % 3 = 0 THEN 'test' ELSE 'dev' END AS split FROM g)"""
_V = """, v AS (SELECT *, CASE WHEN status = 'NO_LOCK' THEN 'NO_LOCK' WHEN status <> 'OK' THEN 'EXCLUDED_' || status WHEN has_model AND NOT degenerate AND n_inliers >= 15 AND err <= 2 THEN 'SUCCESS' WHEN has_model AND n_inliers >= 8 AND err <= 10 THEN 'MARGINAL' ELSE 'FAILURE' END AS verdict FROM r),
f AS (SELECT *, coalesce(verdict = 'SUCCESS' AND err < 1, false) AS subpixel, has_model AND round(rmse, 4) < 1.5 AND (err IS NULL OR err > 10) AS false_confidence, unif_cells >= 0.75 AS uniform FROM v)"""
_O = """, o AS (SELECT r.*, b.id IS NOT NULL AS has_other, coalesce(b.has_model AND NOT b.degenerate AND b.n_inliers >= 8, false) AS other_usable, coalesce(b.has_model, false) AS other_model, b.err AS other_err FROM r LEFT JOIN r b ON r.id = b.id AND r.arm <> b.arm)"""
_C = """, c AS (SELECT *, CASE WHEN agree_px <= 3 AND other_usable THEN 'agreement' WHEN ncc_gain >= 0.05 AND NOT other_usable THEN 'ncc' END AS confirmed_by FROM o)"""
_T = """, q AS (SELECT family, quantile_cont(texture, 1/3.0) AS q1, quantile_cont(texture, 2/3.0) AS q2, count(texture) AS m FROM (SELECT family, id, max(texture) AS texture FROM r WHERE status = 'OK' GROUP BY ALL) GROUP BY family),
t AS (SELECT f.*, CASE WHEN status = 'OK' AND m >= 3 THEN CASE WHEN texture < q1 THEN 'low' WHEN texture < q2 THEN 'mid' ELSE 'high' END END AS terrain FROM f LEFT JOIN q USING (family))"""
_Z = 1.96


def _share(name: str, k: str, n: str) -> str:
    p = f"({k} / {n}::DOUBLE)"
    scale, mid, half = f"(1 + {_Z}*{_Z}/{n})", f"({p} + {_Z}*{_Z}/(2*{n}))", f"{_Z} * sqrt({p} * (1 - {p}) / {n} + {_Z}*{_Z}/(4*{n}*{n}))"
    return f"CASE WHEN {n} > 0 THEN round({p}, 6) END AS {name}, CASE WHEN {n} > 0 THEN round(greatest(0, {mid}/{scale} - {half}/{scale}), 6) END AS {name}_low, CASE WHEN {n} > 0 THEN round(least(1, {mid}/{scale} + {half}/{scale}), 6) END AS {name}_high"


def _summary(by: str, source: str) -> str:
    locked = "FILTER (WHERE verdict <> 'NO_LOCK')"
    return f""", s AS (SELECT {by}, count(*) AS n, count(*) FILTER (WHERE verdict = 'SUCCESS') AS n_success, count(*) FILTER (WHERE verdict = 'MARGINAL') AS n_marginal, count(*) FILTER (WHERE verdict = 'FAILURE') AS n_failure,
  count(*) FILTER (WHERE verdict = 'NO_LOCK') AS n_no_lock, count(*) FILTER (WHERE subpixel) AS n_subpixel, count(*) {locked} AS n_locked, count(*) FILTER (WHERE verdict <> 'NO_LOCK' AND uniform) AS n_uniform,
  median(err) {locked} AS median_err, median(n_inliers) {locked} AS median_n_inliers, median(total_ms) {locked} AS median_total_ms, count(err) {locked} AS n_with_model
  FROM {source} WHERE NOT starts_with(verdict, 'EXCLUDED') GROUP BY {by})
SELECT * EXCLUDE (median_err), round(median_err, 6) AS median_err, {_share("rate", "n_success", "n")}, {_share("subpixel", "n_subpixel", "n")}, {_share("uniform", "n_uniform", "n_locked")} FROM s"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with a verdict and flags; rows that are not OK say why. False confidence is a small residual with a large or unknown error."""
    gt = scoring.verdict_gt(F.col("has_model"), F.col("degenerate"), F.col("n_inliers"), F.col("err"))
    verdict = F.when(F.col("status") == "NO_LOCK", "NO_LOCK").when(F.col("status") != "OK", F.concat(F.lit("EXCLUDED_"), "status")).otherwise(gt)
    out = runs(spark, sf_dir).withColumn("verdict", verdict)
    subpixel = F.coalesce((F.col("verdict") == "SUCCESS") & (F.col("err") < 1), F.lit(False))
    false = F.col("has_model") & (F.round("rmse", 4) < 1.5) & (F.col("err").isNull() | (F.col("err") > 10))
    return out.withColumns({"subpixel": subpixel, "false_confidence": false, "uniform": F.col("unif_cells") >= 0.75})


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ops.other_arm(runs(spark, sf_dir), ["has_model", "degenerate", "n_inliers", "err"])
    usable = F.coalesce(scoring.usable_arm(F.col("other_has_model"), F.col("other_degenerate"), F.col("other_n_inliers")), F.lit(False))
    df = df.withColumns({"other_usable": usable, "other_model": F.coalesce("other_has_model", F.lit(False))})
    return df.withColumn("confirmed_by", scoring.confirmed_by(F.col("agree_px"), F.col("other_usable"), F.col("ncc_gain")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r(c) for c in ("median_err", *(f"{k}{x}" for k in ("rate", "subpixel", "uniform") for x in ("", "_low", "_high")))})


@query(f"{_R}{_V} SELECT id, arm, verdict FROM v")
def verdict_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("id", "arm", "verdict")


@query(f"{_R}{_O}{_C} SELECT id, arm, confirmed_by, CASE WHEN has_model AND n_inliers >= 15 AND heldout <= 2 AND confirmed_by IS NOT NULL THEN 'SUCCESS' WHEN has_model AND n_inliers >= 8 AND heldout <= 5 THEN 'MARGINAL' ELSE 'FAILURE' END AS verdict FROM c")
def verdict_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scoring.verdict_real(F.col("has_model"), F.col("n_inliers"), F.col("heldout"), F.col("confirmed_by"))
    return compared(spark, sf_dir).select("id", "arm", "confirmed_by", v.alias("verdict"))


@query(f"{_R}{_O} SELECT id, arm, other_usable, round(other_err, 6) AS other_err FROM o")
def arm_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("id", "arm", "other_usable", r("other_err").alias("other_err"))


@query(f"{_R}{_V} SELECT id, arm, subpixel, false_confidence, uniform FROM f")
def run_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("id", "arm", "subpixel", "false_confidence", "uniform")


@query(f"{_R}{_V}{_T} SELECT id, arm, terrain FROM t")
def terrain_tertiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.terrain_tertiles(judged(spark, sf_dir)).select("id", "arm", "terrain")


@query(f"{_R} SELECT family, n, k, round(greatest(0, (k/n::DOUBLE + 3.8416/(2*n)) / (1 + 3.8416/n) - 1.96 * sqrt(k/n::DOUBLE * (1 - k/n::DOUBLE) / n + 3.8416/(4*n*n)) / (1 + 3.8416/n)), 6) AS low, round(least(1, (k/n::DOUBLE + 3.8416/(2*n)) / (1 + 3.8416/n) + 1.96 * sqrt(k/n::DOUBLE * (1 - k/n::DOUBLE) / n + 3.8416/(4*n*n)) / (1 + 3.8416/n)), 6) AS high FROM (SELECT family, count(*) AS n, count(*) FILTER (WHERE err <= 2) AS k FROM r GROUP BY family)")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runs(spark, sf_dir).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("err") <= 2).alias("k"))
    lo, hi = scoring.wilson(F.col("k"), F.col("n"))
    return df.select("family", "n", "k", r(lo).alias("low"), r(hi).alias("high"))


@query(f"{_R}{_V}{_summary('arm', 'f')}")
def summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.summary(judged(spark, sf_dir), ["arm"]))


@query(f"{_R}{_V}{_summary('arm, split', 'f')}")
def summary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.summary(judged(spark, sf_dir), ["arm", "split"]))


@query(f"{_R}{_V}{_T}{_summary('arm, terrain', 't')}")
def summary_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.summary(ops.terrain_tertiles(judged(spark, sf_dir)), ["arm", "terrain"]))


@query(f"{_R}{_V}, l AS (SELECT *, id % 7 * 30 AS level FROM f){_summary('arm, level', 'l')}")
def summary_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.summary(judged(spark, sf_dir).withColumn("level", F.col("id") % 7 * 30), ["arm", "level"]))


@query(f"{_R}{_V} SELECT family, verdict, count(DISTINCT id) AS n_instances FROM v WHERE starts_with(verdict, 'EXCLUDED') OR verdict = 'NO_LOCK' GROUP BY ALL")
def excluded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(spark, sf_dir).where(F.col("verdict").startswith("EXCLUDED") | (F.col("verdict") == "NO_LOCK"))
    return out.groupBy("family", "verdict").agg(F.count_distinct("id").alias("n_instances"))


@query(f"{_R} SELECT DISTINCT r.id, a.arm, CASE WHEN status = 'NO_LOCK' THEN 'NO_LOCK' ELSE 'EXCLUDED_' || status END AS verdict FROM r, (VALUES ('A'), ('R')) a(arm) WHERE status <> 'OK'")
def excluded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each arm of every instance that is not usable."""
    ids = runs(spark, sf_dir).where("status <> 'OK'").select("id", "status").distinct()
    verdict = F.when(F.col("status") == "NO_LOCK", "NO_LOCK").otherwise(F.concat(F.lit("EXCLUDED_"), "status"))
    return ids.select("id", F.explode(F.array(F.lit("A"), F.lit("R"))).alias("arm"), verdict.alias("verdict"))


@query(f"{_R}{_V} SELECT family, string_agg(id || '/' || arm, ',' ORDER BY id, arm) AS runs, count(*) AS n FROM f WHERE false_confidence AND status = 'OK' GROUP BY family")
def false_confidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = judged(spark, sf_dir).where("false_confidence and status = 'OK'")
    names = F.transform(F.array_sort(F.collect_list(F.struct("id", "arm"))), lambda x: F.concat_ws("/", x["id"], x["arm"]))
    return bad.groupBy("family").agg(F.array_join(names, ",").alias("runs"), F.count(F.lit(1)).alias("n"))


@query(f"""{_R}{_O}, m AS (SELECT *, err <= 2 AS good, coalesce(rmse < 1.5, false) AS g1, n_inliers >= 15 AND NOT degenerate AS g2, coalesce(agree_px <= 3, false) AND has_model AND other_model AS g3 FROM o WHERE err IS NOT NULL AND status = 'OK'),
x AS (SELECT 'rmse' AS gate, g1 AS ok, good FROM m UNION ALL SELECT 'inliers', g2, good FROM m UNION ALL SELECT 'agree', g3, good FROM m UNION ALL SELECT 'both', g2 AND g3, good FROM m)
SELECT gate, count(*) AS with_model, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE ok AND NOT good) AS accepted_but_wrong, count(*) FILTER (WHERE NOT ok AND good) AS right_but_rejected, count(*) FILTER (WHERE NOT good) AS wrong_total,
  round(count(*) FILTER (WHERE ok AND good) / count(*) FILTER (WHERE ok), 4) AS precision FROM x GROUP BY gate""")
def trust_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable instances' results with a known error; arms can agree only where both have a map."""
    rows = compared(spark, sf_dir).where("status = 'OK' and err is not null")
    agree = (F.col("agree_px") <= 3) & F.col("has_model") & F.col("other_model")
    sound = (F.col("n_inliers") >= 15) & ~F.col("degenerate")
    return ops.trust_gates(rows, {"rmse": F.col("rmse") < 1.5, "inliers": sound, "agree": agree, "both": sound & agree}, F.col("err") <= 2)


_PC = f"""{_R}, k AS (SELECT *, err IS NOT NULL AND n_inliers >= 15 AND NOT degenerate AS ok FROM r WHERE status = 'OK'),
b AS (SELECT id, family, split, count(*) FILTER (WHERE ok) AS n_ok, CASE WHEN count(*) FILTER (WHERE has_model) = 2 THEN min(agree_px) END AS agree,
  max(CASE WHEN arm = 'A' AND ok THEN n_inliers END) AS na, max(CASE WHEN arm = 'R' AND ok THEN n_inliers END) AS nr, max(CASE WHEN arm = 'A' AND ok THEN err END) AS ea, max(CASE WHEN arm = 'R' AND ok THEN err END) AS er FROM k GROUP BY id, family, split),
pc AS (
  SELECT id, family, split, 'both' AS policy, CASE WHEN n_ok = 2 AND agree <= 3 THEN 'CONFIRMED' WHEN n_ok = 1 THEN 'UNCONFIRMED' WHEN n_ok = 2 THEN 'DISAGREE' ELSE 'REJECT' END AS policy_status,
    CASE WHEN n_ok = 0 THEN NULL WHEN nr IS NULL OR na >= nr THEN 'A' ELSE 'R' END AS arm, CASE WHEN n_ok = 0 THEN NULL WHEN nr IS NULL OR na >= nr THEN ea ELSE er END AS err FROM b
  UNION ALL SELECT id, family, split, 'only_A', CASE WHEN na IS NULL THEN 'REJECT' ELSE 'ACCEPT' END, CASE WHEN na IS NOT NULL THEN 'A' END, ea FROM b
  UNION ALL SELECT id, family, split, 'only_R', CASE WHEN nr IS NULL THEN 'REJECT' ELSE 'ACCEPT' END, CASE WHEN nr IS NOT NULL THEN 'R' END, er FROM b),
pj AS (SELECT *, arm IS NOT NULL AS accepted, coalesce(err <= 2, false) AS good, coalesce(err < 1, false) AS fine FROM pc)"""


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.policy(runs(spark, sf_dir).where("status = 'OK'"), ["A", "R"])
    return out.withColumns({"accepted": F.col("arm").isNotNull(), "good": F.coalesce(F.col("err") <= 2, F.lit(False)), "fine": F.coalesce(F.col("err") < 1, F.lit(False))})


@query(f"{_PC} SELECT id, family, split, policy, policy_status, arm, round(err, 6) AS err FROM pc")
def policy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices(spark, sf_dir).select("id", "family", "split", "policy", "policy_status", "arm", r("err").alias("err"))


@query(f"""{_PC} SELECT policy, split, count(*) AS n, count(*) FILTER (WHERE accepted) AS accepted_n, count(*) FILTER (WHERE good) AS right_n, count(*) FILTER (WHERE accepted AND NOT good) AS wrong_accepted, count(*) FILTER (WHERE fine) AS subpixel,
  round(count(*) FILTER (WHERE good) / count(*), 3) AS success_rate, round(count(*) FILTER (WHERE good) / count(*) FILTER (WHERE accepted), 3) AS precision FROM pj GROUP BY policy, split""")
def policy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms together against each arm alone."""
    counts = [F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("accepted_n"), F.count_if("good").alias("right_n"), F.count_if(F.col("accepted") & ~F.col("good")).alias("wrong_accepted"), F.count_if("fine").alias("subpixel")]
    out = choices(spark, sf_dir).groupBy("policy", "split").agg(*counts)
    return out.withColumns({"success_rate": r(F.col("right_n") / F.col("n"), 3), "precision": r(F.try_divide("right_n", "accepted_n"), 3)})


@query(f"{_PC} SELECT policy, family, count(*) AS n, count(*) FILTER (WHERE good) AS right_n, count(*) FILTER (WHERE accepted AND NOT good) AS wrong_accepted FROM pj GROUP BY policy, family")
def policy_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices(spark, sf_dir).groupBy("policy", "family").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("right_n"), F.count_if(F.col("accepted") & ~F.col("good")).alias("wrong_accepted"))


@query(f"{_PC} SELECT policy_status, good AS is_right, count(*) AS n FROM pj WHERE policy = 'both' GROUP BY policy_status, good")
def policy_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices(spark, sf_dir).where("policy = 'both'").groupBy("policy_status", F.col("good").alias("is_right")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_R}{_V} SELECT family, arm, verdict, round(median(heldout), 6) AS median_heldout, round(median(rmse), 6) AS median_rmse, round(avg(CASE WHEN heldout < 1 THEN 1.0 ELSE 0.0 END), 6) AS share_below_1, round(100 * (1 - median(rmse) / nullif(median(heldout), 0)), 4) AS drop_pct, count(*) AS n_arm_rows FROM v WHERE verdict IN ('SUCCESS', 'MARGINAL') GROUP BY family, arm, verdict")
def geometry_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians, drop and share below one pixel by family and arm, marginal against successful runs."""
    mh, mr = F.median("heldout"), F.median("rmse")
    out = judged(spark, sf_dir).where(F.col("verdict").isin("SUCCESS", "MARGINAL")).groupBy("family", "arm", "verdict").agg(mh.alias("mh"), mr.alias("mr"), F.avg((F.col("heldout") < 1).cast("double")).alias("s"), F.count(F.lit(1)).alias("n_arm_rows"))
    return out.select("family", "arm", "verdict", r("mh").alias("median_heldout"), r("mr").alias("median_rmse"), r("s").alias("share_below_1"), r(100 * (1 - F.try_divide("mr", "mh")), 4).alias("drop_pct"), "n_arm_rows")


@query(f"{_R} SELECT arm, family, round(median(err), 6) AS median_err, round(avg(CASE WHEN err <= 2 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, sum(CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) AS n_fallback FROM r GROUP BY arm, family")
def detector_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms side by side; a fallback counts for the detector that ran."""
    hit = F.coalesce((F.col("err") <= 2).cast("double"), F.lit(0.0))
    return runs(spark, sf_dir).groupBy("arm", "family").agg(r(F.median("err")).alias("median_err"), r(F.avg(hit)).alias("success_rate"), F.sum(F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("n_fallback"))


@query("SELECT event_id, TRY_CAST(replace(replace(props, '{\"k\": ', ''), '}', '') AS DOUBLE) AS number, lower(CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END) = 'true' AS flag, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE event_id::VARCHAR END AS BIGINT) AS maybe FROM events")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and flags from text; what is no number is null."""
    e = table(spark, sf_dir, "events")
    text = F.replace(F.replace("props", F.lit('{"k": '), F.lit("")), F.lit("}"), F.lit(""))
    flag = F.lower(F.when(F.col("event_id") % 2 == 0, "True").otherwise("False")) == "true"
    maybe = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("event_id").cast("string")).try_cast("long")
    return e.select("event_id", text.try_cast("double").alias("number"), flag.alias("flag"), maybe.alias("maybe"))


@query(f"{_R} SELECT id, arm, CASE WHEN n_inliers * 0.01 >= 0.20 AND (rmse >= 1.8 OR heldout >= 6) THEN 'measured' WHEN agree_px * 100 <= 0.35 * 1024 * 0.8 THEN 'prior' ELSE 'rejected' END AS decision FROM r")
def lock_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scoring.lock_decision(F.col("n_inliers") * 0.01, F.col("rmse"), F.col("heldout"), F.col("agree_px") * 100, 1024, F.lit(0.8))
    return runs(spark, sf_dir).select("id", "arm", d.alias("decision"))


@query(f"""{_R}, e AS (SELECT *, err * 2 AS truth FROM r) SELECT id, arm, CASE WHEN degenerate THEN 'bad' WHEN rmse < 1 THEN 'good' WHEN rmse < 3 THEN 'ok' ELSE 'bad' END AS rmse_tone, CASE WHEN n_inliers / 50 > 0.5 THEN 'good' WHEN n_inliers / 50 > 0.25 THEN 'ok' ELSE 'bad' END AS ratio_tone,
CASE WHEN truth IS NULL THEN NULL WHEN truth < 3 THEN 'good' WHEN truth < 15 THEN 'ok' ELSE 'bad' END AS truth_tone, coalesce(truth > 15 AND NOT degenerate, false) AS warning FROM e""")
def run_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tones of a run's figures; twice the fixture's error stands for the one at the corners."""
    truth = F.col("err") * 2
    tones = scoring.run_tones(F.col("rmse"), F.col("n_inliers") / 50, truth, F.col("degenerate"))
    return runs(spark, sf_dir).select("id", "arm", *(c.alias(n) for n, c in tones.items()))


@query(f"""{_R}{_V}, e AS (SELECT arm || ' ' || family AS title, arm, family, id, n_inliers, 50 AS n_matches, rmse, err * 12 AS truth FROM f WHERE has_model)
SELECT id, '| ' || title || ' | ' || arm || ' | ' || n_inliers || '/' || n_matches || ' | ' || printf('%.3f', rmse) || ' | ' || coalesce(printf('%.2f', truth), 'n/a') || CASE WHEN truth > 50 THEN '  **<- wrong**' ELSE '' END || ' |' AS line, coalesce(truth > 50, false) AS wrong FROM e""")
def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as lines of a table beside their true error, those flagged that fit well and are far off."""
    df = judged(spark, sf_dir).where("has_model")
    line, wrong = scoring.table_line(F.concat_ws(" ", "arm", "family"), F.col("arm"), F.col("n_inliers"), F.lit(50), F.col("rmse"), F.col("err") * 12)
    return df.select("id", line.alias("line"), wrong.alias("wrong"))


_SETS = [["arm"], ["arm", "split"], ["arm", "family"], ["arm", "family", "split"]]


@query(f"""{_R}{_V}, s AS (SELECT grouping(arm, family, split) AS level, arm, family, split, count(*) AS n, count(*) FILTER (WHERE verdict = 'SUCCESS') AS n_success, count(*) FILTER (WHERE subpixel) AS n_subpixel, count(*) FILTER (WHERE verdict <> 'NO_LOCK') AS n_locked, median(err) FILTER (WHERE verdict <> 'NO_LOCK') AS median_err
FROM f WHERE NOT starts_with(verdict, 'EXCLUDED') GROUP BY GROUPING SETS ({", ".join(f"({', '.join(s)})" for s in _SETS)})) SELECT level, arm, family, split, n, n_success, n_subpixel, n_locked, round(median_err, 6) AS median_err, {_share("rate", "n_success", "n")} FROM s""")
def summary_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries over all, by split, by family and by both, in one scan."""
    out = ops.summary_sets(judged(spark, sf_dir), ["arm", "family", "split"], _SETS)
    return out.select("level", "arm", "family", "split", "n", "n_success", "n_subpixel", "n_locked", *(r(c).alias(c) for c in ("median_err", "rate", "rate_low", "rate_high")))


@query("""WITH p AS (SELECT event_type AS run, event_id AS idx, value % 500 AS x, (event_id * 7) % 500 + 0.0::DOUBLE AS y FROM events), e AS (SELECT *, sin(x / 50) + (idx % 5) * 0.1::DOUBLE AS rx, cos(y / 60) + (idx % 7) * 0.1::DOUBLE AS ry FROM p),
m AS (SELECT a.run, a.idx, a.rx, a.ry, b.rx AS rx2, b.ry AS ry2, row_number() OVER (PARTITION BY a.run, a.idx ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.idx) AS rn FROM e a JOIN e b ON a.run = b.run AND a.idx <> b.idx),
n AS (SELECT run, idx, rx, ry, avg(rx2) AS mx, avg(ry2) AS my FROM m WHERE rn <= 8 GROUP BY ALL) SELECT run, round((corr(rx, mx) + corr(ry, my)) / 2, 6) AS coherence, count(*) AS n FROM n GROUP BY run HAVING (SELECT count(*) FROM e WHERE e.run = n.run) >= 40""")
def residual_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("idx"), (F.col("value") % 500).alias("x"), ((F.col("event_id") * 7) % 500).cast("double").alias("y"))
    e = e.select("*", (F.sin(F.col("x") / 50) + F.col("idx") % 5 * 0.1).alias("rx"), (F.cos(F.col("y") / 60) + F.col("idx") % 7 * 0.1).alias("ry"))
    return ops.residual_coherence(e, "run").select("run", r("coherence").alias("coherence"), "n")
