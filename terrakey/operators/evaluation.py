"""Tables of evaluation runs: one row per instance and method (arm), their summaries, gates and policies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from terrakey.functions.scoring import accepted_arm, wilson
from terrakey.operators.neighbours import neighbour_means
from terrakey.operators.order import is_large, percentiles

VERDICTS = ["SUCCESS", "MARGINAL", "FAILURE", "NO_LOCK"]


def other_arm(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the columns of the same instance's other arm, prefixed ``other_``; nulls if it has none.

    One shuffle on the id: both arms are neighbours in a window of an instance's rows, of which there are as many as arms.
    """
    w = Window.partitionBy("id").orderBy("arm")
    pick = lambda c: F.coalesce(F.lead(c).over(w), F.lag(c).over(w))
    both = F.struct(*columns)
    return runs.withColumn("_o", pick(both)).select("*", *(F.col(f"_o.{c}").alias(f"other_{c}") for c in columns)).drop("_o")


def terrain_tertiles(runs: DataFrame) -> DataFrame:
    """Adds ``terrain``: low, mid or high texture within the family, by thirds of the usable instances; null under three.

    An instance counts once however many arms it has.
    """
    instances = runs.where("status = 'OK'").groupBy("family", "id").agg(F.max("texture").alias("texture"))
    if is_large(instances):
        limits = percentiles(instances, ["family"], "texture", {"q1": 1 / 3, "q2": 2 / 3})
        limits = limits.join(instances.groupBy("family").agg(F.count("texture").alias("m")), "family")
    else:
        limits = instances.groupBy("family").agg(F.percentile("texture", 1 / 3).alias("q1"), F.percentile("texture", 2 / 3).alias("q2"), F.count("texture").alias("m"))
    band = F.when(F.col("texture") < F.col("q1"), "low").when(F.col("texture") < F.col("q2"), "mid").when(F.col("texture").isNotNull(), "high")
    # One row a family: broadcast, as a shuffle by family would gather a family's runs in a task.
    return runs.join(F.broadcast(limits), "family", "left").withColumn("terrain", F.when((F.col("status") == "OK") & (F.col("m") >= 3), band)).drop("q1", "q2", "m")


def summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Counts of verdicts, medians over runs with a lock, and the shares of successes and sub-pixel successes with their intervals.

    Excluded rows count nowhere; rows without a lock count in ``n`` but not in the medians nor in ``n_uniform``, whose share
    is of ``n_locked``. ``n_with_model`` stands beside the medians, as those cover only runs that have an error.
    """
    return _with_shares(_counted(runs, lambda df: df.groupBy(*by)))


def summary_sets(runs: DataFrame, columns: list[str], sets: list[list[str]]) -> DataFrame:
    """``summary`` by several sets of ``columns`` in one scan, with ``level``: bits of the columns that a row is not grouped by, the first one highest.

    A null of a column that is grouped by is a value of its own; the level tells it from the null of one that is not.
    """
    out = _counted(runs, lambda df: df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns)), [F.grouping_id().alias("level")])
    return _with_shares(out)


def _counted(runs: DataFrame, grouped: Callable[[DataFrame], GroupedData], more: list[Column] | None = None) -> DataFrame:
    runs = runs.where(~F.col("verdict").startswith("EXCLUDED"))
    locked = F.col("verdict") != "NO_LOCK"
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in VERDICTS]
    counts += [F.count_if("subpixel").alias("n_subpixel"), F.count_if(locked).alias("n_locked"), F.count_if(locked & F.col("uniform")).alias("n_uniform")]
    medians = [F.median(F.when(locked, F.col(c))).alias(f"median_{c}") for c in ("err", "n_inliers", "total_ms")] + [F.count(F.when(locked, F.col("err"))).alias("n_with_model")]
    return grouped(runs).agg(*(more or []), F.count(F.lit(1)).alias("n"), *counts, *medians)


def _with_shares(out: DataFrame) -> DataFrame:
    shares = {"rate": ("n_success", "n"), "subpixel": ("n_subpixel", "n"), "uniform": ("n_uniform", "n_locked")}
    for name, (k, n) in shares.items():
        lo, hi = wilson(F.col(k), F.col(n))
        out = out.withColumns({name: F.try_divide(F.col(k).cast("double"), F.col(n)), f"{name}_low": lo, f"{name}_high": hi})
    return out


def trust_gates(runs: DataFrame, gates: dict[str, Column], correct: Column) -> DataFrame:
    """What each gate accepts: one scan, one row per gate."""
    run = runs.where("has_model").withColumn("_right", F.coalesce(correct, F.lit(False)))
    right = F.col("_right")
    sums = []
    for k, g in gates.items():
        ok = F.coalesce(g, F.lit(False))
        sums += [F.count_if(ok).alias(f"{k}_a"), F.count_if(ok & ~right).alias(f"{k}_w"), F.count_if(~ok & right).alias(f"{k}_r")]
    row = run.agg(*sums, F.count_if(~right).alias("wrong_total"), F.count(F.lit(1)).alias("with_model"))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), F.col(f"{k}_a").alias("accepted"), F.col(f"{k}_w").alias("accepted_but_wrong"), F.col(f"{k}_r").alias("right_but_rejected")) for k in gates)))
    out = row.select(rows.alias("g"), "wrong_total", "with_model").select("g.*", "wrong_total", "with_model")
    return out.withColumn("precision", F.round(F.try_divide((F.col("accepted") - F.col("accepted_but_wrong")).cast("double"), F.col("accepted")), 4))


def policy(runs: DataFrame, arms: list[str]) -> DataFrame:
    """Per instance, what two arms together and each of ``arms`` alone would do: (id, family, split, policy, policy_status, arm, err).

    An arm is accepted with a known error, 15 inliers and a sound fit. Two accepted arms whose maps agree within 3 px are
    CONFIRMED, one accepted arm alone is UNCONFIRMED, two that differ DISAGREE, none is REJECT; the one with the most inliers is
    taken, the first by name of equals. An arm alone is ACCEPT or REJECT. ``arm`` and ``err`` are null where nothing is taken.
    """
    ok = accepted_arm(F.col("degenerate"), F.col("n_inliers"), F.col("err"))
    alone = [F.max(F.when(ok & (F.col("arm") == a), F.struct("arm", "err"))).alias(f"b{i}") for i, a in enumerate(arms)]
    best = F.min(F.when(ok, F.struct((-F.col("n_inliers")).alias("few"), "arm", "err"))).alias("best")
    maps = F.count_if("has_model")
    rows = runs.groupBy("id", "family", "split").agg(F.count_if(ok).alias("accepted"), F.when(maps >= 2, F.min("agree_px")).alias("agree"), best, *alone)
    status = F.when((F.col("accepted") >= 2) & (F.col("agree") <= 3), "CONFIRMED").when(F.col("accepted") == 1, "UNCONFIRMED").when(F.col("accepted") >= 2, "DISAGREE").otherwise("REJECT")
    each = [F.struct(F.lit("both").alias("policy"), status.alias("policy_status"), F.col("best.arm").alias("arm"), F.col("best.err").alias("err"))]
    for i, a in enumerate(arms):
        each.append(F.struct(F.lit(f"only_{a}").alias("policy"), F.when(F.col(f"b{i}").isNull(), "REJECT").otherwise("ACCEPT").alias("policy_status"), F.col(f"b{i}.arm").alias("arm"), F.col(f"b{i}.err").alias("err")))
    return rows.select("id", "family", "split", F.explode(F.array(*each)).alias("p")).select("id", "family", "split", "p.*")


def residual_coherence(points: DataFrame, by: str, k: int = 8) -> DataFrame:
    """Correlation of each residual with the mean of its ``k`` nearest neighbours, averaged over x and y.

    Points are (``by``, idx, x, y, rx, ry), idx being unique in a run. Neighbours are exact, at any distance, by squared distance, ties by idx
    (``neighbour_means``). Groups of fewer than 40 points are left out.
    """
    many = points.groupBy(by).agg(F.count(F.lit(1)).alias("m")).where("m >= 40").select(by)
    near = neighbour_means(points.join(F.broadcast(many), by), by, k)
    return near.groupBy(by).agg(((F.corr("rx", "mx") + F.corr("ry", "my")) / 2).alias("coherence"), F.count(F.lit(1)).alias("n"))
