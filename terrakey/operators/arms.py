"""Rounds of evaluation: every instance with every arm, from pixels to verdicts, and resumed where a round was cut short."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.functions import scoring
from terrakey.operators import kernels as k
from terrakey.operators.alignment import RUN_SCHEMA, Detector, Settings, measured_rows
from terrakey.operators.evaluation import other_arm, terrain_tertiles
from terrakey.operators.features import DETECTORS
from terrakey.operators.rounds import tasks

#: Arms: name and the order in which detectors are asked.
ARMS: dict[str, tuple[str, ...]] = {"M1_gradient": ("gradient", "corners"), "M2_corners": ("corners",)}
#: Pairs that a task measures, about, where there are not many, and where there are.
PAIRS, MANY = 8, 128
#: Columns of an instance, beside its images h_a, w_a, pixels_a, h_b, w_b, pixels_b.
INSTANCE = {"id": "string", "family": "string", "provenance": "string", "split": "string", "seed": "int", "status": "string", "texture": "double", "h_true": "array<double>"}
IMAGES = [f"{c}_{s}" for s in "ab" for c in ("h", "w", "pixels")]
STORED = ", ".join(f"{c} {t}" for c, t in INSTANCE.items()) + ", arm string, side_h int, side_w int, " + RUN_SCHEMA + ", round int, config string"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What the store holds; no rows where there is none yet."""
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def run_arms(instances: DataFrame, path: str, number: int, config: str = "default", arms: Mapping[str, Sequence[str]] = ARMS, settings: Settings | None = None, registry: Mapping[str, Detector] = DETECTORS) -> int:
    """Measures what the store at ``path`` lacks of a round, and adds it: how many (instance, arm) that were.

    ``instances`` has the columns of ``INSTANCE`` and the images of both sides. A run that was cut short leaves whole files or none,
    so another call measures the rest; one on a finished round measures nothing and reads no pixels, as only ids meet the store.
    Each pair stays in its task. Instances that are not OK are stored without figures. Null ids are left out; of instances
    with one id and arm each is measured, and judged with whichever comes first.
    """
    spark = instances.sparkSession
    done = stored(spark, path).where((F.col("round") == number) & (F.col("config") == config)).select("id", "arm")
    every = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.array(*(F.lit(x) for x in order)).alias("order")) for a, order in arms.items())))
    asked = instances.where("id is not null").select(*(F.col(c).cast(t).alias(c) for c, t in INSTANCE.items()), *IMAGES)
    wanted = asked.select("id").distinct().select("id", every.alias("x")).select("id", "x.arm", "x.order")
    wanted = wanted.join(done, ["id", "arm"], "left_anti")
    count = wanted.count()
    if not count:
        return 0
    rows, todo = asked, every
    if not done.isEmpty():  # else every arm of every instance is wanted, and images have nothing to meet
        rows, todo = asked.join(wanted.groupBy("id").agg(F.collect_list(F.struct("arm", "order")).alias("todo")), "id"), F.explode("todo")
    ok = F.col("status") == "OK"
    for c in ("pixels_a", "pixels_b"):
        rows = rows.withColumn(c, F.when(ok, F.col(c)))
    # A pair is seconds of work on few bytes: tasks are dealt by the number of pairs, whatever the bytes. Arms part after the shuffle, so pixels move once.
    rows = rows.repartition(tasks(count, PAIRS, MANY), "id")
    rows = rows.withColumn("x", todo).select("*", "x.arm", "x.order").drop("x", "todo")
    rows = rows.withColumns({"side_h": F.col("h_b").cast("int"), "side_w": F.col("w_b").cast("int")})
    out = measured_rows(rows, [*INSTANCE, "arm", "side_h", "side_w"], settings or Settings(), registry, order_col="order", seed_col="seed")
    floats = [f.name for f in out.schema.fields if f.dataType.simpleString() == "double"]
    out = out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in floats})
    out.withColumns({"round": F.lit(number), "config": F.lit(config)}).write.mode("append").partitionBy("round", "config").parquet(path)
    return count


def _disagreements(h: pd.Series, other: pd.Series, rows: pd.Series, cols: pd.Series) -> pd.Series:
    out = []
    for a, b, m, n in zip(h, other, rows, cols, strict=True):
        known = a is not None and b is not None
        out.append(k.disagreement(np.asarray(a, float).reshape(3, 3), np.asarray(b, float).reshape(3, 3), (int(m), int(n))) if known else None)
    return pd.Series(out, dtype="float64")


def disagreement(h: Column, other: Column, rows: Column, cols: Column) -> Column:
    """Mean distance of two maps' origins of a 16 x 16 grid over the second image; null without both."""
    d = F.pandas_udf(_disagreements, "double")(h, other, rows, cols)
    return F.nanvl(d, F.lit(None).cast("double"))


def judged(rows: DataFrame) -> DataFrame:
    """Stored rows of one round with errors against the true map, agreement with the other arm, verdict, flags and terrain.

    Where the truth is known it decides; else the error on held-out matches, confirmed by the other arm's map or by the images'
    correlation. Instances without a lock or excluded keep their rows with that verdict. Only maps and counts meet across arms, no pixels.
    """
    usable = F.coalesce(scoring.usable_arm(F.col("h").isNotNull(), F.col("degenerate"), F.col("n_inliers")), F.lit(False))
    df = other_arm(terrain_tertiles(rows.withColumn("usable", usable)), ["h", "usable", "arm"])
    other_usable = F.coalesce("other_usable", F.lit(False))
    df = df.withColumns({
        "err": disagreement(F.col("h"), F.col("h_true"), F.col("side_h"), F.col("side_w")),
        "agree_px": disagreement(F.col("h"), F.when(other_usable, F.col("other_h")), F.col("side_h"), F.col("side_w")),
    })
    has_model, ok, truth = F.col("h").isNotNull(), F.col("status") == "OK", F.col("h_true").isNotNull()
    confirmed = scoring.confirmed_by(F.col("agree_px"), other_usable, F.col("ncc_after") - F.col("ncc_before"))
    known = scoring.verdict_gt(has_model, F.col("degenerate"), F.col("n_inliers"), F.col("err"))
    blind = scoring.verdict_real(has_model, F.col("n_inliers"), F.col("heldout_px"), confirmed)
    excluded = F.when(F.col("status") == "NO_LOCK", "NO_LOCK").otherwise(F.concat(F.lit("EXCLUDED_"), F.coalesce("status", F.lit("UNKNOWN"))))
    df = df.withColumns({"has_model": has_model, "ncc_gain": F.col("ncc_after") - F.col("ncc_before"), "confirmed_by": F.when(ok & ~truth, confirmed), "verdict": F.when(ok & truth, known).when(ok, blind).otherwise(excluded)})
    error = F.when(truth, F.col("err")).otherwise(F.col("heldout_px"))
    return df.withColumns({
        "subpixel": F.coalesce((F.col("verdict") == "SUCCESS") & (error < 1), F.lit(False)),
        "uniform": F.coalesce(F.col("unif_cells") >= 0.75, F.lit(False)),
        "false_confidence": truth & has_model & F.coalesce(F.round("rmse", 4) < 1.5, F.lit(False)) & F.coalesce(F.col("err") > 10, F.lit(True)),
        "inlier_ratio": F.col("n_inliers") / F.greatest("n_matches", F.lit(1)),
        "total_ms": F.col("pre_ms") + F.col("match_ms") + F.col("fit_ms"),
    }).drop("usable", "other_h", "inliers")


def detectors_compared(rows: DataFrame) -> DataFrame:
    """Judged rows by arm and family: median error, share of successes, and how often another detector than the arm's first one ran."""
    first = F.create_map(*(x for a, order in ARMS.items() for x in (F.lit(a), F.lit(order[0]))))
    fell = (F.col("status") == "OK") & ~F.col("detector").eqNullSafe(F.try_element_at(first, F.col("arm")))
    return rows.where("status = 'OK'").groupBy("arm", "family").agg(F.median("err").alias("median_err"), F.avg((F.col("verdict") == "SUCCESS").cast("double")).alias("success_rate"), F.count_if(fell).alias("n_fallback"), F.count(F.lit(1)).alias("n"))
