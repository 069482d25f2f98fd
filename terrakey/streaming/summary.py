"""Running summaries of a stream of judged runs. This goes beyond the batch tables that the rest of the engine makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakey.functions.scoring import wilson


def verdict_windows(runs: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs and successes by arm and window of event time, with the interval of the rate; rows later than ``late`` are left out.

    State is one row per arm and open window.
    """
    runs = runs.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = runs.groupBy(F.window("_t", window), "arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "SUCCESS").alias("n_success"))
    low, high = wilson(F.col("n_success"), F.col("n"))
    return out.select(F.col("window.start").alias("start"), "arm", "n", "n_success", low.alias("ci_low"), high.alias("ci_high"))
