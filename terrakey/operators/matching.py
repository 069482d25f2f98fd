"""Exact nearest neighbours of descriptors, and the ratio test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def knn(a: DataFrame, b: DataFrame, k: int = 2, block: int = 2048, sizes: DataFrame | None = None, squared: bool = False) -> DataFrame:
    """The ``k`` nearest rows of ``b`` for each row of ``a`` within a run, by Euclidean distance.

    Both sides have ``run``, ``idx`` and ``desc`` (array of doubles). Runs are cut into blocks of about ``block`` rows on
    either side; a task holds one pair of blocks and multiplies matrices, then the best of all blocks are merged by rank. Ties
    go to the smaller index of ``b``. Rows without descriptor take no part. ``sizes`` (run, na, nb), if known, are the rows of
    either side, and save counting them. ``squared`` ranks by the squares, which differ where roots may round to one number,
    and gives them as ``dist``.

    (run, idx_a, idx_b, dist, rank from 1).
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("run").isNotNull() & F.col("desc").isNotNull()).groupBy("run").agg(F.count(F.lit(1)).alias(name))

    if sizes is None:
        sizes = counted(a, "na").join(counted(b, "nb"), "run")
    both = sizes.select("run", *(F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("na", "nb")))

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        df = df.where("desc is not null").alias("one").join(both.alias("two"), F.col("one.run") == F.col("two.run")).select("one.*", "na", "nb").withColumn(mine, F.pmod(F.xxhash64("idx"), F.col(own)).cast("int"))
        return df.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("run", "idx", "desc", "ba", "bb")

    left, right = dealt(a, "na", "nb", "ba", "bb"), dealt(b, "nb", "na", "bb", "ba").toDF("run_r", "idx_r", "desc_r", "ba_r", "bb_r")
    run_type, ia, ib = a.schema["run"].dataType.simpleString(), a.schema["idx"].dataType.simpleString(), b.schema["idx"].dataType.simpleString()

    measure = (lambda d: d) if squared else np.sqrt

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"run": [], "idx_a": [], "idx_b": [], "dist": []})
        p, q = np.stack(x["desc"].to_numpy()).astype(float), np.stack(y["desc_r"].to_numpy()).astype(float)
        order = np.argsort(y["idx_r"].to_numpy(), kind="stable")
        q, at = q[order], y["idx_r"].to_numpy()[order]
        m = min(k + 4, len(q))
        if p.shape[1] <= 4:  # exact at once, coordinate by coordinate
            rough = sum((p[:, None, j] - q[:, j]) ** 2 for j in range(p.shape[1]))
        else:
            rough = (p * p).sum(axis=1)[:, None] - 2 * p @ q.T + (q * q).sum(axis=1)
        near = np.sort(np.argpartition(rough, m - 1, axis=1)[:, :m], axis=1)
        exact = measure(((p[:, None, :] - q[near]) ** 2).sum(axis=2))
        pick = np.argsort(exact, axis=1, kind="stable")[:, :k]
        # Where the last of these ties with what was left out, all of them are sorted.
        last = np.take_along_axis(near, np.argmax(np.take_along_axis(rough, near, axis=1), axis=1)[:, None], axis=1)
        worst, kth = np.take_along_axis(rough, last, axis=1), np.take_along_axis(rough, np.take_along_axis(near, pick[:, -1:], axis=1), axis=1)
        tied = np.flatnonzero((kth >= worst)[:, 0]) if m < len(q) else []
        if len(tied):
            near, exact = near.copy(), exact.copy()
            for i in tied:
                d = measure(((p[i] - q) ** 2).sum(axis=1))
                near[i] = np.argsort(d, kind="stable")[:m]
                exact[i] = d[near[i]]
            pick[tied] = np.arange(pick.shape[1])
        rows = np.repeat(np.arange(len(p)), pick.shape[1])
        return pd.DataFrame({"run": x["run"].iloc[0], "idx_a": x["idx"].to_numpy()[rows], "idx_b": at[np.take_along_axis(near, pick, axis=1).ravel()], "dist": np.take_along_axis(exact, pick, axis=1).ravel()})

    found = left.groupBy("run", "ba", "bb").cogroup(right.groupBy("run_r", "ba_r", "bb_r")).applyInPandas(meet, f"run {run_type}, idx_a {ia}, idx_b {ib}, dist double")
    rank = F.row_number().over(Window.partitionBy("run", "idx_a").orderBy("dist", "idx_b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def ratio_test(neighbours: DataFrame, ratio: float = 0.8, floor: float = 0.0) -> DataFrame:
    """Matches whose nearest neighbour is clearly nearer than the second: (run, idx_a, idx_b, d1, d2, confidence).

    A second distance of zero is no evidence and gives no match; confidence is one less the ratio, within 0 to 1. Several
    rows may share a match.
    """
    first = F.max(F.when(F.col("rank") == 1, F.col("idx_b")))
    d1, d2 = F.max(F.when(F.col("rank") == 1, F.col("dist"))), F.max(F.when(F.col("rank") == 2, F.col("dist")))
    rows = neighbours.groupBy("run", "idx_a").agg(first.alias("idx_b"), d1.alias("d1"), d2.alias("d2"))
    rows = rows.where((F.col("d2") > 0) & (F.try_divide("d1", "d2") < ratio))
    confidence = F.least(F.greatest(1 - F.col("d1") / F.col("d2"), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("confidence", confidence).where(F.col("confidence") >= floor)


def keypoint_budget(points: DataFrame, limit: int) -> DataFrame:
    """The strongest ``limit`` keypoints of each run by ``response``; ties by index."""
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("response"), "idx"))
    return points.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def error_stats(errors: DataFrame, by: list[str], col: str = "err") -> DataFrame:
    """Root mean square, median, 90th percentile, largest and number of residuals; null, not 0, without any."""
    e = F.col(col)
    return errors.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.median(e).alias("median"), F.percentile(e, 0.9).alias("p90"), F.max(e).alias("max"), F.count(e).alias("n")
    )
