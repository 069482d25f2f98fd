"""Exact percentiles of groups of any size: ranks are narrowed down by histograms, so no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrakey.operators.rounds import cut

#: Bins of a histogram, values that are sorted at the end, and the bytes of the tables read from which groups are narrowed down.
BINS, FEW, LARGE = 256, 2048, 128 << 20


def is_large(df: DataFrame) -> bool:
    """Whether the tables that a plan reads are so large that a group may not fit a task; nothing is run for it. Rows of unknown size count for nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(x for x in sizes if x < 1 << 60) > LARGE


def percentiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], narrow: bool | None = None) -> DataFrame:
    """(by, names of ``at``): interpolated percentiles of ``value`` in each group, null where a group has none.

    Usual tables go through Spark's own aggregate, which gathers a group's distinct values in a task. A large one (``is_large``, or as ``narrow`` says) is
    read some times instead: each time a histogram between the bounds of every wanted rank says in which bin it lies, until few values are left. Both give the same.
    """
    if not (is_large(df) if narrow is None else narrow):
        return df.groupBy(*by).agg(*(F.percentile(value, q).alias(n) for n, q in at.items()))
    rows = df.select(F.to_json(F.struct(*by)).alias("g"), *by, F.col(value).cast("double").alias("v"))
    rows = cut(rows)
    good = rows.where("v is not null and not isnan(v)").select("g", "v")
    sizes = cut(good.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    wanted = F.array_distinct(F.concat(*(F.array(F.floor(place(q)), F.ceil(place(q))) for q in at.values())))
    state = cut(sizes.select("g", F.explode(wanted).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("left")))
    found = None
    while True:
        settled = state.where("lo = hi").select("g", "rank", F.col("lo").alias("v"))
        found = settled if found is None else found.unionByName(settled)
        short = state.where(f"lo < hi and left <= {FEW}")
        w = Window.partitionBy("g", "rank").orderBy("v")
        last = good.join(F.broadcast(short), "g").where("v >= lo and v <= hi").withColumn("at", F.row_number().over(w) - 1)
        found = cut(found.unionByName(last.where("at = rank - before").select("g", "rank", "v")))
        state = state.where(f"lo < hi and left > {FEW}")
        if state.isEmpty():
            break
        span = F.col("hi") - F.col("lo")
        cell = F.least(F.floor((F.col("v") - F.col("lo")) / span * BINS), F.lit(BINS - 1))
        bins = good.join(F.broadcast(state), "g").where("v >= lo and v <= hi").groupBy("g", "rank", "before", cell.alias("cell"))
        bins = bins.agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("g", "rank").orderBy("cell"))
        bins = bins.withColumn("end", F.col("before") + upto).where((F.col("end") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("end")))
        state = cut(bins.select("g", "rank", "lo", "hi", (F.col("end") - F.col("c")).alias("before"), F.col("c").alias("left")))
    values = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of")).join(sizes.select("g", "n"), "g")

    def interpolated(q: float) -> F.Column:
        low, high = (F.try_element_at("of", f(place(q))) for f in (F.floor, F.ceil))
        return low + (high - low) * (place(q) - F.floor(place(q)))

    groups = rows.select("g", *by).distinct()
    return groups.join(values, "g", "left").select(*by, *(interpolated(q).alias(n) for n, q in at.items()))
