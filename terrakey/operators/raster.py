"""Rasters in long form: rows (tile, x, y, v), one per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrakey.operators.order import is_large, percentiles


def to_uint8(px: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(tile, x, y, u): values stretched from the two percentiles to 0..255, cut off and truncated.

    Values that are not finite take no part. A tile whose percentiles coincide is stretched from its extremes; a constant
    tile is 0.
    """
    px = px.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    ends = [F.min("v").alias("vmin"), F.max("v").alias("vmax")]
    if is_large(px):
        limits = percentiles(px, ["tile"], "v", {"lo": low, "hi": high}).join(px.groupBy("tile").agg(*ends), "tile")
        limits = limits.withColumns({c: F.round(c, 6) for c in ("lo", "hi")})
    else:
        limits = px.groupBy("tile").agg(F.round(F.percentile("v", low), 6).alias("lo"), F.round(F.percentile("v", high), 6).alias("hi"), *ends)
    flat = F.col("hi") <= F.col("lo")
    a, b = F.when(flat, F.col("vmin")).otherwise(F.col("lo")), F.when(flat, F.col("vmax")).otherwise(F.col("hi"))
    share = F.coalesce(F.try_divide(F.col("v") - a, b - a), F.lit(0.0))
    return px.join(limits, "tile").select("tile", "x", "y", F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 255).cast("int").alias("u"))


def filled(u: DataFrame, width: int, height: int) -> DataFrame:
    """All cells of each tile; those without a row are 0."""
    grid = u.select("tile").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    grid = grid.withColumns({c: F.col(c).cast(u.schema[c].dataType) for c in ("x", "y")})
    return grid.join(u, ["tile", "x", "y"], "left").fillna(0, ["u"])


def usable_fraction(u: DataFrame) -> DataFrame:
    """Share of cells that are neither black nor blown out."""
    return u.groupBy("tile").agg(F.avg(((F.col("u") > 4) & (F.col("u") < 252)).cast("double")).alias("usable"))


def texture_score(u: DataFrame) -> DataFrame:
    """Mean length of the gradient: central differences inside, one-sided at edges."""

    def slope(line: str, along: str) -> F.Column:
        w = Window.partitionBy("tile", line).orderBy(along)
        before, after = F.lag("u").over(w), F.lead("u").over(w)
        step = F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
        return (F.coalesce(after, F.col("u")) - F.coalesce(before, F.col("u"))) / step

    return u.select("tile", slope("y", "x").alias("gx"), slope("x", "y").alias("gy")).groupBy("tile").agg(F.avg(F.hypot("gx", "gy")).alias("texture"))


def tile_quality(u: DataFrame, usable: float = 0.55, texture: float = 3.0) -> DataFrame:
    """(tile, quality): the first of the reasons unusable and flat, else good."""
    both = usable_fraction(u).join(texture_score(u), "tile")
    return both.select("tile", F.when(F.col("usable") < usable, "unusable").when(F.col("texture") < texture, "flat").otherwise("good").alias("quality"))


def masked_ncc(pairs: DataFrame, by: list[str], a: str, b: str, least: int = 1000) -> DataFrame:
    """Correlation over valid pairs; null for fewer than ``least`` pairs or without variance."""
    spread = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return pairs.groupBy(*by).agg(F.when((F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()) >= least) & spread, F.corr(a, b)).alias("ncc"))


def band_mean(cube: DataFrame, low: int, high: int) -> DataFrame:
    """Mean of the bands from ``low`` up to ``high``, cell by cell."""
    return cube.where((F.col("band") >= low) & (F.col("band") < high)).groupBy("x", "y").agg(F.avg("v").alias("v"))


def area_resize(px: DataFrame, factor: int) -> DataFrame:
    """Means over blocks of ``factor`` by ``factor`` cells."""
    return px.groupBy("tile", F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y")).agg(F.avg("v").alias("v"))


def peak_ambiguity(surface: DataFrame, radius: float) -> DataFrame:
    """(tile, peak_x, peak_y, peak, ratio, z): the peak against the runner-up outside a disc, and in standard deviations.

    The ratio is infinite where the runner-up is all but zero. Of equal peaks the one with the smallest x, then y counts.
    """
    best = F.max(F.struct("v", (-F.col("x")).alias("nx"), (-F.col("y")).alias("ny"))).alias("b")
    top = surface.groupBy("tile").agg(best, F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    top = top.select("tile", (-F.col("b.nx")).alias("peak_x"), (-F.col("b.ny")).alias("peak_y"), F.col("b.v").alias("peak"), "mean", "std")
    near = F.pow(F.col("x") - F.col("peak_x"), 2) + F.pow(F.col("y") - F.col("peak_y"), 2) <= radius * radius
    runner = surface.join(top.select("tile", "peak_x", "peak_y"), "tile").groupBy("tile").agg(F.max(F.when(near, 0.0).otherwise(F.col("v"))).alias("runner"))
    ratio = F.when(F.col("runner") <= 1e-6, float("inf")).otherwise(F.try_divide("peak", "runner"))
    return top.join(runner, "tile").select("tile", "peak_x", "peak_y", "peak", ratio.alias("ratio"), F.try_divide(F.col("peak") - F.col("mean"), F.col("std")).alias("z"))
