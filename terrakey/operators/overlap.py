"""Spatial range join of footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakey.operators.rounds import cut

SIDES = ["lon_min", "lon_max", "lat_min", "lat_max"]


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long")))


#: Rows of a block on either side of a join of equal boxes, and pairs that a task gives, about.
BLOCK, PAIRS = 1024, 1 << 21


def box_pairs(a: DataFrame, b: DataFrame, cell: float = 4.0) -> DataFrame:
    """Different boxes that overlap, each once however many rows have it: (a: struct of SIDES, na, b, nb, lon_min, lon_max, lat_min, lat_max), n* being its rows.

    Boxes are written to the grid cells that they cover and meet by an
    equi-join on the cell; a pair comes out only in the cell that holds the lower left corner of the overlap, so there are no
    duplicates to remove and no comparison of all pairs. Choose ``cell`` at about the size of a box.
    """

    def side(df: DataFrame, s: str) -> DataFrame:
        df = df.groupBy(F.struct(*SIDES).alias(s)).agg(F.count(F.lit(1)).alias(f"n{s}")).select(s, f"n{s}", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in SIDES))
        return df.withColumn("cx", _cells(F.col(f"lon_min_{s}"), F.col(f"lon_max_{s}"), cell)).withColumn("cy", _cells(F.col(f"lat_min_{s}"), F.col(f"lat_max_{s}"), cell))

    lo = lambda c: F.greatest(f"{c}_min_a", f"{c}_min_b")
    hi = lambda c: F.least(f"{c}_max_a", f"{c}_max_b")
    pairs = side(a, "a").join(side(b, "b"), ["cx", "cy"])
    pairs = pairs.where((lo("lon") < hi("lon")) & (lo("lat") < hi("lat")))
    pairs = pairs.where((F.floor(lo("lon") / cell) == F.col("cx")) & (F.floor(lo("lat") / cell) == F.col("cy")))
    return pairs.select("a", "na", "b", "nb", lo("lon").alias("lon_min"), hi("lon").alias("lon_max"), lo("lat").alias("lat_min"), hi("lat").alias("lat_max"))


def overlap_join(a: DataFrame, b: DataFrame, cell: float = 4.0, more: dict[str, Column] | None = None) -> DataFrame:
    """Pairs of boxes that overlap; touching edges do not count.

    Both sides have ``id`` and the columns SIDES. Different boxes meet first (``box_pairs``), then the rows that have them, in
    blocks of about ``BLOCK`` rows of either side, so what one task gives does not depend on how many rows share a box or
    a region. Tasks are dealt by the number of pairs, which grows with the product of both sides. Boxes with nulls overlap nothing.

    (id_a, id_b, lon_min, lon_max, lat_min, lat_max) of the overlaps, and ``more`` columns of these bounds, worked out once for each pair of different boxes.
    """
    full = lambda df: df.where(" and ".join(f"{c} is not null" for c in SIDES))
    a, b, more = full(a), full(b), more or {}
    met = cut(box_pairs(a, b, cell).withColumns(more).withColumn("pair", F.monotonically_increasing_id()))
    parts = {s: F.ceil(F.col(f"n{s}") / BLOCK).cast("int") for s in "ab"}
    pairs, blocks = met.agg(F.sum(F.col("na") * F.col("nb")), F.sum(parts["a"] * parts["b"])).first()
    n = max(1, min(-(-(pairs or 0) // PAIRS), blocks or 0))
    keep, key = ["lon_min", "lon_max", "lat_min", "lat_max", *more], ["pair", "pa", "pb"]

    def dealt(df: DataFrame, own: str, other: str, columns: list[str]) -> DataFrame:
        rows = df.select(F.struct(*SIDES).alias(own), F.col("id").alias(f"id_{own}"))
        rows = rows.join(met.select("pair", own, "na", "nb", *columns), own).withColumn(f"p{own}", F.pmod(F.xxhash64(f"id_{own}"), parts[own]).cast("int"))
        return rows.withColumn(f"p{other}", F.explode(F.sequence(F.lit(0), parts[other] - 1))).select(*key, f"id_{own}", *columns).repartition(n, *key)

    return dealt(a, "a", "b", keep).join(dealt(b, "b", "a", []), key).select("id_a", "id_b", *keep)
