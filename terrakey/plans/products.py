"""Queries on products as files: windows on demand, and locks from labels. The files are written from the tables first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.functions.ground import M_PER_DEG_LAT
from terrakey.operators import alignment, instances
from terrakey.operators.rounds import cut, fresh_path
from terrakey.plans.alignment import SIDE, scenes
from terrakey.plans.common import Registry, r, table
from terrakey.plans.raster import _B, bands
from terrakey.sources.archives import refresh_small
from terrakey.sources.windows import read_windows, write_rasters

query = Registry()

#: Bands of the cube and cells on a side.
BANDS, CELLS = 7, 64


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product of seven bands of 64 x 64 cells of tenths of mean prices, empty cells 0: (name, path, bytes)."""
    cells = bands(spark, sf_dir).select(F.lit("cube").alias("name"), (F.col("band") - 1).alias("band"), "x", "y", F.floor(F.col("v") / 10).cast("int").alias("v"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((BANDS, CELLS, CELLS), "<u2")
        v[pdf["band"], pdf["y"], pdf["x"]] = pdf["v"]
        return pd.DataFrame({"name": ["cube"], "pixels": [v.tobytes()]})

    images = cells.groupBy("name").applyInPandas(pack, "name string, pixels binary")
    return cut(write_rasters(images, fresh_path(spark, "rasters")))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of the cube for every part, some over its edges or outside; bands as asked, some beyond what there is."""
    p = F.col("p_partkey")
    s0, l0 = p * 7 % 90 - 12, p * 11 % 84 - 9
    return table(spark, sf_dir, "part").select(
        p.alias("id"), s0.cast("int").alias("sample0"), l0.cast("int").alias("line0"), (s0 + 3 + p % 20).cast("int").alias("sample1"), (l0 + 2 + p % 17).cast("int").alias("line1"),
        (p % 11 - 2).cast("int").alias("band_lo"), (p % 11 - 2 + p % 4).cast("int").alias("band_hi"),
    )


@query(f"""{_B}, g AS (SELECT b.band, y.y, x.x, coalesce(CAST(floor(v / 10) AS INTEGER), 0) AS v FROM (SELECT unnest(range(0, {BANDS})) AS band) b CROSS JOIN (SELECT unnest(range(0, {CELLS})) AS y) y CROSS JOIN (SELECT unnest(range(0, {CELLS})) AS x) x
LEFT JOIN bd ON bd.band - 1 = b.band AND bd.x = x.x AND bd.y = y.y),
q AS (SELECT p_partkey AS id, p_partkey * 7 % 90 - 12 AS s, p_partkey * 11 % 84 - 9 AS l, 3 + p_partkey % 20 AS w, 2 + p_partkey % 17 AS h, greatest(0, least({BANDS - 1}, p_partkey % 11 - 2)) AS lo, p_partkey % 11 - 2 + p_partkey % 4 AS hi FROM part),
c AS (SELECT id, greatest(0, s) AS s0, greatest(0, l) AS l0, least({CELLS}, s + w) AS s1, least({CELLS}, l + h) AS l1, lo, greatest(lo + 1, least({BANDS}, hi)) AS hi FROM q)
SELECT id, CAST(CASE WHEN s1 > s0 AND l1 > l0 THEN l1 - l0 ELSE 0 END AS INTEGER) AS h, CAST(CASE WHEN s1 > s0 AND l1 > l0 THEN s1 - s0 ELSE 0 END AS INTEGER) AS w, coalesce(sum(v), 0)::BIGINT AS total FROM c LEFT JOIN g ON x >= s0 AND x < s1 AND y >= l0 AND y < l1 AND band >= lo AND band < hi GROUP BY ALL""")
def window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum over its bands of every window that is asked for, from its band means as read from the product's file; one outside it has no cells.

    Means are in 32 bits, so they are off by less than what would change the whole number that the sum is.
    """
    one = cube(spark, sf_dir).select("path", F.lit("UnsignedLSB2").alias("dtype"), F.lit(CELLS).alias("lines"), F.lit(CELLS).alias("samples"), F.lit(BANDS).alias("bands"))
    lo = F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), F.col("band_lo")))
    windows = asked(spark, sf_dir).withColumn("depth", F.greatest(lo + 1, F.least(F.lit(BANDS), F.col("band_hi"))) - lo)
    windows = read_windows(windows.join(F.broadcast(one)), ["id", "depth"])

    def total(batches):
        for pdf in batches:
            sums = [0 if x is None else round(float(np.frombuffer(x, t).sum(dtype=float)) * d) for x, t, d in zip(pdf["pixels"], pdf["pixel_type"], pdf["depth"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "h": pdf["h"].fillna(0).astype(int), "w": pdf["w"].fillna(0).astype(int), "total": sums})

    return windows.mapInPandas(total, "id long, h int, w int, total long")


@query()
def lock_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scene and the same scene moved are products on disk, whose labels err by the move; the lock finds it."""
    s = scenes(spark, sf_dir, both=False)

    def moved(batches):
        for pdf in batches:
            for x in pdf.to_dict("records"):
                img = np.frombuffer(x["pixels_a"], np.uint8).reshape(x["h_a"], x["w_a"])
                other = np.roll(img, (int(x["seed"]) % 9 - 4, int(x["seed"]) % 13 - 6), (0, 1))
                yield pd.DataFrame({"name": [f"{x['id']}_a", f"{x['id']}_b"], "pixels": [img.tobytes(), other.tobytes()]})

    files = cut(write_rasters(s.mapInPandas(moved, "name string, pixels binary"), fresh_path(spark, "strips")))
    step = (SIDE - 1) / M_PER_DEG_LAT
    corner = {"ul": (0.0, 0.0), "ur": (step, 0.0), "ll": (0.0, -step), "lr": (step, -step)}
    places = {f"{c}_{x}": F.lit(v) for c, both in corner.items() for x, v in zip(("lon", "lat"), both, strict=True)}
    products = files.select(F.col("name").alias("product"), "path", F.lit("UnsignedByte").alias("dtype"), F.lit(SIDE).alias("lines"), F.lit(SIDE).alias("samples")).withColumns(places)
    # Names come from what was written, as the scenes would be drawn again for theirs.
    ids = files.where(F.col("name").endswith("_a")).select(F.expr("left(name, length(name) - 2)").alias("run")).select("run", F.concat("run", F.lit("_a")).alias("a"), F.concat("run", F.lit("_b")).alias("b"), F.lit(step / 2).alias("lon"), F.lit(-step / 2).alias("lat"))
    out = alignment.lock_products(ids, products, tile=96, across_m=24.0, along_m=24.0, decimation=2)
    return out.select("run", "decision", *(r(c, 3).alias(c) for c in ("peak", "dx", "dy", "shift_m_across", "shift_m_along", "gsd_ratio")), "window_a", "window_b")


def strips(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Every scene as a product on disk, with a corner at the origin: (product, path, dtype, lines, samples, corners)."""
    images = scenes(spark, sf_dir, both=False).select(F.col("id").alias("name"), F.col("pixels_a").alias("pixels"))
    files = cut(write_rasters(images, root))
    step = (SIDE - 1) / M_PER_DEG_LAT
    corner = {"ul": (0.0, 0.0), "ur": (step, 0.0), "ll": (0.0, -step), "lr": (step, -step)}
    places = {f"{c}_{x}": F.lit(v) for c, both in corner.items() for x, v in zip(("lon", "lat"), both, strict=True)}
    return files.select(F.col("name").alias("product"), "path", F.lit("UnsignedByte").alias("dtype"), F.lit(SIDE).alias("lines"), F.lit(SIDE).alias("samples")).withColumns(places)


@query()
def family_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of every made family from every scene's product: sensors, suns, turns and zooms."""
    p = strips(spark, sf_dir, fresh_path(spark, "sources"))
    sources = p.select(F.col("product").alias("source"), "path", "dtype", "lines", "samples", F.lit(0.5).alias("gsd"), F.lit(0.5).alias("line_share"), (F.crc32(F.col("product").cast("binary")) % 10).cast("int").alias("loc_index"))
    out = instances.made_instances(sources, tile=64)
    return out.select("id", "family", "provenance", "split", "source", "level_name", "level", "status", "h_a", "h_b", *(r(c, 3).alias(c) for c in ("texture", "texture_b", "usable_a", "usable_b", "shadow_a", "shadow_b", "gsd_ratio")))


@query()
def location_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each scene's product and the next one's, laid over each other, have the most structure."""
    p = strips(spark, sf_dir, fresh_path(spark, "sources"))
    number = F.substring("product", 2, 6).cast("int")
    pairs = p.select(F.col("product").alias("run"), F.col("product").alias("a"), F.format_string("i%06d", number + 1 - 2 * (number % 2)).alias("b"))
    return instances.pick_locations(pairs, p, tile=32, probe=64).select("run", r("lon", 9).alias("lon"), r("lat", 9).alias("lat"), r("score", 3).alias("score"), "probed")


@query()
def small_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small images of all products, made where they were missing."""
    root = fresh_path(spark, "sources")
    p = strips(spark, sf_dir, root)
    return refresh_small(p.select(F.col("product").alias("name"), "path", "lines", "samples"), root, fresh_path(spark, "small"), 80).select("name", "bytes")
