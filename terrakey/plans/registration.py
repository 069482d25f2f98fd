"""Queries that run kernels: fits of runs, locks, image operations, labels. Where SQL has no counterpart, tests hold them against known answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.functions import homography as hg
from terrakey.functions import scoring
from terrakey.operators import kernels as k
from terrakey.operators import raster as cells
from terrakey.operators.registration import fit_runs, lock_pairs, map_tiles
from terrakey.operators.registration import greedy_dedup as first_come
from terrakey.plans import matching
from terrakey.plans.common import Registry, r, table
from terrakey.plans.raster import SIDE, pixels
from terrakey.sources.labels import parse

query = Registry()


def spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the fixture, a quarter of them wrong by a shift that varies."""
    wrong = F.when(F.col("idx_a") % 4 == 0, 40 + F.col("idx_a") % 97).otherwise(0)
    return matching.residuals(spark, sf_dir).withColumns({"run": F.col("run").cast("string"), "xb": F.col("xb") + wrong, "yb": F.col("yb") - 2 * wrong})


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_runs(spoiled(spark, sf_dir))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells gathered to images of 64 x 64 bytes: (tile, h, w, pixels)."""
    u = cells.filled(cells.to_uint8(pixels(spark, sf_dir)), SIDE, SIDE)
    rows = u.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("y", "x", "u"))).alias("c")).select("tile", F.col("c.u").alias("u"))

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"tile": pdf["tile"], "h": SIDE, "w": SIDE, "pixels": [np.asarray(x, np.uint8).tobytes() for x in pdf["u"]]})

    return rows.mapInPandas(pack, "tile long, h int, w int, pixels binary")


def stats(images: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            a = [np.frombuffer(x, np.uint8) for x in pdf["pixels"]]
            yield pd.DataFrame({"tile": pdf["tile"], "h": pdf["h"], "w": pdf["w"], "mean": [round(float(x.mean()), 3) for x in a], "std": [round(float(x.std()), 3) for x in a]})

    return images.mapInPandas(run, "tile long, h int, w int, mean double, std double")


@query()
def ransac_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust maps of all runs with their distance to the known map at the image's corners."""
    h = hg.entries(F.col("h"))
    error = F.lit(0.0)
    for x, y in ((0.0, 0.0), (1023.0, 0.0), (0.0, 1023.0), (1023.0, 1023.0)):
        (a, b), (c, d) = hg.apply(h, F.lit(x), F.lit(y)), hg.apply(matching.known(), F.lit(x), F.lit(y))
        error = error + F.hypot(a - c, b - d) / 4
    return fitted(spark, sf_dir).select("run", "n_matches", "n_inliers", "degenerate", r("rmse", 4).alias("rmse"), r(error, 3).alias("corner_px"))


@query()
def heldout_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir).select("run", *(r(c, 6).alias(c) for c in ("heldout_px", "heldout_h", "heldout_hpoly")))


@query()
def map_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir).select("run", r("precision_px", 6).alias("precision_px"))


@query()
def run_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round from matches to verdicts: fit, compare with the known map, judge."""
    df = fitted(spark, sf_dir)
    h, w = hg.entries(F.col("h")), matching.known()
    (a, b), (c, d) = hg.apply(h, F.lit(511.5), F.lit(511.5)), hg.apply(w, F.lit(511.5), F.lit(511.5))
    err = F.hypot(a - c, b - d)
    verdict = scoring.verdict_gt(F.col("h").isNotNull(), F.col("degenerate"), F.col("n_inliers"), err)
    return df.select("run", "n_inliers", r(F.col("n_inliers") / F.greatest("n_matches", F.lit(1)), 4).alias("inlier_ratio"), r(err, 3).alias("err"), verdict.alias("verdict"), "detector")


@query()
def clahe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(map_tiles(tiles(spark, sf_dir), lambda img, _: k.clahe(img)))


@query()
def shadow_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(map_tiles(tiles(spark, sf_dir), lambda img, _: k.shadow_norm(img)))


@query()
def degrade_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(map_tiles(tiles(spark, sf_dir), lambda img, t: k.degrade(img, 4, 1.0, 1.0, int(t["tile"]))))


@query()
def relight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(map_tiles(tiles(spark, sf_dir), lambda img, t: k.relight(img, 90.0, 30.0, int(t["tile"]))))


@query()
def warp_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = np.array([[1, 0.02, 3.0], [-0.02, 1, -2.0], [0, 0, 1]])
    return stats(map_tiles(tiles(spark, sf_dir), lambda img, _: np.clip(k.warp(img, h, img.shape, mirror=True), 0, 255).astype(np.uint8)))


@query()
def ncc_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut-out of each tile is found again in the tile."""
    t = tiles(spark, sf_dir)
    cut = map_tiles(t, lambda img, _: np.ascontiguousarray(img[12:44, 20:52]))
    pairs = t.select(F.col("tile").alias("pair"), F.col("h").alias("h_a"), F.col("w").alias("w_a"), F.col("pixels").alias("pixels_a"))
    pairs = pairs.join(cut.select(F.col("tile").alias("pair"), F.col("h").alias("h_b"), F.col("w").alias("w_b"), F.col("pixels").alias("pixels_b")), "pair")
    return lock_pairs(pairs).select("pair", "x", "y", r("peak", 3).alias("peak"), r("ratio", 3).alias("ratio"), r("z", 3).alias("z"))


@query()
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = e.select(F.col("event_type").alias("family"), F.col("event_id").alias("idx"), (F.col("value") * 40).alias("x"), (F.col("event_id") * 97 % 20000).cast("double").alias("y"))
    return first_come(t)


_XML = (
    '<?xml version="1.0"?><p:Product xmlns:p="urn:p"><logical_identifier>urn:{key}</logical_identifier><start_date_time>2020-01-02T03:04:05Z</start_date_time>'
    "<Observing_System_Component><name>Orbiter</name><type>Spacecraft</type></Observing_System_Component>"
    "<Observing_System_Component><name>TMC-2</name><type>Instrument</type></Observing_System_Component><p:sun_azimuth>{az}</p:sun_azimuth><p:sun_elevation>n/a</p:sun_elevation>"
    "<upper_left_latitude>{lat}</upper_left_latitude><upper_left_longitude> 5.5 </upper_left_longitude><upper_right_latitude></upper_right_latitude><lower_left_latitude>1.5</lower_left_latitude>"
    "<Axis_Array><axis_name>Line</axis_name><elements>{lines}</elements></Axis_Array><Axis_Array><axis_name>Sample</axis_name><elements>0</elements></Axis_Array></p:Product>"
)


@query("""SELECT s_suppkey AS id, 'urn:' || s_suppkey AS product_id, '2020-01-02' AS date, 'TMC-2' AS sensor, s_suppkey * 1.5::DOUBLE AS sun_azimuth, NULL::DOUBLE AS sun_elevation, CAST(1000 + s_suppkey AS INTEGER) AS lines, NULL::INTEGER AS samples,
round((s_suppkey % 7 + 0.0::DOUBLE + 1.5) / 2, 6) AS lat_center, 5.5::DOUBLE AS lon_center FROM supplier""")
def pds4_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with namespaces, blank and missing elements, made from suppliers."""
    key = F.col("s_suppkey")
    parts = {"key": key, "az": key * 1.5, "lat": (key % 7).cast("double"), "lines": 1000 + key}
    xml = F.lit(_XML)
    for name, value in parts.items():
        xml = F.replace(xml, F.lit("{" + name + "}"), value.cast("string"))
    out = parse(table(spark, sf_dir, "supplier").select(key.alias("id"), xml.alias("content")))
    return out.select("id", "product_id", "date", "sensor", "sun_azimuth", "sun_elevation", "lines", "samples", r("lat_center").alias("lat_center"), "lon_center")
