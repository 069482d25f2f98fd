"""Queries from pixels to metrics. Kernels are beyond SQL; tests hold them against known answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.operators import alignment, arms
from terrakey.operators import evaluation as ops
from terrakey.operators import kernels as k
from terrakey.operators.registration import map_tiles
from terrakey.operators.rounds import cut, framed, fresh_path, tasks
from terrakey.plans.common import Registry, r, table
from terrakey.plans.registration import tiles

query = Registry()

#: The fixture's second images are the tiles moved by so much.
MOVE = np.array([[1.0, 0.0, 5.0], [0.0, 1.0, -3.0], [0.0, 0.0, 1.0]])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile and the same tile moved."""
    t = tiles(spark, sf_dir)
    moved = map_tiles(t, lambda img, _: k.warp(img, MOVE, img.shape, mirror=True).astype(np.uint8))
    a, b = (df.toDF("pair", f"h_{s}", f"w_{s}", f"pixels_{s}") for df, s in ((t, "a"), (moved, "b")))
    return a.join(b, "pair")


@query()
def detect_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoints of both images of every pair."""
    return alignment.keypoints(pairs(spark, sf_dir)).select("run", "side", "idx", r("x", 3).alias("x"), r("y", 3).alias("y"))


@query()
def match_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pixels to metrics in one call."""
    out = alignment.match_pairs(pairs(spark, sf_dir))
    return out.select("run", "n_keypoints_a", "n_keypoints_b", "n_matches", "n_inliers", *(r(c, 4).alias(c) for c in ("inlier_ratio", "rmse", "median", "p90", "max")), "degenerate", "warning", "detector", "note")


@query()
def ncc_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of every pair before and after the known map."""
    p = pairs(spark, sf_dir)
    maps = p.select(F.col("pair").cast("string").alias("run"), F.array(*(F.lit(float(x)) for x in MOVE.ravel())).alias("h"))
    return alignment.ncc_before_after(p, maps).select("run", *(r(c, 4).alias(c) for c in ("ncc_before", "ncc_after")))


@query()
def locate_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile is sought in the same tile moved; the shift is that of the fixture, the other way round."""
    places = {c: F.lit(32) for c in ("x_a", "y_a", "x_b", "y_b")} | {"gsd_a": F.lit(1.0), "gsd_b": F.lit(1.0)}
    out = alignment.locate_overlap(pairs(spark, sf_dir).withColumns(places), tile=32, across_m=12.0, along_m=12.0, decimation=1)
    return out.select("run", "decision", *(r(c, 3).alias(c) for c in ("peak", "ratio", "z", "dx", "dy", "shift_m_across", "shift_m_along", "gsd_ratio")), "window_a", "window_b")


#: Side of a scene, and orders that one is drawn from, about.
SIDE, ORDERS = 256, 750


def scenes(spark: SparkSession, sf_dir: str, both: bool = True) -> DataFrame:
    """Instances (id, ..., images): a scene for some hundred orders, drawn as bumps, and the same scene turned, scaled or lit otherwise.

    The number of scenes grows with the orders. Families: near (a small turn), scale, turn, and blind, whose true map is withheld. Some
    instances have no lock or are excluded. Without ``both`` the second image and the texture are left out.
    """
    orders = table(spark, sf_dir, "orders")
    n = max(2, orders.count() // ORDERS)
    key = F.col("o_orderkey")
    dots = orders.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("scene"), F.col("o_custkey").alias("c"), key.alias("o"), F.col("o_totalprice").cast("double").alias("v"))
    dots = dots.repartition(tasks(n), "scene").sortWithinPartitions("scene", "o")  # some scenes a task, whatever their bytes

    def draw(pdf: pd.DataFrame) -> dict:
        i, img = int(pdf["scene"].iloc[0]), np.zeros((SIDE, SIDE))
        where = np.random.default_rng(i).integers(0, SIDE, (len(pdf), 2))
        strength = pdf["v"].to_numpy() / 1e5 * np.where(pdf["c"].to_numpy() % 2 == 0, 1, -1)
        for part, sigma in enumerate((2.0, 3.5, 6.0)):
            dots = np.zeros((SIDE, SIDE))
            own = pdf["o"].to_numpy() % 3 == part
            np.add.at(dots, (where[own, 0], where[own, 1]), strength[own] * sigma**2)
            img += k.blur(dots, sigma)
        a, family = k.stretch(img), ("near", "scale", "turn", "blind")[i % 4]
        angle, size = np.radians({"near": 2, "scale": 5, "turn": 25 + i % 30, "blind": 3}[family]), 1.4 if family == "scale" else 1.0
        c, s, mid = size * np.cos(angle), size * np.sin(angle), (SIDE - 1) / 2
        h = np.array([[c, -s, mid - c * mid + s * mid + i % 7], [s, c, mid - s * mid - c * mid - i % 5], [0, 0, 1]])
        b = np.clip(k.warp(a, h, a.shape, mirror=True) * 0.9 + 8, 0, 255).astype(np.uint8) if both else None
        status = "NO_LOCK" if i % 19 == 7 else "FILL" if i % 23 == 11 else "OK"
        row = {"id": f"i{i:06d}", "family": family, "provenance": "drawn", "split": "test" if i % 3 == 0 else "dev", "seed": i, "status": status, "texture": k.texture(a) if both else None, "h_true": None if family == "blind" else h.ravel().tolist()}
        row |= {f"{c}_{s}": v for s, x in (("a", a), ("b", b)) for c, v in (("h", SIDE), ("w", SIDE), ("pixels", None if x is None else x.tobytes()))}
        return row

    def scenes_of(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        """A scene's dots lie together, but may come in several batches."""
        last = None
        for pdf in batches:
            if last is not None:
                pdf = pd.concat([last, pdf], ignore_index=True)
            starts = np.flatnonzero(np.diff(pdf["scene"].to_numpy(), prepend=-1))
            for start, end in zip(starts, starts[1:], strict=False):
                yield draw(pdf.iloc[start:end])
            last = pdf.iloc[starts[-1] :] if len(starts) else None
        if last is not None:
            yield draw(last)

    columns = [*arms.INSTANCE, *(f"{c}_{s}" for s in "ab" for c in ("h", "w", "pixels"))]
    schema = ", ".join(f"{c} {t}" for c, t in arms.INSTANCE.items()) + ", " + ", ".join(f"h_{s} int, w_{s} int, pixels_{s} binary" for s in "ab")
    return dots.mapInPandas(lambda batches: framed(scenes_of(batches), columns), schema)


def judged_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole round of both arms over the scenes, from a new store."""
    path = fresh_path(spark, "round")
    arms.run_arms(cut(scenes(spark, sf_dir)), path, 1)
    return arms.judged(arms.stored(spark, path))


@query()
def match_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scene against its turned or scaled image, from pixels to figures."""
    s = scenes(spark, sf_dir).where("status = 'OK'").withColumn("pair", F.col("id"))
    out = alignment.match_pairs(s)
    return out.select("run", "n_keypoints_a", "n_keypoints_b", "n_matches", "n_inliers", r("rmse", 4).alias("rmse"), "degenerate", "detector", "note")


@query()
def two_arm_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms over all scenes, with errors, agreement, confirmation and verdicts."""
    return judged_round(spark, sf_dir).select("id", "arm", "family", "split", "status", "terrain", "detector", "note", "n_keypoints_a", "n_keypoints_b", "n_matches", "n_inliers", *(r(c, 4).alias(c) for c in ("rmse", "err", "agree_px", "heldout_px", "ncc_before", "ncc_after", "unif_cells", "unif_hull")), "confirmed_by", "verdict", "subpixel", "uniform", "false_confidence")


@query()
def round_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What gates of trust accept in a round with known maps, against what is right."""
    rows = judged_round(spark, sf_dir).where("status = 'OK' and h_true is not null")
    many, near, close = F.col("n_inliers") >= 15, F.col("agree_px") <= 3, F.col("rmse") < 1.5
    return ops.trust_gates(rows, {"rmse": close, "inliers": many, "agree": near, "both": many & near}, F.col("err") <= 2)


@query()
def round_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy of both arms and either alone take in a round."""
    rows = judged_round(spark, sf_dir).where("status = 'OK'")
    return ops.policy(rows, list(arms.ARMS)).groupBy("policy", "policy_status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("err") <= 2).alias("n_right"))


@query()
def round_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arms of a round side by side; the detector that ran counts, not the one asked for."""
    return arms.detectors_compared(judged_round(spark, sf_dir))
