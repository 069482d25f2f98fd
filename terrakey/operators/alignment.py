"""Image pairs from pixels to metrics: keypoints, matches, maps; strips locked onto the same ground; correlation before and after.

Pairs are rows (pair, h_a, w_a, pixels_a, h_b, w_b, pixels_b), 8-bit, row by row. A side without pixels is an empty image.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakey.functions.ground import Footprint
from terrakey.functions.scoring import lock_decision
from terrakey.operators import kernels as k
from terrakey.operators.features import DETECTORS, Keypoints, ratio_matches
from terrakey.operators.rounds import cut, framed
from terrakey.sources.windows import read_windows

Detector = Callable[[np.ndarray, int], Keypoints]

#: Detectors in the order in which they are asked.
ORDER = ("gradient", "corners")
WARNING = "too few inliers: the map is not constrained"


def image(p: dict, side: str) -> np.ndarray:
    """One side of a pair; empty if anything of it is missing."""
    pixels, h, w = p[f"pixels_{side}"], p[f"h_{side}"], p[f"w_{side}"]
    if pixels is None or pd.isna(h) or pd.isna(w):
        return np.zeros((0, 0), np.uint8)
    return np.frombuffer(pixels, np.uint8).reshape(int(h), int(w))


@dataclass
class Detection:
    """What the first working detector found on both sides of a pair, in cells of the first image's frame, and what went wrong before it."""

    detector: str | None
    notes: list[str]
    a: Keypoints
    b: Keypoints


def detect(a: np.ndarray, b: np.ndarray, order: Sequence[str], limit: int, max_side: int, registry: Mapping[str, Detector]) -> Detection:
    """Both images by the first detector of ``order`` that exists and does not raise; images above ``max_side`` are resized for it alone."""
    notes: list[str] = []
    for name in order:
        if name not in registry:
            notes.append(f"{name} is not available")
            continue
        try:
            sides = []
            for img in (a, b):
                scale = min(1.0, max_side / max(img.shape))
                small = img if scale == 1 else k.resize(img, tuple(max(1, round(n * scale)) for n in img.shape), "area")
                found = registry[name](small, limit)
                sides.append(replace(found, x=found.x / scale, y=found.y / scale, size=found.size / scale))
        except Exception as e:  # noqa: BLE001  whatever a detector raises, the next one is asked
            notes.append(f"{name} failed ({type(e).__name__}: {e})")
            continue
        return Detection(name, notes, *sides)
    none = Keypoints(*(np.zeros(0) for _ in range(5)), np.zeros((0, 1)))
    return Detection(None, notes, none, none)


def keypoints(pairs: DataFrame, limit: int = 2048, max_side: int = 1024, suppress_shadows: bool = True, order: Sequence[str] = ORDER, registry: Mapping[str, Detector] = DETECTORS) -> DataFrame:
    """(run, side, idx, x, y, size, angle, response, desc, detector): the strongest ``limit`` keypoints of either side.

    The second image takes the first one's shape, both are normalised. A task handles one pair at a time. Pairs with a null name or a missing image give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.to_dict("records"):
                a, b = image(p, "a"), image(p, "b")
                if not a.size or not b.size:
                    continue
                a, b = (k.normalise(x, suppress_shadows)[0] for x in (a, k.resize(b, a.shape)))
                found = detect(a, b, order, limit, max_side, registry)
                for side, kp in (("a", found.a), ("b", found.b)):
                    if len(kp):
                        yield pd.DataFrame({"run": str(p["pair"]), "side": side, "idx": np.arange(len(kp), dtype=np.int32), "x": kp.x, "y": kp.y, "size": kp.size, "angle": kp.angle, "response": kp.response, "desc": list(kp.desc), "detector": found.detector})

    return pairs.where("pair is not null").mapInPandas(run, "run string, side string, idx int, x double, y double, size double, angle double, response double, desc array<double>, detector string")


@dataclass
class Settings:
    """What a run may change: preparation, limits, tests and the fit."""

    preprocess: str = "clahe"
    suppress_shadows: bool = True
    limit: int = 2048
    max_side: int = 1024
    ratio: float = 0.8
    floor: float = 0.0
    method: str = "magsac"
    threshold: float = 3.0


_FIGURES = (
    "n_keypoints_a int, n_keypoints_b int, n_matches int, n_inliers int, h array<double>, rmse double, median double, p90 double, max double, degenerate boolean, "
    "detector string, note string, heldout_px double, unif_cells double, unif_hull double, ncc_before double, ncc_after double, pre_ms double, match_ms double, fit_ms double"
)
_INLIER = {"idx_a": "int", "xa": "double", "ya": "double", "idx_b": "int", "xb": "double", "yb": "double", "err": "double"}
_INLIERS = f"array<struct<{', '.join(f'{c}: {t}' for c, t in _INLIER.items())}>>"
RUN_SCHEMA = f"{_FIGURES}, inliers {_INLIERS}"


@dataclass
class Ready:
    """A pair before any detector sees it: both images in one shape, prepared, their correlation and the milliseconds that took."""

    a: np.ndarray
    b: np.ndarray
    pa: np.ndarray
    pb: np.ndarray
    ncc_before: float | None
    pre_ms: float


def ready(a: np.ndarray, b: np.ndarray, s: Settings) -> Ready | None:
    """What all arms of a pair share; none where an image is empty."""
    if not a.size or not b.size:
        return None
    began = time.perf_counter()
    b = k.resize(b, a.shape)
    prepare = k.shadow_norm if s.preprocess == "shadow_norm" else lambda x: k.prepared(x, s.suppress_shadows)
    pa, pb = prepare(a), prepare(b)
    took = round(1000 * (time.perf_counter() - began), 1)
    return Ready(a, b, pa, pb, k.masked_correlation(a, b, np.ones(a.shape, bool)), took)


def measured(pair: Ready | None, order: Sequence[str], s: Settings, registry: Mapping[str, Detector], seed: int = 0) -> dict:
    """One pair from prepared pixels to figures: detect, match, fit, measure. Figures are None where there is no map; inliers are arrays by column."""
    row: dict = {"n_keypoints_a": 0, "n_keypoints_b": 0, "n_matches": 0, "n_inliers": 0, "degenerate": True, "unif_cells": 0.0, "unif_hull": 0.0, "inliers": {c: np.zeros(0, np.int32 if t == "int" else float) for c, t in _INLIER.items()}}
    if pair is None:
        return row
    clock, a, b = [time.perf_counter()], pair.a, pair.b
    found = detect(pair.pa, pair.pb, order, s.limit, s.max_side, registry)
    ia, ib, _, _ = ratio_matches(found.a.desc, found.b.desc, s.ratio, s.floor)
    xy = np.c_[found.a.x, found.a.y][ia], np.c_[found.b.x, found.b.y][ib]
    clock.append(time.perf_counter())
    h, hit = k.robust_map(*xy, s.method, s.threshold, seed=seed)
    clock.append(time.perf_counter())
    row |= {"pre_ms": pair.pre_ms} | dict(zip(("match_ms", "fit_ms"), (round(1000 * (t - u), 1) for u, t in zip(clock, clock[1:], strict=False)), strict=True))
    row |= {"n_keypoints_a": len(found.a), "n_keypoints_b": len(found.b), "n_matches": len(ia), "n_inliers": int(hit.sum()), "degenerate": h is None or int(hit.sum()) <= 4, "detector": found.detector, "note": "; ".join(found.notes) or None}
    row["ncc_before"] = pair.ncc_before
    if h is not None:
        p, q = xy[0][hit], xy[1][hit]
        e = k.residuals(h, p, q)
        row |= {"h": (h / h[2, 2]).ravel().tolist(), "heldout_px": k.heldout_error(p, q, seed)} | k.spread(p, a.shape)
        if len(e):
            row |= {"rmse": float(np.sqrt((e**2).mean())), "median": float(np.median(e)), "p90": float(np.percentile(e, 90)), "max": float(e.max())}
        if abs(np.linalg.det(h)) > 1e-12:
            shown, covered = k.warp_covered(a, h, b.shape)
            row["ncc_after"] = k.masked_correlation(np.round(shown), b, covered)
        row["inliers"] = dict(zip(_INLIER, (ia[hit].astype(np.int32), *p.T, ib[hit].astype(np.int32), *q.T, e), strict=True))
    return row


def measured_rows(pairs: DataFrame, keep: list[str], s: Settings, registry: Mapping[str, Detector], order_col: str | None = None, order: Sequence[str] = ORDER, seed_col: str | None = None) -> DataFrame:
    """``keep`` and the figures of each pair, without a shuffle: the limit of keypoints bounds what a pair needs, so it never leaves its task."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    figures = [x.split()[0] for x in _FIGURES.split(", ")]
    names = [*keep, *figures, *(f"_i_{c}" for c in _INLIER)]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        last, pair = None, None
        for pdf in batches:
            for p in pdf.to_dict("records"):
                asked, shown = list(p[order_col]) if order_col else order, [p[f"{c}_{x}"] for x in "ab" for c in ("h", "w", "pixels")]
                if last is None or shown != last:  # arms of a pair come one after the other and share what comes before detection
                    last, pair = shown, ready(image(p, "a"), image(p, "b"), s)
                row = measured(pair, asked, s, registry, int(p[seed_col]) if seed_col and not pd.isna(p[seed_col]) else 0)
                inliers = row.pop("inliers")
                yield dict.fromkeys(names) | {c: p[c] for c in keep} | row | {f"_i_{c}": np.ascontiguousarray(v) for c, v in inliers.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from framed(rows(batches), names)

    # Inliers leave Python as plain arrays, which are copied as a whole, and become structs afterwards.
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), _FIGURES, *(f"_i_{c} array<{t}>" for c, t in _INLIER.items())])
    inliers = F.arrays_zip(*(F.col(f"_i_{c}").alias(c) for c in _INLIER)).cast(_INLIERS)
    return pairs.mapInPandas(run, schema).select(*(F.col(f"`{c}`") for c in keep), *figures, inliers.alias("inliers"))


def match_pairs(pairs: DataFrame, detector: str | None = None, settings: Settings | None = None, registry: Mapping[str, Detector] = DETECTORS) -> DataFrame:
    """One row of metrics for each pair, from pixels.

    (run, n_keypoints_a, n_keypoints_b, n_matches, n_inliers, inlier_ratio, h, rmse, median, p90, max, degenerate, warning,
    detector, note). Pairs without matches or map keep their row: counts are 0, figures null, the fit degenerate; those with a null name
    have none. ``detector`` is asked first, the others of ``ORDER`` for those pairs alone where it does not exist or raises; the note says so. A pair that
    no detector can read has a null detector.
    """
    order = ORDER if detector is None else (detector, *(x for x in ORDER if x != detector))
    named = pairs.where("pair is not null").withColumn("run", F.col("pair").cast("string"))
    out = measured_rows(named, ["run"], settings or Settings(), registry, order=order)
    return out.select(
        "run", "n_keypoints_a", "n_keypoints_b", "n_matches", "n_inliers", (F.col("n_inliers") / F.greatest("n_matches", F.lit(1))).alias("inlier_ratio"), "h",
        *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("rmse", "median", "p90", "max")), "degenerate", F.when(F.col("degenerate"), WARNING).alias("warning"), "detector", "note",
    )


def ncc_before_after(pairs: DataFrame, maps: DataFrame, least: int = 1000) -> DataFrame:
    """(run, ncc_before, ncc_after): correlation of a pair as it is, and with the first image under its map (run, h).

    The second correlation counts the cells that the first image covers after it. Null for fewer than ``least`` cells, flat
    images, or, after, without a map.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf.to_dict("records"):
                a, b = image(p, "a"), image(p, "b")
                row = {"run": str(p["pair"]), "ncc_before": None, "ncc_after": None}
                if a.size and b.size:
                    b, full = k.resize(b, a.shape), np.ones(a.shape, bool)
                    row["ncc_before"] = k.masked_correlation(a, b, full, least)
                    if p["h"] is not None:
                        h = np.asarray(p["h"], float).reshape(3, 3)
                        if abs(np.linalg.det(h)) > 1e-12:
                            shown, covered = k.warp_covered(a, h, b.shape)
                            row["ncc_after"] = k.masked_correlation(np.round(shown), b, covered, least)
                rows.append(row)
            yield pd.DataFrame(rows, columns=["run", "ncc_before", "ncc_after"])

    own = pairs.where("pair is not null").withColumn("_run", F.col("pair").cast("string"))
    both = own.join(maps.select(F.col("run").alias("_run"), "h"), "_run", "left").select("pair", *(f"{c}_{s}" for s in "ab" for c in ("h", "w", "pixels")), "h")
    return both.mapInPandas(run, "run string, ncc_before double, ncc_after double")


#: Figures of a lock: the coarse peak and its shift, the fine shift, centres of the search, sizes of the products, metres a pixel.
LOCKED = ["run", "peak", "ratio", "z", "dx", "dy", "fx", "fy", "cx_a", "cy_a", "cx_b", "cy_b", "n_xa", "n_ya", "n_xb", "n_yb", "gsd_a", "gsd_b"]


def locate_overlap(pairs: DataFrame, tile: int = 1024, across_m: float = 600.0, along_m: float = 4000.0, decimation: int = 4, refine: bool = True) -> DataFrame:
    """Tiles of two strips that show the same ground, from pairs with ``gsd_a``, ``gsd_b`` and the labels' places ``x_a, y_a, x_b, y_b``.

    A template around the place in b is sought in a, as far around as labels may err. A sure peak is taken and refined at
    full resolution; an unsure one leaves the labels' place where it asks for a small move, and else the pair is rejected.
    (run, decision, peak, ratio, z, dx, dy, shift_m_across, shift_m_along, gsd_ratio, window_a, window_b), windows as
    x0, y0, x1, y1. Rejected pairs keep the shift that was asked for. Without pixels, scale or place, or without room to
    search, the figures are null and the pair is rejected.
    """
    names, coarse = LOCKED, LOCKED[1:6]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf.to_dict("records"):
                a, b = image(p, "a"), image(p, "b")
                row = {"run": str(p["pair"]), "gsd_a": p["gsd_a"], "gsd_b": p["gsd_b"]}
                rows.append(row)
                if any(pd.isna(p[c]) for c in ("gsd_a", "gsd_b", "x_a", "y_a", "x_b", "y_b")) or not (p["gsd_a"] > 0 and p["gsd_b"] > 0) or not a.size or not b.size:
                    continue
                ratio, size_a, size_b = p["gsd_b"] / p["gsd_a"], a.shape[::-1], b.shape[::-1]
                half_a = tuple(min(int(tile / 2 + m / p["gsd_a"]), max(64, n // 2 - 2)) for m, n in zip((across_m, along_m), size_a, strict=True))
                half_b = tuple(min(int(max(24, tile * 0.7 / ratio)), max(24, n // 2 - 2)) for n in size_b)
                at_a = tuple(k.inside(p[c], h, n) for c, h, n in zip(("x_a", "y_a"), half_a, size_a, strict=True))
                at_b = tuple(k.inside(p[c], h, n) for c, h, n in zip(("x_b", "y_b"), half_b, size_b, strict=True))
                row |= dict(zip(("cx_a", "cy_a", "cx_b", "cy_b", "n_xa", "n_ya", "n_xb", "n_yb"), (*at_a, *at_b, *size_a, *size_b), strict=True))
                found = k.coarse_lock(k.window(a, at_a, half_a), k.window(b, at_b, half_b), ratio, decimation)
                if found is None:
                    continue
                row |= {c: found[c] for c in coarse}
                fine = k.fine_lock(a, b, (int(at_a[0] + found["dx"]), int(at_a[1] + found["dy"])), at_b, tile, ratio) if refine and found["peak"] >= 0.2 else None
                row |= dict(zip(("fx", "fy"), fine or (0.0, 0.0), strict=True))
            yield pd.DataFrame(rows, columns=names).astype({c: float for c in names[1:]})

    found = pairs.where("pair is not null").mapInPandas(run, "run string, " + ", ".join(f"{c} double" for c in names[1:]))
    return _decided(found, tile)


def _decided(found: DataFrame, tile: int) -> DataFrame:
    """Decision, shift and windows from a lock's figures ``LOCKED``."""
    names, coarse = LOCKED, LOCKED[1:6]
    found = found.select("run", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in names[1:]))
    decision = F.coalesce(lock_decision(F.col("peak"), F.col("ratio"), F.col("z"), F.hypot("dx", "dy") * F.col("gsd_a"), tile, F.col("gsd_a")), F.lit("rejected"))
    found = found.withColumn("decision", decision)
    for c, f in (("dx", "fx"), ("dy", "fy")):
        found = found.withColumn(c, F.when(F.col("decision") == "measured", F.col(c) + F.col(f)).when(F.col("decision") == "prior", F.col(c) * 0).otherwise(F.col(c)))
    half_a = F.lit(tile // 2)
    half_b = F.greatest(F.lit(16), F.bround((tile // 2) * F.col("gsd_a") / F.col("gsd_b")).cast("int"))

    def corner(place: F.Column, half: F.Column, size: str) -> F.Column:
        return F.least(F.greatest(place, half), F.col(size) - half).cast("int")

    xa, ya = (corner(F.col(c) + F.col(d), half_a, n) for c, d, n in (("cx_a", "dx", "n_xa"), ("cy_a", "dy", "n_ya")))
    xb, yb = (corner(F.col(c), half_b, n) for c, n in (("cx_b", "n_xb"), ("cy_b", "n_yb")))
    windows = [F.when(F.col("dx").isNotNull(), F.array(x - h, y - h, x + h, y + h)) for x, y, h in ((xa, ya, half_a), (xb, yb, half_b))]
    return found.select(
        "run", "decision", *coarse, (F.abs("dx") * F.col("gsd_a")).alias("shift_m_across"), (F.abs("dy") * F.col("gsd_a")).alias("shift_m_along"),
        F.try_divide("gsd_b", "gsd_a").alias("gsd_ratio"), windows[0].alias("window_a"), windows[1].alias("window_b"),
    )


def _side(pairs: DataFrame, s: str) -> list[F.Column]:
    return [F.lit(s).alias("side"), *(F.col(f"{s}_{c}").alias(c) for c in ("path", "dtype", "lines", "samples")), F.lit(None).cast("int").alias("bands")]


def _read_both(rows: DataFrame, boxes: dict[str, dict[str, F.Column]], sizes: dict[str, tuple[F.Column, F.Column]]) -> DataFrame:
    """(run, h_a, w_a, pixels_a, h_b, w_b, pixels_b) of a window of either side, in 8 bits; only images meet, by run."""
    none = F.lit(None).cast("int")
    wanted = [rows.select("run", *_side(rows, s), *(boxes[s][c].cast("int").alias(c) for c in ("sample0", "line0", "sample1", "line1")), none.alias("band_lo"), none.alias("band_hi"), *(x.cast("int").alias(c) for x, c in zip(sizes[s], ("to_h", "to_w"), strict=True))) for s in "ab"]
    read = read_windows(wanted[0].unionByName(wanted[1]), ["run", "side"], eight_bit=True).select("run", "side", F.struct("h", "w", "pixels").alias("x"))
    both = read.groupBy("run").agg(*(F.max_by("x", (F.col("side") == s).cast("int")).alias(s) for s in "ab"))
    return both.select("run", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("h", "w", "pixels")))


def lock_products(pairs: DataFrame, products: DataFrame, tile: int = 1024, across_m: float = 600.0, along_m: float = 4000.0, decimation: int = 4, refine: bool = True) -> DataFrame:
    """``locate_overlap`` from labels: pairs (run, a, b, lon, lat) of products (product, path, dtype, lines, samples, corners).

    The corners give each product's scale and the place of (lon, lat) in it. Pass one reads the search window of a and the template's
    window of b, thinned out as they are read; pass two reads the windows around the peak at full resolution, of sure locks alone. No strip is ever a row. Columns
    as there. Pairs without a known product, corners, place or readable file are rejected with null figures.
    """
    corners = [f"{c}_{x}" for c in ("ul", "ur", "ll", "lr") for x in ("lon", "lat")]
    columns = ["path", "dtype", "lines", "samples", *corners]
    rows = pairs.where("run is not null").select(F.col("run").cast("string").alias("run"), "a", "b", "lon", "lat")
    for s in "ab":
        side = products.select(F.col("product").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in columns)).dropDuplicates([s])
        rows = rows.join(side, s, "left")
    half: dict[str, tuple[F.Column, F.Column]] = {}
    for s in "ab":
        f = Footprint.of(f"{s}_")
        ok = F.coalesce(f.usable(), F.lit(False))
        along, across = f.gsd()
        x, y = f.lonlat_to_pixel(F.col("lon"), F.col("lat"))
        rows = rows.withColumns({f"gsd_{s}": F.when(ok, (along + across) / 2), f"x_{s}": F.when(ok, x), f"y_{s}": F.when(ok, y)})
    rows = rows.withColumn("scale", F.try_divide("gsd_b", "gsd_a"))
    reach = {"a": [tile / 2 + m / F.col("gsd_a") for m in (across_m, along_m)], "b": [F.greatest(F.lit(24.0), tile * 0.7 / F.col("scale"))] * 2}
    for s, least in (("a", 64), ("b", 24)):
        size = [F.col(f"{s}_samples"), F.col(f"{s}_lines")]
        half[s] = tuple(F.least(r.cast("int"), F.greatest(F.lit(least), F.floor(n / 2).cast("int") - 2)) for r, n in zip(reach[s], size, strict=True))
        for c, h, n in zip("xy", half[s], size, strict=True):
            rows = rows.withColumn(f"half_{c}{s}", h).withColumn(f"c{c}_{s}", F.least(F.greatest(F.col(f"{c}_{s}"), h), F.greatest(h, n - h)).cast("int"))
    sound = F.col("cx_a").isNotNull() & F.col("cx_b").isNotNull() & (F.col("gsd_a") > 0) & (F.col("gsd_b") > 0)
    rows = cut(rows.withColumn("sound", F.coalesce(sound, F.lit(False))))

    def box(s: str, x: F.Column, y: F.Column, hx: F.Column, hy: F.Column) -> dict[str, F.Column]:
        return {"sample0": x - hx, "line0": y - hy, "sample1": x + hx, "line1": y + hy}

    boxes = {s: box(s, *(F.col(f"c{c}_{s}") for c in "xy"), *(F.col(f"half_{c}{s}") for c in "xy")) for s in "ab"}

    def clipped_size(s: str, c: str) -> F.Column:
        at, h, n = F.col(f"c{c}_{s}"), F.col(f"half_{c}{s}"), F.col(f"{s}_{'samples' if c == 'x' else 'lines'}")
        return F.least(at + h, n) - F.greatest(at - h, F.lit(0))

    thin = {"a": tuple(F.greatest(F.lit(8), F.floor(clipped_size("a", c) / decimation)) for c in "yx"), "b": tuple(F.greatest(F.lit(8), F.floor(clipped_size("b", c) * F.col("scale") / decimation)) for c in "yx")}
    coarse = LOCKED[1:6]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.to_dict("records"):
                found = k.coarse_peak(image(p, "a"), image(p, "b"), decimation)
                yield pd.DataFrame([{"run": p["run"], **({c: found[c] for c in coarse} if found else {})}], columns=["run", *coarse])

    peaks = _read_both(rows.where("sound"), boxes, thin).mapInPandas(first, "run string, " + ", ".join(f"{c} double" for c in coarse))
    found = cut(rows.join(peaks.select("run", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in coarse)), "run", "left"))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.to_dict("records"):
                a, b = image(p, "a"), image(p, "b")
                fine = k.fine_peak(a, b, tile) if a.size and b.size else None
                yield pd.DataFrame([{"run": p["run"], "fx": (fine or (0.0, 0.0))[0], "fy": (fine or (0.0, 0.0))[1]}])

    if refine:
        h, pad = tile // 2, tile // 4
        hb = F.greatest(F.lit(16), F.bround(h / F.col("scale")).cast("int"))

        def centred(place: F.Column, reach: F.Column, n: str) -> F.Column:
            return F.least(F.greatest(place, reach), F.greatest(reach, F.col(n) - reach)).cast("int")

        wide = F.lit(h + pad)
        at_a = [centred((F.col(f"c{c}_a") + F.col(f"d{c}")).cast("int"), wide, f"a_{n}") for c, n in (("x", "samples"), ("y", "lines"))]
        at_b = [centred(F.col(f"c{c}_b"), hb, f"b_{n}") for c, n in (("x", "samples"), ("y", "lines"))]
        other = F.abs(F.col("scale") - 1) > 1e-3
        size_b = F.when(other, F.lit(tile))
        none = F.lit(None).cast("int")
        sure = lock_decision(F.col("peak"), F.col("ratio"), F.col("z"), F.lit(0.0), tile, F.col("gsd_a")) == "measured"
        fine = _read_both(found.where(sure), {"a": box("a", *at_a, wide, wide), "b": box("b", *at_b, hb, hb)}, {"a": (none, none), "b": (size_b, size_b)})
        found = found.join(fine.mapInPandas(second, "run string, fx double, fy double"), "run", "left")
    else:
        found = found.withColumns({"fx": F.lit(0.0), "fy": F.lit(0.0)})
    found = found.withColumns({"n_xa": F.col("a_samples"), "n_ya": F.col("a_lines"), "n_xb": F.col("b_samples"), "n_yb": F.col("b_lines")})
    figures = [F.col(c).cast("double").alias(c) for c in LOCKED[1:]]
    return _decided(found.fillna(0.0, ["fx", "fy"]).select("run", *figures), tile)
