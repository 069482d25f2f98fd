"""Kernels over tables: fitting of runs, locks of tile pairs, image operations on tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakey.functions import homography as hg
from terrakey.operators import kernels as k
from terrakey.operators.consensus import consensus, resampled
from terrakey.operators.rounds import cut

FIT_SCHEMA = "run string, n_matches int, n_inliers int, h array<double>, degenerate boolean, rmse double, heldout_px double, precision_px double, heldout_h double, heldout_hpoly double, detector string"


#: Matches of a run that one task fits; larger runs are fitted by aggregation.
TASK_MATCHES = 20_000


def fit_runs(matches: DataFrame, method: str = "magsac", threshold: float = 3.0, seed: int = 0, task_matches: int = TASK_MATCHES) -> DataFrame:
    """One row per run: robust map, inliers, residual and resampled errors, from matches (run, idx_a, xa, ya, xb, yb).

    Runs up to ``task_matches`` are one task's group each, larger ones are fitted over all executors (``consensus``); their splits are by hash.
    Without a map, figures are null and the run counts as degenerate, as does one with four inliers or fewer. Matches with a null run or
    coordinate count nowhere.
    """
    known = matches.where("run is not null and xa is not null and ya is not null and xb is not null and yb is not null").withColumn("run", F.col("run").cast("string"))
    sizes = known.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > task_matches).select("run"))
    if large.isEmpty():
        return _fit_groups(known, method, threshold, seed)
    few = F.broadcast(large) if large.count() <= 100_000 else large
    found, marked = consensus(known.join(few, "run", "left_semi"), method, threshold, seed)
    err = F.when(F.col("inlier"), F.hypot(*(p - F.col(c) for p, c in zip(hg.apply(hg.entries(F.col("h")), F.col("xa"), F.col("ya")), ("xb", "yb"), strict=True))))
    rmse = marked.groupBy("run").agg(F.sqrt(F.avg(err * err)).alias("rmse"))
    out = found.join(rmse, "run", "left").join(resampled(marked), "run", "left")
    out = out.withColumns({"degenerate": F.col("h").isNull() | (F.col("n_inliers") <= 4), "detector": F.lit("descriptors")})
    small = _fit_groups(known.join(few, "run", "left_anti"), method, threshold, seed)
    return small.unionByName(out.select(*(F.col(f.name).cast(f.dataType) for f in small.schema.fields)))


def _fit_groups(matches: DataFrame, method: str, threshold: float, seed: int) -> DataFrame:
    """``fit_runs`` with each run in one task."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx_a", kind="stable")
        a, b = pdf[["xa", "ya"]].to_numpy(float), pdf[["xb", "yb"]].to_numpy(float)
        h, inliers = k.robust_map(a, b, method, threshold, seed=seed)
        row = {"run": str(pdf["run"].iloc[0]), "n_matches": len(a), "n_inliers": int(inliers.sum()), "h": None, "degenerate": h is None or inliers.sum() <= 4, "detector": "descriptors"}
        if h is not None:
            a, b = a[inliers], b[inliers]
            gain = k.polynomial_gain(a, b, seed)
            row |= {"h": (h / h[2, 2]).ravel().tolist(), "rmse": float(np.sqrt((k.residuals(h, a, b) ** 2).mean())), "heldout_px": k.heldout_error(a, b, seed), "precision_px": k.map_precision(a, b, seed)}
            row |= {"heldout_h": gain[0], "heldout_hpoly": gain[1]} if gain else {}
        return pd.DataFrame([row]).reindex(columns=["run", "n_matches", "n_inliers", "h", "degenerate", "rmse", "heldout_px", "precision_px", "heldout_h", "heldout_hpoly", "detector"])

    return matches.select("run", "idx_a", "xa", "ya", "xb", "yb").groupBy("run").applyInPandas(fit, FIT_SCHEMA)


def map_tiles(tiles: DataFrame, kernel: Callable[[np.ndarray, pd.Series], np.ndarray]) -> DataFrame:
    """Tiles (tile, h, w, pixels) through a kernel, tile by tile, without a shuffle. A tile without pixels or size stays one, of 0 x 0 cells."""
    known = F.col("pixels").isNotNull() & F.col("h").isNotNull() & F.col("w").isNotNull()
    tiles = tiles.withColumns({"pixels": F.when(known, F.col("pixels")), "h": F.coalesce("h", F.lit(0)), "w": F.coalesce("w", F.lit(0))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            none = np.zeros((0, 0), np.uint8)
            out = [none if t["pixels"] is None else kernel(np.frombuffer(t["pixels"], np.uint8).reshape(t["h"], t["w"]), t) for _, t in pdf.iterrows()]
            yield pd.DataFrame({"tile": pdf["tile"], "h": [x.shape[0] for x in out], "w": [x.shape[1] for x in out], "pixels": [x.tobytes() for x in out]})

    return tiles.mapInPandas(run, f"tile {tiles.schema['tile'].dataType.simpleString()}, h int, w int, pixels binary")


def lock_pairs(pairs: DataFrame) -> DataFrame:
    """Where the template tile of each pair lies in its image tile: (pair, x, y, peak, ratio, z); nulls where a tile is missing or the template does not fit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, p in pdf.iterrows():
                missing = any(p[f"{c}_{s}"] is None or (c != "pixels" and pd.isna(p[f"{c}_{s}"])) for s in "ab" for c in ("h", "w", "pixels"))
                if missing or min(p["h_b"], p["w_b"]) < 1 or p["h_b"] > p["h_a"] or p["w_b"] > p["w_a"]:
                    rows.append({"pair": p["pair"]})
                    continue
                image, template = (k.clahe(np.frombuffer(p[f"pixels_{s}"], np.uint8).reshape(int(p[f"h_{s}"]), int(p[f"w_{s}"]))) for s in "ab")
                rows.append({"pair": p["pair"], **k.lock(k.correlation(image, template))})
            yield pd.DataFrame(rows, columns=["pair", "x", "y", "peak", "ratio", "z"], dtype=object).where(lambda d: d.notna(), None)

    return pairs.mapInPandas(run, f"pair {pairs.schema['pair'].dataType.simpleString()}, x int, y int, peak double, ratio double, z double")


#: Tiles of a region that one task decides in order.
TASK_TILES = 20_000
#: Region sides in cells, as powers of two.
_LEVELS = list(range(0, 19, 2))


def _in_order(pdf: pd.DataFrame, distance: float) -> pd.DataFrame:
    """What the tiles of a region decide by themselves, in order: a tile near a kept one is dropped; one that is ``blocked`` by an
    earlier tile elsewhere waits, and so does one near an earlier tile that waits; any other is kept."""
    pdf = pdf.sort_values(["idx", "id"], kind="stable", na_position="first")
    kept: dict[tuple[int, int], tuple[float, float]] = {}
    waiting: dict[tuple[int, int], list[tuple[float, float]]] = {}
    ids, states = [], []
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    for key, x, y, cx, cy, blocked in zip(pdf["id"], pdf["x"], pdf["y"], pdf["cx"], pdf["cy"], pdf["blocked"], strict=True):
        near = lambda p: abs(p[0] - x) < distance and abs(p[1] - y) < distance  # noqa: B023, E731
        cells = [(cx + i, cy + j) for i, j in around]
        if any(c in kept and near(kept[c]) for c in cells):
            ids.append(key)
            states.append(False)
        elif blocked or (cx, cy) in waiting or any(near(p) for c in cells for p in waiting.get(c, ())):
            waiting.setdefault((cx, cy), []).append((x, y))
        else:
            kept[cx, cy] = (x, y)
            ids.append(key)
            states.append(True)
    return pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "keep": pd.Series(states, dtype="bool")})


def greedy_dedup(tiles: DataFrame, distance: float = 256.0, task_tiles: int = TASK_TILES) -> DataFrame:
    """Tiles (family, idx, x, y) with ``keep``: in order of idx a tile is dropped within ``distance`` on both axes of one kept before.

    Space is cut into cells of that distance and these are joined to regions, each as large as its density allows with up to ``task_tiles`` undecided tiles. A round
    decides in each region all that does not wait for another region; tiles kept then drop what is near them elsewhere. So a
    chain takes a round for every region it crosses, not for every tile. A cell with more tiles than that shows its
    first one alone, as only one of its tiles can be kept. Equal idx: the tile read first. Tiles without a finite place are near nothing
    and kept; a null family is a family, a null idx comes first.
    """
    finite = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False))
    rows = tiles.select("family", "idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("id", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("placed", finite))
    # Families by a number that is never null, so that they can be joined on.
    families = cut(rows.where("placed").select("family").distinct().withColumn("fam", F.monotonically_increasing_id()))
    left = rows.where("placed").join(F.broadcast(families) if families.count() <= 100_000 else families, rows["family"].eqNullSafe(families["family"])).drop(families["family"])
    left = cut(left.select("fam", "id", "idx", "x", "y", F.floor(F.col("x") / distance).alias("cx"), F.floor(F.col("y") / distance).alias("cy")))
    cell = ["fam", "cx", "cy"]
    region = ["level", "rx", "ry"]
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    decided = []
    while not left.isEmpty():
        cells = cut(left.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("idx", "id")).alias("first")))
        every = cells.withColumn("level", F.explode(F.array(*map(F.lit, _LEVELS)))).withColumns({"rx": up("cx"), "ry": up("cy")})
        held = every.groupBy("fam", *region).agg(F.sum(F.least("n", F.lit(task_tiles))).alias("held")).where(F.col("held") <= task_tiles)
        own = every.join(held, ["fam", *region]).groupBy(*cell).agg(F.max("level").alias("level"), F.first("n").alias("n"), F.first("first").alias("first"))
        own = cut(own.withColumns({"rx": up("cx"), "ry": up("cy")}))
        step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)))
        beside = own.select("fam", *region, "first", step.alias("d"), "cx", "cy").select("fam", *(F.col(c).alias(f"o_{c}") for c in region), F.col("first").alias("o_first"), (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
        elsewhere = (F.col("level") != F.col("o_level")) | (F.col("rx") != F.col("o_rx")) | (F.col("ry") != F.col("o_ry"))
        outside = own.join(beside, cell).where(elsewhere).groupBy(*cell).agg(F.min("o_first").alias("outside"))
        dealt = left.join(own.join(outside, cell, "left"), cell)
        shown = (F.col("n") <= task_tiles) | (F.col("id") == F.col("first.id"))
        dealt = dealt.where(shown).withColumn("blocked", F.coalesce(F.col("outside") < F.struct("idx", "id"), F.lit(False)))
        found = dealt.select("fam", *region, "id", "idx", "x", "y", "cx", "cy", "blocked").groupBy("fam", *region).applyInPandas(lambda pdf: _in_order(pdf, distance), "id long, keep boolean")
        found = cut(left.join(found, "id"))
        kept = found.where("keep").select("fam", F.col("id").alias("k_id"), F.col("x").alias("kx"), F.col("y").alias("ky"), F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("c"))
        kept = kept.select("fam", "k_id", "kx", "ky", "c.cx", "c.cy")
        near = (F.abs(F.col("x") - F.col("kx")) < distance) & (F.abs(F.col("y") - F.col("ky")) < distance)
        rest = left.join(found.select("id"), "id", "left_anti")
        dropped = cut(rest.join(kept, cell).where(near).select("id").distinct().withColumn("keep", F.lit(False)))
        decided += [found.select("id", "keep"), dropped]
        left = cut(rest.join(dropped.select("id"), "id", "left_anti"))
    out = rows.where("not placed").select("family", "idx", F.lit(True).alias("keep"))
    if decided:
        states = decided[0]
        for more in decided[1:]:
            states = states.unionByName(more)
        out = out.unionByName(rows.where("placed").join(states, "id").select("family", "idx", "keep"))
    return out
