"""Robust maps of runs of any size: hypotheses from a bounded sample, consensus and refits by aggregation over all matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakey.functions import homography as hg
from terrakey.operators import kernels as k
from terrakey.operators.rounds import cut

#: Matches of a run from which hypotheses are drawn, hypotheses that all matches judge, splits of the resampled errors, refits at most.
SAMPLE, HYPOTHESES, SPLITS, REFITS = 4096, 16, 20, 10
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_SUMS = [f"{m}{i}{j}" for m in ("o", "u", "v", "w") for i, j in _PAIRS]
#: Rows of one run each that are broadcast at most.
BROADCAST = 20_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _error(h: Column) -> Column:
    x, y = hg.apply(hg.entries(h), F.col("xa"), F.col("ya"))
    return F.coalesce(F.hypot(x - F.col("xb"), y - F.col("yb")), F.lit(float("inf")))


def moments(where: Column | None = None) -> list[Column]:
    """Sums of which the normal equations of a projective map consist, of points shifted and scaled by ``unit`` (ax, ay, as, bx, by, bs)."""
    x, y = ((F.col(f"{c}a") - F.col(f"unit.a{c}")) * F.col("unit.as") for c in "xy")
    u, v = ((F.col(f"{c}b") - F.col(f"unit.b{c}")) * F.col("unit.bs") for c in "xy")
    p, weights = [x, y, F.lit(1.0)], {"o": F.lit(1.0), "u": u, "v": v, "w": u * u + v * v}
    pick = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    return [F.sum(pick(w * p[i] * p[j])).alias(f"{m}{i}{j}") for m, w in weights.items() for i, j in _PAIRS]


def solved(row: dict) -> np.ndarray | None:
    """The map of least algebraic error from sums and ``unit``; none for fewer than four points or a singular case."""
    if not row["n"] or row["n"] < 4:
        return None
    parts = {}
    for m in ("o", "u", "v", "w"):
        parts[m] = np.zeros((3, 3))
        for i, j in _PAIRS:
            parts[m][i, j] = parts[m][j, i] = row[f"{m}{i}{j}"]
    zero = np.zeros((3, 3))
    normal = np.block([[parts["o"], zero, -parts["u"]], [zero, parts["o"], -parts["v"]], [-parts["u"], -parts["v"], parts["w"]]])
    values, vectors = np.linalg.eigh(normal)
    if values[1] < 1e-12 * max(values[-1], 1e-300):
        return None
    t = row["unit"] if isinstance(row["unit"], dict) else row["unit"].asDict()
    ta, tb = (np.array([[t[f"{s}s"], 0, -t[f"{s}s"] * t[f"{s}x"]], [0, t[f"{s}s"], -t[f"{s}s"] * t[f"{s}y"]], [0, 0, 1]]) for s in "ab")
    h = np.linalg.inv(tb) @ vectors[:, 0].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def _solve_rows(keys: list[str], extra: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                h = solved(row)
                out.append([None if isinstance(row[c], float) and np.isnan(row[c]) else row[c] for c in keys + extra] + [None if h is None else h.ravel().tolist()])
            yield pd.DataFrame(out, columns=[*keys, *extra, "h"], dtype=object)

    return run


def _draw(method: str, threshold: float, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx_a", kind="stable")
        found = k.best_samples(pdf[["xa", "ya"]].to_numpy(float), pdf[["xb", "yb"]].to_numpy(float), method, threshold, HYPOTHESES, seed=seed)
        return pd.DataFrame([(pdf["run"].iloc[0], i, h.ravel().tolist()) for i, (_, h) in enumerate(found)], columns=["run", "hyp", "h"], dtype=object)

    return run


def consensus(matches: DataFrame, method: str = "magsac", threshold: float = 3.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((run, n_matches, h, n_inliers), matches with run's ``h``, ``unit`` and ``inlier``) of matches (run, idx_a, xa, ya, xb, yb).

    Hypotheses come from some ``SAMPLE`` matches of a run, taken by hash, all of them if there are fewer; all matches of the run score the best. Then sums over
    the inliers give the next map until the inliers stay the same, at most ``REFITS`` times. No run is one task's work, and only
    a row a run leaves an aggregation. Nulls in a match leave it out. Runs without a map have a null one.
    """
    whole = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("xa", "ya", "xb", "yb")]
    good = matches.where(F.col("run").isNotNull() & whole[0] & whole[1] & whole[2] & whole[3]).select("run", "idx_a", *(F.col(c).cast("double").alias(c) for c in ("xa", "ya", "xb", "yb")))
    good = cut(good)
    scale = lambda s: F.coalesce(F.try_divide(F.lit(np.sqrt(2.0)), F.sqrt(F.var_pop(f"x{s}") + F.var_pop(f"y{s}"))), F.lit(1.0))
    unit = [f(c).alias(n) for s in "ab" for f, c, n in ((F.avg, f"x{s}", f"{s}x"), (F.avg, f"y{s}", f"{s}y"))]
    runs = good.groupBy("run").agg(F.count(F.lit(1)).alias("n_matches"), *unit, scale("a").alias("as"), scale("b").alias("bs"))
    runs = cut(runs.select("run", "n_matches", F.struct("ax", "ay", "as", "bx", "by", "bs").alias("unit")))
    share = F.pmod(F.xxhash64("idx_a", F.lit(seed)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * SAMPLE / F.col("n_matches")
    drawn = good.join(_few(runs.select("run", "n_matches")), "run").where(share)
    run_type = good.schema["run"].dataType.simpleString()
    hypotheses = cut(drawn.select(*good.columns).groupBy("run").applyInPandas(_draw(method, threshold, seed), f"run {run_type}, hyp int, h array<double>"))
    lists = hypotheses.groupBy("run").agg(F.collect_list(F.struct("hyp", "h")).alias("all"))
    each = good.join(_few(lists), "run").select("run", "xa", "ya", "xb", "yb", F.explode("all").alias("x"))
    e = _error(F.col("x.h"))
    scores = {
        "ransac": F.count_if(F.col("e") <= threshold).cast("double"),
        "lmeds": -F.percentile_approx("e", 0.5, 10_000),
        "rho": F.count_if(F.col("e") <= threshold) - 0.5 * F.count_if(F.col("e") > 3 * threshold),
    }
    score = scores.get(method, F.sum(F.greatest(F.lit(0.0), 1 - F.col("e") * F.col("e") / threshold**2)))
    judged = each.select("run", F.col("x.hyp").alias("hyp"), e.alias("e")).groupBy("run", "hyp").agg(score.alias("score"))
    best = judged.groupBy("run").agg(F.max(F.struct("score", (-F.col("hyp")).alias("hyp"))).alias("m")).select("run", (-F.col("m.hyp")).alias("hyp"))
    state = hypotheses.join(best, ["run", "hyp"]).select("run", "h").join(runs, "run")
    # Each turn sums over the inliers of the newest map and compares them with those of the one before.
    state = cut(state.select("run", "unit", "h", F.lit(None).cast("array<double>").alias("before"), F.lit(-1).cast("long").alias("n_before")))
    final = None
    for turn in range(REFITS + 1):
        now, was = _error(F.col("h")) <= threshold, F.coalesce(_error(F.col("before")) <= threshold, F.lit(False))
        rows = good.join(_few(state), "run").withColumns({"now": now, "was": was})
        sums = rows.groupBy("run").agg(F.count_if("now").alias("n"), F.count_if(F.col("now") != F.col("was")).alias("changed"), F.first("unit").alias("unit"), F.first("h").alias("found"), F.first("before").alias("before"), F.first("n_before").alias("n_before"), *moments(F.col("now")))
        keys = [f"run {run_type}", "unit struct<ax: double, ay: double, as: double, bx: double, by: double, bs: double>", "found array<double>", "before array<double>", "n long", "n_before long", "changed long"]
        nexts = cut(sums.mapInPandas(_solve_rows([x.split()[0] for x in keys], []), ", ".join(keys) + ", h array<double>"))
        worse = F.col("n") < F.col("n_before")
        stop = worse | ((F.col("changed") == 0) & F.col("before").isNotNull()) | F.col("h").isNull() | F.lit(turn == REFITS)
        ended = nexts.where(stop).select("run", "unit", F.when(worse, F.col("before")).otherwise(F.col("found")).alias("h"))
        final = ended if final is None else final.unionByName(ended)
        state = nexts.where(~stop).select("run", "unit", "h", F.col("found").alias("before"), F.col("n").alias("n_before"))
        if state.isEmpty():
            break
        state = cut(state)
    final = cut(final)
    marked = good.join(_few(final), "run").withColumn("inlier", _error(F.col("h")) <= threshold)
    counts = marked.groupBy("run").agg(F.count_if("inlier").alias("n_inliers"))
    out = runs.select("run", "n_matches").join(final.select("run", "h"), "run", "left").join(counts, "run", "left").fillna(0, ["n_inliers"])
    return out, marked


def _drawn(split: Column, share: float) -> Column:
    """Whether a match falls into the first part of a split; another choice in each."""
    return F.pmod(F.xxhash64("idx_a", split), F.lit(1 << 30)) < int(share * (1 << 30))


def resampled(marked: DataFrame) -> DataFrame:
    """(run, heldout_px, precision_px, heldout_h, heldout_hpoly) from the inliers of ``consensus``: medians over ``SPLITS`` random splits.

    Matches are split by hash: 70 to 30 for the errors on matches that a map has not seen, with and without a correction of second
    order, and in halves for the disagreement of maps. Sums by run and split are all that is kept, so a run's size does not matter. Null for runs too small for it.
    """
    inliers = marked.where("inlier").select("run", "idx_a", "xa", "ya", "xb", "yb", "unit").withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
    run_type = marked.schema["run"].dataType.simpleString()
    inliers = inliers.withColumns({"fit": _drawn(F.col("split"), 0.7), "half": _drawn(F.col("split") + 1000, 0.5)})
    unit = "unit struct<ax: double, ay: double, as: double, bx: double, by: double, bs: double>"
    count = F.count(F.lit(1)).alias("n")

    def maps(rows: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
        sums = rows.groupBy(*by).agg(count, F.first("unit").alias("unit"), *moments())
        return cut(sums.mapInPandas(_solve_rows(by, ["n", "unit"]), ", ".join([*kinds, "n long", unit, "h array<double>"]))).where("h is not null")

    fits = maps(inliers.where("fit"), ["run", "split"], [f"run {run_type}", "split int"]).select("run", "split", F.col("h").alias("g"))
    seen = inliers.join(_few(fits), ["run", "split"])
    x, y = hg.apply(hg.entries(F.col("g")), F.col("xa"), F.col("ya"))
    s, t = F.col("xa") / 1024 - 0.5, F.col("ya") / 1024 - 0.5
    seen = seen.withColumns({"rx": F.col("xb") - x, "ry": F.col("yb") - y, "f": F.array(s * s, s * t, t * t, F.lit(1.0))})
    cross = [F.sum(F.when(F.col("fit"), F.col("f")[i] * F.col("f")[j])).alias(f"f{i}{j}") for i in range(4) for j in range(i, 4)]
    cross += [F.sum(F.when(F.col("fit"), F.col("f")[i] * F.col(r))).alias(f"{r}{i}") for r in ("rx", "ry") for i in range(4)]
    square = F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry")
    sums = seen.groupBy("run", "split").agg(F.count_if("fit").alias("k"), F.count_if(~F.col("fit")).alias("m"), F.sum(F.when(~F.col("fit"), square)).alias("e"), *cross)

    def bend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                m = np.array([[r[f"f{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
                c = np.linalg.lstsq(m, np.array([[r[f"rx{i}"], r[f"ry{i}"]] for i in range(4)]), rcond=None)[0]
                rows.append([r["run"], r["split"], r["k"], r["m"], r["e"], c[:, 0].tolist(), c[:, 1].tolist()])
            yield pd.DataFrame(rows, columns=["run", "split", "k", "m", "e", "cx", "cy"])

    bends = cut(sums.where("m >= 2").mapInPandas(bend, f"run {run_type}, split int, k long, m long, e double, cx array<double>, cy array<double>"))
    dot = lambda c: sum((F.col("f")[i] * F.col(c)[i] for i in range(4)), F.lit(0.0))
    rest = seen.where("not fit").join(_few(bends), ["run", "split"]).withColumns({"dx": F.col("rx") - dot("cx"), "dy": F.col("ry") - dot("cy")})
    poly = rest.groupBy("run", "split").agg(F.sqrt(F.avg(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("poly"))
    errors = bends.join(poly, ["run", "split"]).withColumn("alone", F.sqrt(F.col("e") / F.col("m")))
    sizes = marked.where("inlier").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    errors = errors.groupBy("run").agg(F.median("alone").alias("alone"), F.median(F.when(F.col("k") >= 6, F.col("alone"))).alias("heldout_h"), F.median(F.when(F.col("k") >= 6, F.col("poly"))).alias("heldout_hpoly"))

    halves = maps(inliers, ["run", "split", "half"], [f"run {run_type}", "split int", "half boolean"])
    both = halves.groupBy("run", "split").agg(F.max_by("h", F.col("half").cast("int")).alias("h1"), F.min_by("h", F.col("half").cast("int")).alias("h2"), F.count(F.lit(1)).alias("c")).where("c = 2")

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = [k.disagreement(np.asarray(p, float).reshape(3, 3), np.asarray(q, float).reshape(3, 3)) for p, q in zip(pdf["h1"], pdf["h2"], strict=True)]
            yield pd.DataFrame({"run": pdf["run"], "d": pd.Series(d, dtype=object)})

    precision = both.mapInPandas(differ, f"run {run_type}, d double").groupBy("run").agg((F.median("d") / 2).alias("precision"))
    out = sizes.join(errors, "run", "left").join(precision, "run", "left")
    return out.select("run", F.when(F.col("n") >= 10, F.col("alone")).alias("heldout_px"), F.when(F.col("n") >= 20, F.col("precision")).alias("precision_px"), "heldout_h", "heldout_hpoly")
