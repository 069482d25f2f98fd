"""Means over the exact nearest neighbours of points in the plane, at any distance and density."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakey.operators.rounds import cut, fresh_path, tasks

#: Points of a leaf that evenly spread ones make at most, points from which on a leaf is split, cells across a square at most, places that are searched together in a task.
EVEN, MOST, FINEST, BUCKET = 16384, 32768, 2.0**48, 64
#: Rows of a table of runs or leaves that are broadcast at most.
BROADCAST = 100_000


def _cells() -> dict[str, Column]:
    scale = F.col("scale")
    return {c: F.least(F.floor(F.col(at) * scale), scale - 1).cast("long") for c, at in (("cx", "u"), ("cy", "v"))}


def _finer(points: Column) -> Column:
    """By how much a cell's side is divided for so many points, a power of two."""
    return F.pow(F.lit(2.0), F.ceil(F.greatest(F.lit(0.0), F.log2(points / EVEN) / 2)))


def _gap(x: Column, lo: str, hi: str) -> Column:
    return F.greatest(F.col(lo) - x, x - F.col(hi), F.lit(0.0))


def leaves_of(points: DataFrame, by: str) -> DataFrame:
    """Leaves of a quadtree over each run's points (``by``, x, y, u, v, side, scale): u and v are the place in the run's square, 0 to 1, ``side`` is the square's,
    and ``scale`` says into how many cells it is cut at first, a power of two.

    (``by``, scale, cx, cy, held, x_lo, x_hi, y_lo, y_hi, hot, leaf). A cell is split until it holds ``MOST`` points at most; one whose points share a place
    stays whole and is ``hot``. Evenly spread points take one round, a dense spot one more, as its own extent says how small its cells are.
    """
    columns, at = [by, "side", "x", "y", "u", "v"], [by, "scale", "cx", "cy"]
    rest, parts = points.select(*columns, "scale"), []
    box = [f(c).alias(f"{c}_{n}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))]
    wide = F.greatest(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo")) / F.col("side")
    over = (F.col("held") > MOST) & (wide > 0) & (F.col("scale") < FINEST)
    while True:
        rest = rest.withColumns(_cells())
        cells = cut(rest.groupBy(*at, "side").agg(F.count(F.lit(1)).alias("held"), *box))
        parts.append(cells.where(~over).withColumn("hot", (F.col("held") > MOST) & (wide == 0)).drop("side"))
        full = cells.where(over)
        if full.isEmpty():
            break
        # Cells as large as the points' extent, and then as much smaller as even points would need.
        extent = F.greatest(F.col("scale"), F.pow(F.lit(2.0), F.floor(-F.log2(wide))))
        full = full.select(*at, F.least(extent * _finer(F.col("held")), F.lit(FINEST)).alias("finer"))
        rest = rest.join(F.broadcast(full) if full.count() <= BROADCAST else full, at).select(*columns, F.col("finer").alias("scale"))
    leaves = parts[0]
    for p in parts[1:]:
        leaves = leaves.unionByName(p)
    return cut(leaves.withColumn("leaf", F.monotonically_increasing_id()))


def _buckets(q: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of ``q`` in groups of at most ``BUCKET``, halved across their longer side."""
    todo = [np.arange(len(q))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BUCKET:
            yield rows
            continue
        half = len(rows) // 2
        rows = rows[np.argpartition(q[rows, np.argmax(np.ptp(q[rows], axis=0))], half)]
        todo += [rows[:half], rows[half:]]


def _squares(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (q[:, None, 0] - c[:, 0]) ** 2 + (q[:, None, 1] - c[:, 1]) ** 2


def nearest(q: np.ndarray, c: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``q`` the ``k`` nearest rows of ``c``, ties to the earlier one, and their squared distances; -1 and infinity where there are fewer.

    What lies beyond ``bound``, a squared distance for each place, need not be found. Without it all places of ``c`` are in ``q``, once each.
    """
    near, far = np.full((len(q), k), -1), np.full((len(q), k), np.inf)
    across = np.argsort(c[:, 0], kind="stable")
    xs = c[across, 0]
    for rows in _buckets(q):
        p = q[rows]
        if bound is None:  # the k-th nearest of the bucket's own rows
            inside = across[np.searchsorted(xs, p[:, 0].min()) : np.searchsorted(xs, p[:, 0].max(), "right")]
            inside = inside[(c[inside, 1] >= p[:, 1].min()) & (c[inside, 1] <= p[:, 1].max())]
            reach = np.partition(_squares(p, c[inside]), k - 1, axis=1)[:, k - 1].max() if len(inside) >= k else np.inf
        else:
            reach = bound[rows].max()
        r = np.sqrt(reach) * (1 + 1e-9)
        lo, hi = np.nextafter(p.min(axis=0) - r, -np.inf), np.nextafter(p.max(axis=0) + r, np.inf)
        some = across[np.searchsorted(xs, lo[0]) : np.searchsorted(xs, hi[0], "right")]
        some = np.sort(some[(c[some, 1] >= lo[1]) & (c[some, 1] <= hi[1])])
        d = _squares(p, c[some])
        if len(some) > 2 * k:  # as many of the smallest as hold all that tie with a k-th
            m = int((d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]).sum(axis=1).max())
            few = np.sort(np.argpartition(d, m - 1, axis=1)[:, :m], axis=1)
        else:
            few = np.broadcast_to(np.arange(len(some)), d.shape)
        d = np.take_along_axis(d, few, axis=1)
        first = np.argsort(d, axis=1, kind="stable")[:, :k]
        near[rows, : first.shape[1]] = some[np.take_along_axis(few, first, axis=1)]
        far[rows, : first.shape[1]] = np.take_along_axis(d, first, axis=1)
    return near, far


def neighbour_means(points: DataFrame, by: str, k: int) -> DataFrame:
    """(``by``, rx, ry, mx, my): each point's residual and the mean of those of its ``k`` nearest others of its run, by squared distance, ties by idx.

    Points are (``by``, idx, x, y, rx, ry), idx being unique in a run; those without finite coordinates take no part. A task searches a leaf of a quadtree.
    Only points whose ``k``-th neighbour there is farther off than the leaf's border ask the leaves that lie within that distance, place by place, which send
    what is near their border. Of points that share a place the first ``k + 1`` are candidates, so copies make no pairs.
    """
    spark = points.sparkSession
    kind, number = (points.schema[c].dataType.simpleString() for c in (by, "idx"))
    inf = F.lit(float("inf"))
    good = points.where((F.col("x") < inf) & (F.col("x") > -inf) & (F.col("y") < inf) & (F.col("y") > -inf))
    spread = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    edges = good.groupBy(by).agg(_finer(F.count(F.lit(1))).alias("scale"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.when(spread > 0, spread).otherwise(1.0).alias("side"))
    edges = cut(edges)
    good = good.join(F.broadcast(edges) if edges.count() <= BROADCAST else edges, by).withColumns({"u": (F.col("x") - F.col("x0")) / F.col("side"), "v": (F.col("y") - F.col("y0")) / F.col("side")})
    leaves = leaves_of(good, by)
    n_leaves, n_hot = leaves.agg(F.count(F.lit(1)), F.count_if("hot")).first()
    small = F.broadcast if n_leaves <= BROADCAST else lambda df: df
    scales = leaves.groupBy(by).agg(F.collect_set("scale").alias("scales"))
    placed = good.drop("scale").join(small(scales), by).withColumn("scale", F.explode("scales")).withColumns(_cells())
    placed = placed.join(small(leaves.select(by, "scale", "cx", "cy", "leaf", "hot")), [by, "scale", "cx", "cy"])
    # Room to the leaf's border, none at the edge of the square; a little less, as u and v are rounded.
    scale = F.col("scale")
    room = [F.when(F.col(c) > 0, F.col(at) * scale - F.col(c)).otherwise(inf) for c, at in (("cx", "u"), ("cy", "v"))]
    room += [F.when(F.col(c) < scale - 1, F.col(c) + 1 - F.col(at) * scale).otherwise(inf) for c, at in (("cx", "u"), ("cy", "v"))]
    placed = placed.withColumn("room", (F.least(*room) / scale - 1e-12) * F.col("side"))
    rows = placed.where("not hot").select("leaf", by, "idx", "x", "y", "rx", "ry", "room")
    n_tasks = tasks(n_leaves, 2)

    def own(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("idx", ignore_index=True)
        places, of = np.unique(df["x"].to_numpy() + 1j * df["y"].to_numpy(), return_inverse=True)
        grouped = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[grouped], np.arange(len(places)))
        nth = np.empty(len(df), dtype=int)
        nth[grouped] = np.arange(len(df)) - starts[of[grouped]]
        rows = np.flatnonzero(nth <= k)
        xy, values = df[["x", "y"]].to_numpy(), df[["rx", "ry"]].to_numpy(dtype=float)
        near, d = nearest(xy[grouped[starts]], xy[rows], k + 1)
        near = np.where(near >= 0, rows[near], -1)
        mine = near[of]
        kept = mine != np.arange(len(df))[:, None]
        kept[kept.all(axis=1), k] = False
        kept &= mine >= 0
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = (values[mine] * kept[:, :, None]).sum(axis=1) / kept.sum(axis=1)[:, None]
        far, room = d[of, k], df["room"].to_numpy()
        out = np.isfinite(room) & (np.sqrt(far) * (1 + 1e-9) >= room)
        first = np.flatnonzero(out & (nth == 0))
        lists = {c: np.full(len(df), None, dtype=object) for c in ("nd", "ni", "nx", "ny")}
        for i in first:
            some = near[of[i]][near[of[i]] >= 0]
            for c, v in zip(lists, (d[of[i], : len(some)], df["idx"].to_numpy()[some], values[some, 0], values[some, 1]), strict=True):
                lists[c][i] = v
        done = df[[by, "leaf", "idx", "x", "y", "rx", "ry"]].assign(mx=mean[:, 0], my=mean[:, 1], far=far, out=out)
        return done.assign(**lists)

    found = f"nd array<double>, ni array<{number}>, nx array<double>, ny array<double>"
    schema = f"{by} {kind}, leaf bigint, idx {number}, x double, y double, rx double, ry double, mx double, my double, far double, out boolean, {found}"
    means = rows.repartition(n_tasks, "leaf").groupBy("leaf").applyInPandas(own, schema)
    path = fresh_path(spark, "neighbours")
    # A point that is settled leaves its place and its leaf behind.
    means.select(by, "rx", "ry", "out", *(F.when(F.col("out"), F.col(c)).alias(c) for c in ("leaf", "idx", "x", "y", "far", "nd", "ni", "nx", "ny")), *(F.when(~F.col("out"), F.col(c)).alias(c) for c in ("mx", "my"))).write.parquet(path)
    means = spark.read.parquet(path)
    result = [by, "rx", "ry", "mx", "my"]
    done = means.where("not out").select(*result)
    listed = F.arrays_zip(F.col("nd").alias("d"), F.col("ni").alias("i"), F.col("nx").alias("x"), F.col("ny").alias("y")).alias("near")

    def mean(c: str) -> Column:
        others = F.slice(F.filter("near", lambda e: e["i"] != F.col("idx")), 1, k)
        return F.aggregate(others, F.lit(0.0), lambda acc, e: acc + e[c]) / F.size(others)

    if n_hot:
        hot = placed.where("hot").select("leaf", by, "idx", "x", "y", "rx", "ry", "room")
        first = hot.withColumn("nth", F.row_number().over(Window.partitionBy("leaf").orderBy("idx"))).where(F.col("nth") <= k + 1).drop("nth")
        near = F.sort_array(F.collect_list(F.struct(F.lit(0.0).alias("d"), F.col("idx").alias("i"), F.col("rx").alias("x"), F.col("ry").alias("y")))).alias("near")
        done = done.unionByName(hot.join(small(first.groupBy("leaf").agg(near)), "leaf").select(by, "rx", "ry", mean("x").alias("mx"), mean("y").alias("my")))
        rows = rows.unionByName(first)
    if means.where("out").isEmpty():
        return done

    # A leaf of few points has no k-th neighbour: one lies no farther off than all of the next leaf that has enough.
    box = ["x_lo", "x_hi", "y_lo", "y_hi"]
    boxes = leaves.select(by, F.col("leaf").alias("to"), "held", *box)
    mine = leaves.select(by, "leaf", F.col("held").alias("own"), *(F.col(c).alias(f"o{c}") for c in box))
    wide = F.pow(F.greatest(F.col("x_hi") - F.col("ox_lo"), F.col("ox_hi") - F.col("x_lo")), 2) + F.pow(F.greatest(F.col("y_hi") - F.col("oy_lo"), F.col("oy_hi") - F.col("y_lo")), 2)
    sparse = mine.where(F.col("own") <= k).join(small(boxes.where(F.col("held") > k)), by).groupBy("leaf").agg((F.min(wide) * (1 + 1e-9)).alias("most"))
    asks = means.where("nd is not null").select(by, "leaf", "x", "y", "far", listed).join(small(sparse), "leaf", "left")
    asks = asks.withColumn("far", F.when(F.col("far") < inf, F.col("far")).otherwise(F.coalesce("most", inf))).drop("most")
    reach = asks.groupBy("leaf").agg((F.max("far") * (1 + 1e-9)).alias("reach"))
    apart = F.pow(F.greatest(F.col("x_lo") - F.col("ox_hi"), F.col("ox_lo") - F.col("x_hi"), F.lit(0.0)), 2) + F.pow(F.greatest(F.col("y_lo") - F.col("oy_hi"), F.col("oy_lo") - F.col("y_hi"), F.lit(0.0)), 2)
    pairs = cut(mine.drop("own").join(small(reach), "leaf").join(small(boxes.drop("held")), by).where((F.col("leaf") != F.col("to")) & (apart <= F.col("reach"))).drop(by))
    sent = asks.drop("near").join(small(pairs.select("leaf", "to", *box)), "leaf")
    sent = sent.where(F.pow(_gap(F.col("x"), "x_lo", "x_hi"), 2) + F.pow(_gap(F.col("y"), "y_lo", "y_hi"), 2) <= F.col("far") * (1 + 1e-9)).select("to", by, "x", "y", "far")
    border = pairs.select(F.col("to").alias("leaf"), "reach", *(f"o{c}" for c in box))
    close = F.pow(_gap(F.col("p.x"), "ox_lo", "ox_hi"), 2) + F.pow(_gap(F.col("p.y"), "oy_lo", "oy_hi"), 2) <= F.col("reach")
    near_border = rows.drop("room", by).alias("p").join(small(border).alias("b"), (F.col("p.leaf") == F.col("b.leaf")) & close, "left_semi")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("idx", ignore_index=True)
        nth = c.groupby(["x", "y"]).cumcount().to_numpy()
        c = c[nth <= k]
        near, d = nearest(q[["x", "y"]].to_numpy(), c[["x", "y"]].to_numpy(), k + 1, q["far"].to_numpy())
        good = (near >= 0) & (d <= q["far"].to_numpy()[:, None])
        columns = {"nd": d, **{n: (c[v].to_numpy()[near] if len(c) else near) for n, v in (("ni", "idx"), ("nx", "rx"), ("ny", "ry"))}}
        out = q[[by, "x", "y"]].assign(**{n: [v[g] for v, g in zip(a, good, strict=True)] for n, a in columns.items()})
        return out[good.any(axis=1)]

    theirs = sent.repartition(n_tasks, "to").groupBy("to").cogroup(near_border.repartition(n_tasks, "leaf").groupBy("leaf")).applyInPandas(meet, f"{by} {kind}, x double, y double, {found}")
    lists = asks.select(by, "x", "y", "near").unionByName(theirs.select(by, "x", "y", listed))
    lists = lists.groupBy(by, "x", "y").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    late = means.where("out").select(by, "idx", "x", "y", "rx", "ry").join(lists, [by, "x", "y"])
    return done.unionByName(late.select(by, "rx", "ry", mean("x").alias("mx"), mean("y").alias("my")))
