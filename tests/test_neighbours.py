"""Means over nearest neighbours: exact at any density, for copies and hot places, and with work in proportion to the points."""

import numpy as np
import pandas as pd
import pytest

from terrakey.operators import evaluation, neighbours


def points(xy, run="a"):
    n = len(xy)
    rng = np.random.default_rng(7)
    return pd.DataFrame({"run": run, "idx": rng.permutation(n), "x": xy[:, 0], "y": xy[:, 1], "rx": rng.normal(size=n), "ry": rng.normal(size=n)})


def brute(df, k):
    """Each point's mean over its ``k`` nearest others of the run, ties by idx."""
    rows = []
    for run, g in df[np.isfinite(df["x"]) & np.isfinite(df["y"])].groupby("run"):
        g = g.sort_values("idx")
        x, y, r = g["x"].to_numpy(), g["y"].to_numpy(), g[["rx", "ry"]].to_numpy()
        d = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
        np.fill_diagonal(d, np.inf)
        means = r[np.argsort(d, axis=1, kind="stable")[:, :k]].mean(axis=1)
        rows += [(run, *p) for p in np.hstack([r, means])]
    return rows


def spread():
    rng = np.random.default_rng(1)
    even = rng.random((700, 2)) * 100
    lattice = np.stack(np.meshgrid(np.arange(25.0), np.arange(20.0)), axis=-1).reshape(-1, 2)
    dense = np.concatenate([50 + rng.normal(size=(400, 2)) * 1e-6, rng.random((9, 2)) * 1e5, [[-1e7, 3.0]]])
    copies = np.repeat(rng.integers(0, 9, (40, 2)).astype(float), 13, axis=0)
    hot = np.concatenate([np.full((150, 2), 3.0), rng.random((200, 2)) * 10, [[9e3, 9e3], [np.nan, 1.0]]])
    return {"even": even, "lattice": lattice, "dense": dense, "copies": copies, "hot": hot, "line": np.stack([np.arange(300.0), np.zeros(300)], axis=1)}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_means_equal_brute_force_over_many_leaves(spark, monkeypatch, broadcast):
    monkeypatch.setattr(neighbours, "EVEN", 16)
    monkeypatch.setattr(neighbours, "MOST", 32)
    monkeypatch.setattr(neighbours, "BROADCAST", broadcast)
    df = pd.concat([points(xy, run) for run, xy in spread().items()])
    found = neighbours.neighbour_means(spark.createDataFrame(df), "run", 8).collect()
    got, want = sorted(map(tuple, found)), sorted(brute(df, 8))
    assert [r[0] for r in got] == [r[0] for r in want] and np.allclose([r[1:] for r in got], [r[1:] for r in want], rtol=0, atol=1e-9)


def test_nearest_takes_the_earlier_of_ties():
    rng = np.random.default_rng(3)
    c = np.repeat(rng.integers(0, 12, (300, 2)).astype(float), 2, axis=0)[rng.permutation(600)]
    q = np.unique(c, axis=0)
    near, far = neighbours.nearest(q, c, 9)
    d = (q[:, None, 0] - c[:, 0]) ** 2 + (q[:, None, 1] - c[:, 1]) ** 2
    assert (near == np.argsort(d, axis=1, kind="stable")[:, :9]).all() and (far == np.sort(d, axis=1)[:, :9]).all()


def test_runs_may_share_idx(spark):
    rng = np.random.default_rng(5)
    a, b = points(rng.random((60, 2)), "a"), points(rng.random((50, 2)), "b")
    alone = [evaluation.residual_coherence(spark.createDataFrame(df), "run").first() for df in (a, b)]
    both = sorted(evaluation.residual_coherence(spark.createDataFrame(pd.concat([a, b])), "run").collect())
    assert [(r["run"], round(r["coherence"], 9), r["n"]) for r in both] == [(r["run"], round(r["coherence"], 9), r["n"]) for r in alone]


def shuffled(spark):
    """Rows written to shuffles by the session so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_points_travel_about_once(spark):
    df = spark.createDataFrame(points(np.random.default_rng(2).random((20_000, 2))))
    before = shuffled(spark)
    assert evaluation.residual_coherence(df, "run").first()["n"] == 20_000
    assert 20_000 <= sum(n for at, n in shuffled(spark).items() if at not in before) < 50_000
