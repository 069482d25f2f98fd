import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrakey.functions import homography as hg
from terrakey.functions.ground import Footprint
from terrakey.operators import kernels as k
from terrakey.operators.catalogue import one
from terrakey.operators.matching import knn
from terrakey.operators.overlap import overlap_join
from terrakey.operators.registration import fit_runs, greedy_dedup
from terrakey.sources.labels import discover
from terrakey.sources.raster import dtype_of, register

H = np.array([[0.98, 0.05, 12.0], [-0.04, 1.01, -7.0], [1e-5, -2e-5, 1.0]])


def scene(seed=0, side=96):
    return k.stretch(k.blur(np.random.default_rng(seed).normal(size=(side, side)), 2.0))


def test_fit_recovers_a_known_map():
    a = np.random.default_rng(1).uniform(0, 1024, (50, 2))
    assert np.abs(k.fit_map(a, k.apply_map(H, a)) - H).max() < 1e-8
    assert k.fit_map(a[:3], a[:3]) is None


@pytest.mark.parametrize("method", ["magsac", "ransac", "lmeds", "rho", "no such"])
def test_robust_map_with_outliers(method):
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 1024, (100, 2))
    b = k.apply_map(H, a) + rng.normal(0, 0.3, a.shape)
    b[:30] += rng.uniform(50, 400, (30, 2))
    h, inliers = k.robust_map(a, b, method)
    assert inliers[30:].mean() > 0.95 and not inliers[:30].any()
    assert k.disagreement(h, H) < 0.5
    assert k.robust_map(a[:3], b[:3])[0] is None


def test_resampled_errors():
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 1024, (200, 2))
    b = k.apply_map(H, a) + rng.normal(0, 0.5, a.shape)
    assert 0.5 < k.heldout_error(a, b, 0) < 1.0 and k.map_precision(a, b, 0) < 0.3
    assert k.heldout_error(a[:9], b[:9], 0) is None and k.map_precision(a[:19], b[:19], 0) is None
    plain, more = k.polynomial_gain(a, b, 0)
    assert abs(plain - more) < 0.1  # a planar scene gains nothing
    bent = b + 20 * (a / 1024 - 0.5) ** 2
    plain, more = k.polynomial_gain(a, bent, 0)
    assert more < 0.8 * plain


def test_correlation_finds_a_cut_out():
    img = scene(4)
    found = k.lock(k.correlation(img, img[20:52, 33:65]))
    assert (found["x"], found["y"]) == (33, 20) and found["peak"] > 0.999 and found["ratio"] > 1.2


def test_image_kernels():
    img = scene(5)
    assert k.clahe(img).shape == img.shape and k.clahe(np.full((32, 32), 7, np.uint8)).std() == 0
    assert np.abs(k.warp(img, np.eye(3), img.shape) - img).max() < 1e-9
    moved = k.warp(img, np.array([[1, 0, 3], [0, 1, 2], [0, 0, 1.0]]), img.shape)
    assert np.allclose(moved[2:, 3:], img[:-2, :-3]) and (moved[:2] == 0).all()
    assert abs(k.blur(img, 3).mean() - img.mean()) < 3 and k.blur(img, 3).std() < img.std()
    assert k.degrade(img, 4, 1.0, 0.0, 0).shape == (24, 24)
    east, west = (k.relight(img, az, 30, 0).astype(float) for az in (90, 270))
    assert np.corrcoef(east.ravel(), west.ravel())[0, 1] < 0.6
    out, stats = k.normalise(img)
    assert (out[img <= 10] == 0).all() and 0 <= stats["shadow_fraction"] <= 1
    assert (k.stretch(np.full((4, 4), np.nan)) == 0).all() and k.texture(np.zeros((8, 8))) == 0
    points, desc = k.corners(img, 30)
    assert 4 < len(points) <= 30 and np.allclose(np.linalg.norm(desc, axis=1), 1)


def test_detect_match_fit(spark):
    """A moved scene from corners to a map, through Spark."""
    img = scene(6, 128)
    moved = np.clip(k.warp(img, np.array([[1, 0, 5], [0, 1, -3], [0, 0, 1.0]]), img.shape), 0, 255).astype(np.uint8)
    sides = []
    for x in (img, moved):
        p, d = k.corners(x, 80)
        sides.append(spark.createDataFrame(pd.DataFrame({"run": "r", "idx": range(len(p)), "x": p[:, 0], "y": p[:, 1], "desc": d.tolist()})))
    m = knn(*(s.select("run", "idx", "desc") for s in sides), k=1)
    a, b = (s.select("run", F.col("idx").alias(f"idx_{n}"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")) for s, n in zip(sides, "ab", strict=True))
    row = fit_runs(m.join(a, ["run", "idx_a"]).join(b, ["run", "idx_b"])).first()
    assert not row.degenerate and row.detector == "descriptors"
    assert abs(row.h[2] - 5) < 0.5 and abs(row.h[5] + 3) < 0.5


def test_fit_runs_without_a_map(spark):
    df = spark.createDataFrame([("r", i, float(i), 0.0, float(i), 0.0) for i in range(3)], "run string, idx_a int, xa double, ya double, xb double, yb double")
    row = fit_runs(df).first()
    assert row.degenerate and row.h is None and row.rmse is None and row.n_inliers == 0


def test_knn_blocks_equal_plain_search(spark):
    rng = np.random.default_rng(7)
    p, q = rng.normal(size=(60, 8)), rng.normal(size=(70, 8))
    a, b = (spark.createDataFrame(pd.DataFrame({"run": 1, "idx": range(len(x)), "desc": x.tolist()})) for x in (p, q))
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
    want = {(i, r + 1): int(j) for i in range(60) for r, j in enumerate(np.argsort(d[i])[:2])}
    assert {(r.idx_a, r["rank"]): r.idx_b for r in knn(a, b, 2, block=16).collect()} == want


def test_greedy_dedup_equals_plain_fold(spark):
    rng = np.random.default_rng(8)
    xy = rng.uniform(0, 3000, (300, 2))
    kept, want = [], {}
    for i, (x, y) in enumerate(xy.tolist()):
        want[i] = not any(abs(x - a) < 256 and abs(y - b) < 256 for a, b in kept)
        if want[i]:
            kept.append((x, y))
    df = spark.createDataFrame([("f", i, x, y) for i, (x, y) in enumerate(xy.tolist())], "family string, idx int, x double, y double")
    assert {r.idx: r.keep for r in greedy_dedup(df).collect()} == want


def test_overlap_edges(spark):
    box = "id int, lon_min double, lon_max double, lat_min double, lat_max double"
    a = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0), (2, None, 5.0, 0.0, 5.0), (3, -20.0, 30.0, -20.0, 30.0)], box)
    b = spark.createDataFrame([(1, 10.0, 12.0, 0.0, 10.0), (2, 9.0, 12.0, 9.0, 12.0), (3, 50.0, 51.0, 0.0, 1.0)], box)
    for cell in (1.0, 7.0, 100.0):
        assert sorted((r.id_a, r.id_b) for r in overlap_join(a, b, cell).collect()) == [(1, 2), (3, 1), (3, 2)]


def test_affine_is_least_squares(spark):
    corners = {"ul": (0.0, 4.0), "ur": (3.1, 4.05), "ll": (0.02, 0.0), "lr": (3.0, -0.03)}
    row = {f"{c}_{x}": v for c, p in corners.items() for x, v in zip(("lon", "lat"), p, strict=True)} | {"lines": 101, "samples": 51}
    df = spark.createDataFrame([row]).select(*(c.alias(f"c{i}") for i, c in enumerate(Footprint.of().affine())))
    m = np.array([[0, 0, 1], [50, 0, 1], [0, 100, 1], [50, 100, 1.0]])
    want = np.concatenate([np.linalg.lstsq(m, np.array([corners[c][i] for c in ("ul", "ur", "ll", "lr")]), rcond=None)[0] for i in (0, 1)])
    assert np.allclose(list(df.first()), want)


def test_map_times_inverse_is_identity(spark):
    h = [F.lit(float(x)) for x in H.ravel()]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(hg.normalised(hg.product(h, hg.inverse(h)))))).first()
    assert np.allclose(list(row), np.eye(3).ravel(), atol=1e-9)


def test_seeds_equal_zlib(spark):
    row = spark.sql("SELECT crc32(CAST('F1/7' AS BINARY)) & 2147483647 AS s").first()
    assert row.s == zlib.crc32(b"F1/7") & 0x7FFFFFFF


def test_identifier_is_checked(spark):
    with pytest.raises(ValueError):
        one(spark.range(1).selectExpr("'x' AS id"), "id", "../etc")


def test_flat_raster_source(spark, tmp_path):
    img = np.arange(2 * 50 * 70, dtype="<u2").reshape(2, 50, 70)
    img.tofile(tmp_path / "a.img")
    register(spark)
    read = spark.read.format("flat_raster").options(path=str(tmp_path / "a.img"), lines=50, samples=70, bands=2, dtype="UnsignedLSB2", tile=32).load()
    rows = read.collect()
    assert len(rows) == 12
    for r in rows:
        part = np.frombuffer(r.pixels, r.dtype).reshape(r.h, r.w)
        assert (part == img[r.band, 32 * r.tile_row : 32 * r.tile_row + r.h, 32 * r.tile_col : 32 * r.tile_col + r.w]).all()
    assert read.where("tile_row = 1 and band = 0").count() == 3 and read.where("band = 9").count() == 0
    with pytest.raises(ValueError):
        dtype_of("float128")


def test_discovery(spark, tmp_path):
    label = "<P><Axis_Array><axis_name>Line</axis_name><elements>5</elements></Axis_Array><Axis_Array><axis_name>SAMPLE</axis_name><elements>{s}</elements></Axis_Array><name>OHRC</name></P>"
    for name, samples in (("ch2_a", 7), ("ch2_b", 0), ("ch2_c_b_brw", 7), ("ch2_d", 7), ("other", 7)):
        (tmp_path / f"{name}.xml").write_text(label.format(s=samples))
        if name != "ch2_d":
            (tmp_path / f"{name}.IMG").write_bytes(b"x")
    (tmp_path / "ch2_a.qub").write_bytes(b"x")
    (row,) = discover(spark, str(tmp_path)).collect()
    assert row.path.endswith("ch2_a.xml") and row.data_path.endswith("ch2_a.IMG") and (row.lines, row.samples, row.sensor) == (5, 7, "OHRC")


def test_stream_of_verdicts(spark, tmp_path):
    from terrakey.streaming.summary import verdict_windows

    rows = [(f"2020-01-01 0{i % 3}:00:00", "AB"[i % 2], "SUCCESS" if i % 3 else "FAILURE") for i in range(12)]
    spark.createDataFrame(rows, "ts string, arm string, verdict string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts string, arm string, verdict string").parquet(str(tmp_path / "in"))
    q = verdict_windows(stream).writeStream.format("memory").queryName("verdicts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("verdicts").collect()) == 12


def first_come(rows, distance):
    kept, out = {}, []
    for family, idx, x, y in sorted(rows, key=lambda r: r[1]):
        ok = x is None or y is None or not any(abs(x - u) < distance and abs(y - v) < distance for u, v in kept.get(family, []))
        if ok and x is not None and y is not None:
            kept.setdefault(family, []).append((x, y))
        out.append((family, idx, ok))
    return out


@pytest.mark.parametrize("side", [300, 1500, 6000])
def test_greedy_dedup_in_rounds_equals_the_fold(spark, side):
    rng = np.random.default_rng(side)
    rows = [(["a", "b", None][i % 3], int(i), float(rng.integers(-side, side)), float(rng.integers(-side, side))) for i in rng.permutation(400)]
    rows += [("a", 1000, None, 1.0), ("a", 1001, 5.0, None)] + [("chain", i, 200.0 * i, 0.0) for i in range(8)]
    tiles = spark.createDataFrame(rows, "family string, idx long, x double, y double")
    assert sorted(map(str, map(tuple, greedy_dedup(tiles).collect()))) == sorted(map(str, first_come(rows, 256.0)))


def test_greedy_dedup_of_odd_tables(spark):
    schema = "family string, idx long, x double, y double, cell string"
    assert greedy_dedup(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([("a", 1, 2.0, 2.0, "x")] * 2 + [("a", None, float("nan"), 2.0, None)], schema)
    assert sorted(str(r["keep"]) for r in greedy_dedup(twice).collect()) == ["False", "True", "True"]


def test_neighbours_by_squares_where_roots_are_equal(spark):
    # Two squares that differ in their last bit and have one root: the nearer point has the larger idx.
    far = 1.0
    while np.sqrt(far) != np.sqrt(np.nextafter(far, 0)):
        far = np.nextafter(far, 2)
    near = np.nextafter(far, 0)
    x, y = np.sqrt(near), 0.0
    while x * x != near:
        x = np.nextafter(x, 0)
        y = np.sqrt(max(near - x * x, 0.0))
        if x * x + y * y == near:
            break
    z, w = np.sqrt(far), 0.0
    while z * z + w * w != far:
        z = np.nextafter(z, 0)
        w = np.sqrt(far - z * z)
    points = spark.createDataFrame([("r", 9, [float(x), float(y)]), ("r", 5, [float(z), float(w)])], "run string, idx int, desc array<double>")
    centre = spark.createDataFrame([("r", 1, [0.0, 0.0])], "run string, idx int, desc array<double>")
    assert [r["idx_b"] for r in knn(centre, points, 1, squared=True).collect()] == [9]
    assert [r["idx_b"] for r in knn(centre, points, 1).collect()] == [5]


@pytest.mark.parametrize("method", ["magsac", "ransac", "lmeds", "rho"])
def test_large_runs_are_fitted_over_tasks_as_in_one(spark, method):
    rng = np.random.default_rng(11)
    parts = []
    for run, wrong in (("r1", 0.3), ("r2", 0.4), ("r3", 0.0)):
        a = rng.uniform(0, 1024, (600, 2))
        b = k.apply_map(H, a) + rng.normal(0, 0.4, a.shape)
        n = int(600 * wrong)
        b[:n] += rng.uniform(30, 300, (n, 2))
        parts.append(pd.DataFrame({"run": run, "idx_a": np.arange(600), "xa": a[:, 0], "ya": a[:, 1], "xb": b[:, 0], "yb": b[:, 1]}))
    parts.append(pd.DataFrame({"run": "tiny", "idx_a": [0, 1, 2], "xa": [0.0, 1, 2], "ya": [0.0, 1, 2], "xb": [0.0, 1, 2], "yb": [0.0, 1, 2]}))
    parts.append(pd.DataFrame({"run": [None, "r1"], "idx_a": [1, 9999], "xa": [0.0, None], "ya": [0.0, 1], "xb": [0.0, 1], "yb": [0.0, 1]}))
    df = spark.createDataFrame(pd.concat(parts).astype(object).where(lambda d: d.notna(), None), "run string, idx_a long, xa double, ya double, xb double, yb double")
    one = {r["run"]: r for r in fit_runs(df, method).collect()}
    many = {r["run"]: r for r in fit_runs(df, method, task_matches=2).collect()}
    assert set(one) == set(many) == {"r1", "r2", "r3", "tiny"}
    for run in ("r1", "r2", "r3"):
        x, y = one[run], many[run]
        assert x["n_matches"] == y["n_matches"] == 600 and abs(x["n_inliers"] - y["n_inliers"]) <= 2 and not y["degenerate"]
        assert k.disagreement(np.array(x["h"]).reshape(3, 3), np.array(y["h"]).reshape(3, 3)) < 0.05
        assert abs(x["rmse"] - y["rmse"]) < 0.02
        for c in ("heldout_px", "heldout_h", "heldout_hpoly"):
            assert abs(x[c] - y[c]) < 0.06, c
        assert abs(x["precision_px"] - y["precision_px"]) < 0.05
    for r in (one["tiny"], many["tiny"]):
        assert r["h"] is None and r["degenerate"] and r["n_inliers"] == 0 and r["rmse"] is None and r["heldout_px"] is None


def folded(xy, distance=256):
    """Tiles in order, dropped near a kept one; kept ones by cells."""
    cells, want = {}, {}
    for i, (x, y) in enumerate(xy):
        cx, cy = int(x // distance), int(y // distance)
        near = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in cells.get((cx + a, cy + b), ()))
        want[i] = not any(abs(x - p[0]) < distance and abs(y - p[1]) < distance for p in near)
        if want[i]:
            cells.setdefault((cx, cy), []).append((x, y))
    return want


@pytest.mark.parametrize("task_tiles", [3, 40, 20_000])
def test_greedy_dedup_of_dense_places_by_regions(spark, task_tiles):
    rng = np.random.default_rng(12)
    xy = np.concatenate([rng.uniform(0, 4000, (400, 2)), rng.normal(1500, 150, (300, 2)), np.full((60, 2), 777.0), np.c_[np.arange(-60, 60) * 130.0, np.arange(-60, 60) * 40.0]])
    rng.shuffle(xy)
    rows = [(None if i % 2 else "f", i, x, y) for i, (x, y) in enumerate(xy.tolist())] + [("f", -1, None, 1.0), ("f", -2, float("nan"), 1.0)]
    got = {(r.family, r.idx): r.keep for r in greedy_dedup(spark.createDataFrame(rows, "family string, idx int, x double, y double"), task_tiles=task_tiles).collect()}
    assert len(got) == len(rows) and got["f", -1] and got["f", -2]
    for family, part in (("f", 0), (None, 1)):
        own = [i for i in range(len(xy)) if i % 2 == part]
        want = folded(xy[own].tolist())
        assert {i: got[family, i] for i in own} == {i: want[n] for n, i in enumerate(own)}


@pytest.mark.parametrize(("step", "task_tiles", "most"), [(200.0, 20_000, 3), (200.0, 1_500, 20), (90.0, 20_000, 3)])
def test_greedy_dedup_of_a_long_chain_takes_few_rounds(spark, monkeypatch, step, task_tiles, most):
    from terrakey.operators import registration

    rounds, real = [], registration.cut
    monkeypatch.setattr(registration, "cut", lambda df: (rounds.append(df.columns), real(df))[1])
    chain = [(i * step, 0.3 * i * step) for i in range(10_000)]
    df = spark.createDataFrame([("s", i, x, y) for i, (x, y) in enumerate(chain)], "family string, idx int, x double, y double")
    got = {r.idx: r.keep for r in greedy_dedup(df, task_tiles=task_tiles).collect()}
    assert got == folded(chain) and sum("first" in c and "level" not in c for c in rounds) <= most


def test_percentiles_by_histograms_equal_the_aggregate(spark, monkeypatch):
    from pyspark.sql import functions as F

    from terrakey.operators import order

    monkeypatch.setattr(order, "FEW", 5)
    monkeypatch.setattr(order, "BINS", 4)
    rng = np.random.default_rng(13)
    rows = [("a", float(x)) for x in rng.normal(size=700)] + [("b", float(x)) for x in np.exp(rng.normal(0, 6, 400))] + [("c", 2.0)] * 50 + [("c", 3.0), ("d", 1.5), ("e", None), (None, 4.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    at = {"p1": 0.01, "t1": 1 / 3, "median": 0.5, "p90": 0.9, "p99": 0.99}
    want, got = ({r["k"]: r for r in order.percentiles(df, ["k"], "x", at, narrow=n).collect()} for n in (False, True))
    assert set(want) == set(got) and not order.is_large(df)
    for k_, r in want.items():
        for n in at:
            assert (r[n] is None and got[k_][n] is None) or got[k_][n] == pytest.approx(r[n], rel=1e-12), (k_, n)
    assert order.percentiles(df.where(F.lit(False)), ["k"], "x", at, narrow=True).count() == 0


def test_large_tables_take_the_histograms_and_give_the_same(spark, monkeypatch):
    from terrakey.operators import evaluation, order, raster
    from terrakey.plans import evaluation as plans
    from terrakey.plans.raster import pixels

    data = "/root/testdata/sf0.001"
    few = lambda: (sorted(raster.to_uint8(pixels(spark, data)).collect()), sorted(evaluation.terrain_tertiles(plans.judged(spark, data)).select("id", "arm", "terrain").collect(), key=str))
    want = few()
    monkeypatch.setattr(order, "LARGE", 0)
    monkeypatch.setattr(order, "FEW", 50)
    assert order.is_large(pixels(spark, data)) and few() == want


def test_tiles_and_pairs_without_pixels(spark):
    from terrakey.operators.registration import lock_pairs, map_tiles

    img = scene(5)
    tiles = spark.createDataFrame([(1, 96, 96, img.tobytes()), (2, None, 96, img.tobytes()), (3, 96, 96, None)], "tile long, h int, w int, pixels binary")
    out = {r["tile"]: r for r in map_tiles(tiles, lambda x, _: x[::2, ::2].copy()).collect()}
    assert (out[1]["h"], out[1]["w"]) == (48, 48) and all((out[i]["h"], out[i]["w"], bytes(out[i]["pixels"])) == (0, 0, b"") for i in (2, 3))
    pair = "pair long, h_a int, w_a int, pixels_a binary, h_b int, w_b int, pixels_b binary"
    part = np.ascontiguousarray(img[20:52, 33:65])
    rows = [(1, 96, 96, img.tobytes(), 32, 32, part.tobytes()), (2, 96, 96, None, 32, 32, part.tobytes()), (3, 32, 32, part.tobytes(), 96, 96, img.tobytes()), (4, None, 96, img.tobytes(), 32, 32, part.tobytes())]
    out = {r["pair"]: r for r in lock_pairs(spark.createDataFrame(rows, pair)).collect()}
    assert (out[1]["x"], out[1]["y"]) == (33, 20) and all(out[i]["peak"] is None and out[i]["x"] is None for i in (2, 3, 4))


def test_samples_of_four_by_the_block_are_those_of_single_draws():
    for n in (5, 6, 17, 300, 5000):
        one, two = np.random.default_rng(n), np.random.default_rng(n)
        assert (np.stack([one.choice(n, 4, replace=False) for _ in range(400)]) == k.fours(two, n, 400)).all()
        assert one.random() == two.random()


def test_maps_in_closed_form_are_those_of_the_fit():
    rng = np.random.default_rng(4)
    a, b = rng.uniform(0, 256, (200, 4, 2)), rng.uniform(0, 256, (200, 4, 2))
    a[:5, 2] = (a[:5, 0] + a[:5, 1]) / 2  # three on a line
    (maps, ok), (rough, sure) = k.fit_fours(a, b), k.rough_fours(a, b)
    rough = rough / rough[:, 2:, 2:]
    assert not sure[:5].any() and sure[5:].mean() > 0.95
    assert ok[sure].all() and np.allclose(maps[sure], rough[sure], rtol=1e-5, atol=1e-5)


def test_the_best_of_many_samples_is_that_of_one_after_the_other(monkeypatch):
    """A map without matches takes all samples, of which few may be fitted with care."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (120, 2)).astype(float), rng.integers(0, 256, (120, 2)).astype(float)
    draws, best = np.random.default_rng(7), -np.inf
    picks = [draws.choice(len(a), 4, replace=False) for _ in range(2000)]
    for p in picks:
        h, ok = k.fit_fours(a[p][None], b[p][None])
        if ok[0]:
            best = max(best, float(k.SCORES["magsac"](k.residuals(h[0], a, b), 3.0)))
    fitted, fit = [], k.fit_fours
    monkeypatch.setattr(k, "fit_fours", lambda x, y: (fitted.append(len(x)), fit(x, y))[1])
    (score, _), *_ = k.best_samples(a, b, "magsac", 3.0, iterations=2000, seed=7)
    assert abs(score - best) < 1e-9 and sum(fitted) < 500


def test_corners_are_taken_strongest_first_and_apart():
    img = k.blur(np.random.default_rng(3).uniform(0, 255, (96, 80)), 1.5).astype(np.uint8)
    xy, desc = k.corners(img, 50)
    more, _ = k.corners(img, 10_000)
    assert len(xy) == 50 and (more[:50] == xy).all() and np.allclose(np.linalg.norm(desc, axis=1), 1)
    far = np.abs(more[:, None] - more[None]).max(axis=2) + 99 * np.eye(len(more))
    assert far.min() > 4


def test_tasks_do_not_grow_as_fast_as_many_items():
    from terrakey.operators.rounds import tasks

    assert [tasks(n) for n in (0, 3, 200, 2048, 12_000, 72_000)] == [1, 1, 50, 512, 512, 1125]


def test_boxes_that_many_rows_share_are_dealt_to_many_tasks(spark, monkeypatch):
    """Rows of one box meet in blocks, so no task gives all their pairs; what depends on the boxes alone is worked out once for each pair of them."""
    from terrakey.operators import overlap

    monkeypatch.setattr(overlap, "BLOCK", 8)
    monkeypatch.setattr(overlap, "PAIRS", 100)
    names = "id long, lon_min double, lon_max double, lat_min double, lat_max double"
    a = spark.createDataFrame([(i, 0.0, 3.0, 0.0, 4.0) for i in range(40)] + [(100, 50.0, 53.0, 0.0, 4.0), (101, None, 3.0, 0.0, 4.0)], names)
    b = spark.createDataFrame([(i, 1.0, 4.0, -1.0, 3.0) for i in range(60)] + [(200, 3.0, 5.0, 0.0, 4.0)], names)
    out = overlap.overlap_join(a, b, more={"area": (F.col("lon_max") - F.col("lon_min")) * (F.col("lat_max") - F.col("lat_min"))})
    parts = out.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    rows = out.collect()
    assert {(r.id_a, r.id_b) for r in rows} == {(i, j) for i in range(40) for j in range(60)} and len(rows) == 2400 and {r.area for r in rows} == {6.0}
    assert len(parts) >= 8 and max(p["count"] for p in parts) <= 600
    assert overlap.overlap_join(a.where("id > 99"), b).collect() == []


def test_thirds_gather_no_family_in_a_task(spark, monkeypatch):
    """Limits of families are broadcast, so runs stay where they are, and large tables have them from histograms, with the same result."""
    from terrakey.operators import evaluation, order

    assert order.LARGE <= 256 << 20
    rows = [("f" if i % 3 else "g", i // 2, i % 2, float((i // 2) * 37 % 1009), "OK" if i % 11 else "FILL") for i in range(6000)]
    runs = spark.createDataFrame(rows, "family string, id long, arm int, texture double, status string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = evaluation.terrain_tertiles(runs)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        want = sorted(out.select("family", "id", "arm", "terrain").collect(), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    monkeypatch.setattr(order, "LARGE", -1)
    assert sorted(evaluation.terrain_tertiles(runs).select("family", "id", "arm", "terrain").collect(), key=str) == want


def test_a_sun_that_pairs_share_is_traced_once(monkeypatch):
    img = np.random.default_rng(2).integers(0, 255, (40, 48)).astype(np.uint8)
    traced, shifted = [], k._shifted
    monkeypatch.setattr(k, "_shifted", lambda *x: (traced.append(1), shifted(*x))[1])
    first = k.relight(img, 45.0, 15.0, 1, 22.0, 0.10)
    steps = len(traced)
    assert steps and (k.relight(img, 45.0, 15.0, 1, 22.0, 0.10) == first).all() and len(traced) == steps
    assert k.relight(img, 46.0, 15.0, 1, 22.0, 0.10).shape == img.shape and len(traced) == 2 * steps


def test_maps_of_many_sets_at_once_are_those_of_single_fits(monkeypatch):
    rng = np.random.default_rng(6)
    a = rng.random((12, 30, 2)) * 200
    b = a @ np.array([[1.0, 0.1], [-0.1, 1.0]]) + rng.normal(size=a.shape)
    a[3], b[5] = 7.0, 3.0  # all points of a side in one place
    maps, ok = k.fit_maps(a, b)
    for x, y, h, known in zip(a, b, maps, ok, strict=True):
        one = k.fit_map(x, y)
        assert known == (one is not None) and (one is None or np.array_equal(h, one))
    n, rng, want = 30, np.random.default_rng(4), []
    for _ in range(20):
        order = rng.permutation(n)
        h = k.fit_map(a[0][order[:21]], b[0][order[:21]])
        want.append(float(np.sqrt((k.residuals(h, a[0][order[21:]], b[0][order[21:]]) ** 2).mean())))
    monkeypatch.setattr(k, "fit_map", lambda *_: 1 / 0)
    assert k.heldout_error(a[0], b[0], 4) == float(np.median(want))


def test_warp_with_what_it_covers_and_mirrored():
    rng = np.random.default_rng(8)
    img = rng.integers(0, 255, (37, 51)).astype(np.uint8)
    for h in (np.array([[0.9, -0.3, 9.0], [0.2, 1.1, -6.0], [1e-3, 0, 1]]), np.diag([0.2, 0.3, 1.0]), np.array([[1.0, 0, 900.0], [0, 1, 0], [0, 0, 1]])):
        for mirror in (False, True):
            rows, cols = np.mgrid[0:40, 0:45]
            q = np.linalg.inv(h) @ np.stack([cols.ravel(), rows.ravel(), np.ones(cols.size)])
            x, y = q[0] / q[2], q[1] / q[2]
            total, cover = np.zeros(x.size), np.zeros(x.size)
            for dx in (0, 1):
                for dy in (0, 1):
                    c, r = np.floor(x).astype(int) + dx, np.floor(y).astype(int) + dy
                    inside = (c >= 0) & (c < 51) & (r >= 0) & (r < 37)
                    share = np.abs(1 - dx - (x - np.floor(x))) * np.abs(1 - dy - (y - np.floor(y)))
                    cm, rm = (np.abs((v + n - 1) % (2 * n - 2) - (n - 1)) for v, n in ((c, 51), (r, 37)))
                    total += share * (img[rm, cm] if mirror else np.where(inside, img[np.clip(r, 0, 36), np.clip(c, 0, 50)], 0))
                    cover += share * inside
            assert np.array_equal(k.warp(img, h, (40, 45), mirror).ravel(), total)
            if not mirror:
                shown, covered = k.warp_covered(img, h, (40, 45))
                assert np.array_equal(shown.ravel(), total) and np.array_equal(covered.ravel(), cover > 0.5)


@pytest.mark.parametrize("levels", [3, 50, 10_000])
def test_spaced_places_are_those_of_the_plain_fold(levels):
    rng = np.random.default_rng(levels)
    response = np.round(k.blur(rng.normal(size=(50, 41)), 1.5) * levels) / levels  # with equal neighbours
    near, want = np.zeros(response.shape, bool), []
    for at in np.argsort(-response.ravel(), kind="stable").tolist():
        y, x = divmod(at, 41)
        if response[y, x] > 0 and not near[y, x]:
            want.append((x, y))
            near[max(0, y - 4) : y + 5, max(0, x - 4) : x + 5] = True
    for limit in (7, 5000):
        assert list(map(tuple, k.spaced(response, limit, 4).tolist())) == want[:limit]


def test_hull_of_many_points_is_that_of_its_corners():
    rng = np.random.default_rng(9)
    angle = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    ring = np.c_[np.cos(angle), np.sin(angle)] * 90 + 100
    inner = rng.normal(size=(500, 2)) * 15 + 100
    assert k.hull_area(np.concatenate([inner, ring])) == k.hull_area(ring)
    grid = rng.integers(0, 9, (400, 2)).astype(float)
    assert k.hull_area(grid) == 64.0 and k.hull_area(np.c_[np.arange(60.0), np.arange(60.0)]) == 0.0
