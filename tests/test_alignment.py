"""The chain from pixels to metrics, against known answers."""

import json

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from terrakey.operators import alignment, arms, features
from terrakey.operators import kernels as k
from terrakey.sources.scenarios import scenarios, write_matches, write_once

PAIR = "pair long, h_a int, w_a int, pixels_a binary, h_b int, w_b int, pixels_b binary"
PLACE = "gsd_a double, gsd_b double, x_a int, y_a int, x_b int, y_b int"


def scene(seed, side):
    return k.stretch(k.blur(np.random.default_rng(seed).normal(size=(side, side)), 2.0))


def row(i, a, b, *more):
    return (i, *a.shape, a.tobytes(), *b.shape, b.tobytes(), *more)


def test_resize_keeps_means_and_lines():
    img = scene(1, 60)
    assert abs(k.resize(img, (20, 15), "area").mean() - img.mean()) < 1
    assert (k.resize(img, (20, 20), "area") == np.clip(np.round(k.shrink(img, 3)), 0, 255)).all()
    line = np.tile(np.arange(0, 200, 4, dtype=np.uint8), (50, 1))
    for kind in ("linear", "cubic"):
        wide = k.resize(line, (50, 100), kind).astype(float)
        assert np.abs(np.diff(wide[:, 8:-8], axis=1) - 2).max() <= 1
        for size, wanted in ((7, 19), (19, 7), (5, 5)):
            assert np.allclose(k.weights(size, wanted, kind).sum(axis=1), 1)
    # Half-way between cells a cubic with slope -0.75 weighs -3/32 and 19/32.
    assert np.allclose(k.weights(8, 16, "cubic")[8, 2:6], [-0.03515625, 0.26171875, 0.87890625, -0.10546875])


def test_match_chain(spark):
    a = scene(2, 160)
    h = np.array([[1.0, 0.01, 6.0], [-0.01, 1.0, -4.0], [0.0, 0.0, 1.0]])
    b = k.warp(a, h, a.shape, mirror=True).astype(np.uint8)
    rows = [row(1, a, b), row(2, a, np.zeros((160, 160), np.uint8)), (3, None, None, None, 4, 4, bytes(16)), row(4, np.zeros((0, 0), np.uint8), a)]
    pairs = spark.createDataFrame(rows, PAIR)
    out = {r["run"]: r for r in alignment.match_pairs(pairs, detector="learned").collect()}
    assert set(out) == {"1", "2", "3", "4"}
    good = out["1"]
    assert good["n_inliers"] >= 15 and not good["degenerate"] and good["rmse"] < 1.5 and good["warning"] is None
    assert k.disagreement(np.array(good["h"]).reshape(3, 3), h, 160) < 1.5
    assert good["detector"] == "gradient" and "learned" in good["note"]
    for run in "234":
        r = out[run]
        assert r["n_matches"] == 0 and r["n_inliers"] == 0 and r["h"] is None and r["rmse"] is None and r["degenerate"] and r["warning"]
    assert alignment.match_pairs(pairs.limit(0)).count() == 0
    ncc = {r["run"]: r for r in alignment.ncc_before_after(pairs, spark.createDataFrame([(r["run"], r["h"]) for r in out.values()], "run string, h array<double>")).collect()}
    assert ncc["1"]["ncc_after"] > 0.9 > ncc["1"]["ncc_before"]
    assert ncc["2"]["ncc_before"] is None and ncc["3"]["ncc_after"] is None
    assert len(ncc) == 4


def test_keypoints_of_thinned_images_keep_their_frame(spark):
    a = scene(3, 192)
    pairs = spark.createDataFrame([row(1, a, k.resize(a, (96, 96), "area"))], PAIR)
    points = alignment.keypoints(pairs, max_side=96).toPandas()
    assert set(points["side"]) == {"a", "b"} and points["x"].max() > 96 and set(points["detector"]) == {"gradient"}
    points = alignment.keypoints(pairs, max_side=96, order=("corners",)).toPandas()
    assert (points["x"] % 2 == 0).all()


def turned(a, degrees, size):
    t, mid = np.radians(degrees), (len(a) - 1) / 2
    c, s = size * np.cos(t), size * np.sin(t)
    h = np.array([[c, -s, mid - c * mid + s * mid], [s, c, mid - s * mid - c * mid], [0, 0, 1]])
    return h, k.warp(a, h, a.shape).astype(np.uint8)


@pytest.mark.parametrize(("degrees", "size"), [(30, 1.0), (0, 1.5), (30, 1.5), (140, 0.7)])
def test_gradient_keypoints_survive_turns_and_scales(degrees, size):
    a = k.stretch(sum(s * k.blur(np.random.default_rng(7).normal(size=(256, 256)), s) for s in (1.5, 3.0, 6.0)))
    h, b = turned(a, degrees, size)
    p, q = (features.gradient_keypoints(x, 1000) for x in (a, b))
    ia, ib, _, _ = features.ratio_matches(p.desc, q.desc)
    found, inliers = k.robust_map(np.c_[p.x, p.y][ia], np.c_[q.x, q.y][ib])
    assert inliers.sum() >= 40 and k.disagreement(found, h, 256) < 0.5


def test_gradient_keypoints_of_flat_and_tiny_images():
    for img in (np.full((64, 64), 7, np.uint8), np.zeros((5, 5), np.uint8)):
        found = features.gradient_keypoints(img)
        assert len(found) == 0 and found.desc.shape == (0, 128)


def test_a_detector_that_raises_leaves_other_pairs_alone(spark):
    a, bright = scene(8, 128), np.clip(scene(9, 128).astype(int) // 2 + 128, 0, 255).astype(np.uint8)
    pairs = spark.createDataFrame([row(1, a, a), row(2, bright, bright)], PAIR)
    loud = alignment.Settings(suppress_shadows=False)
    registry = {**features.DETECTORS, "bad": lambda img, limit: 1 / 0}
    out = {r["run"]: r for r in alignment.match_pairs(pairs, "bad", loud, registry).collect()}
    assert all(r["detector"] == "gradient" and "ZeroDivisionError" in r["note"] and r["n_inliers"] >= 15 for r in out.values())
    level = {r["run"]: r for r in alignment.match_pairs(pairs, "selective", loud, {**features.DETECTORS, "selective": selective}).collect()}
    assert level["1"]["detector"] == "selective" and level["1"]["note"] is None
    assert level["2"]["detector"] == "gradient" and "ValueError" in level["2"]["note"]
    none = alignment.match_pairs(pairs, None, loud, {}).collect()
    assert all(r["detector"] is None and r["degenerate"] and r["n_matches"] == 0 for r in none)


def selective(img, limit):
    """Fails on one of two scenes, told apart by a pixel of the normalised image."""
    found = features.corner_keypoints(img, limit)
    if abs(float(img.mean()) - SELECT[0]) > abs(float(img.mean()) - SELECT[1]):
        raise ValueError("not this one")
    return found


SELECT = [float(k.normalise(scene(8, 128), False)[0].mean()), float(k.normalise(np.clip(scene(9, 128).astype(int) // 2 + 128, 0, 255).astype(np.uint8), False)[0].mean())]


def instances(spark, n=6):
    rows = []
    for i in range(n):
        a = k.stretch(sum(s * k.blur(np.random.default_rng(20 + i).normal(size=(128, 128)), s) for s in (1.5, 3.0)))
        h, b = turned(a, 2 + 20 * (i % 2), 1.0)
        rows.append((f"i{i}", "F", "made", "dev", i, "NO_LOCK" if i == 4 else "OK", 1.0 + i, None if i == 5 else h.ravel().tolist(), 128, 128, a.tobytes(), 128, 128, b.tobytes()))
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in arms.INSTANCE.items()) + ", h_a int, w_a int, pixels_a binary, h_b int, w_b int, pixels_b binary")


def test_a_round_is_resumed_and_judged(spark, tmp_path):
    path, df = str(tmp_path / "store"), instances(spark)
    assert arms.run_arms(df.where("id < 'i3'"), path, 1) == 6
    assert arms.run_arms(df, path, 1) == 6  # only the rest
    assert arms.run_arms(df, path, 1) == 0
    assert arms.run_arms(df.limit(1), path, 2, config="other", arms={"M2_corners": ("corners",)}) == 1
    one = arms.stored(spark, path).where("round = 1")
    assert one.count() == 12
    out = {(r["id"], r["arm"]): r for r in arms.judged(one).collect()}
    good = out["i0", "M1_gradient"]
    assert good["verdict"] == "SUCCESS" and good["err"] < 1 and good["subpixel"] and good["agree_px"] < 3 and good["detector"] == "gradient"
    assert out["i1", "M1_gradient"]["verdict"] == "SUCCESS" and out["i1", "M2_corners"]["verdict"] != "SUCCESS"
    assert out["i4", "M1_gradient"]["verdict"] == "NO_LOCK" and out["i4", "M1_gradient"]["n_inliers"] == 0
    blind = out["i5", "M1_gradient"]
    assert blind["err"] is None and blind["heldout_px"] < 1 and blind["verdict"] in ("SUCCESS", "MARGINAL")
    assert (blind["verdict"] == "SUCCESS") == (blind["confirmed_by"] is not None)
    assert arms.stored(spark, str(tmp_path / "none")).count() == 0


def test_locate_overlap_finds_a_moved_strip(spark):
    a = scene(5, 512)
    noise = np.random.default_rng(6).integers(0, 256, (512, 512)).astype(np.uint8)
    at = (1.0, 1.0, 256, 256, 256, 256)
    rows = [row(1, a, np.roll(a, (-37, 22), (0, 1)), *at), row(2, a, noise, *at), row(3, a, a, None, 1.0, 256, 256, 256, 256), (4, None, None, None, None, None, None, *at)]
    coarse = k.resize(a, (256, 256), "area")
    rows.append(row(5, a, coarse, 1.0, 2.0, 256 - 24, 256 + 16, 128, 128))
    pairs = spark.createDataFrame(rows, f"{PAIR}, {PLACE}")
    out = {r["run"]: r for r in alignment.locate_overlap(pairs, tile=128, across_m=120.0, along_m=120.0, decimation=4).collect()}
    found = out["1"]
    assert found["decision"] == "measured" and abs(found["dx"] + 22) <= 1 and abs(found["dy"] - 37) <= 1
    assert found["window_a"] == [int(256 + found["dx"]) - 64, int(256 + found["dy"]) - 64, int(256 + found["dx"]) + 64, int(256 + found["dy"]) + 64]
    assert found["window_b"] == [192, 192, 320, 320] and abs(found["shift_m_along"] - 37) <= 1
    assert out["2"]["decision"] in ("rejected", "prior") and out["2"]["peak"] < 0.4
    assert all(out[i]["decision"] == "rejected" and out[i]["peak"] is None and out[i]["window_a"] is None for i in "34")
    other = out["5"]
    assert other["decision"] == "measured" and other["gsd_ratio"] == 2 and abs(other["dx"] - 24) <= 2 and abs(other["dy"] + 16) <= 2
    assert other["window_b"] == [96, 96, 160, 160]


def test_scenarios_and_results_written_once(spark, tmp_path):
    image = {"url": "/a.png", "sensor": "TMC-2", "gsd_m": 5.0}
    scenes = [{"id": "s1", "title": "one", "image_a": image, "image_b": image, "ground_truth_homography": MOVE}, {"id": "s2", "extra": 1}]
    (tmp_path / "c.json").write_text(json.dumps({"generated_utc": "2020", "scenarios": scenes}, indent=1))
    got = {r["id"]: r for r in scenarios(spark, str(tmp_path / "c.json")).collect()}
    assert got["s1"]["h"] == [1.0, 0.0, 5.0, 0.0, 1.0, -3.0, 0.0, 0.0, 1.0] and got["s1"]["image_a"]["gsd_m"] == 5.0
    assert got["s2"]["h"] is None and got["s2"]["image_a"] is None
    assert scenarios(spark, str(tmp_path / "none.json")).count() == 0
    df = spark.createDataFrame([("r1", 1, 2.0)], "run string, n int, extra double")
    write_once(df, str(tmp_path / "out"), ["n", "run", "missing"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["n", "run", "missing"]
    with pytest.raises(AnalysisException):
        write_once(df, str(tmp_path / "out"), ["n"])
    points = spark.createDataFrame([("r1", 1, 1.0, 2.0, 3, 4.0, 5.0, 0.5), ("r2", 1, 1.0, 2.0, 3, 4.0, 5.0, None)], "run string, idx_a int, xa double, ya double, idx_b int, xb double, yb double, err double")
    write_matches(points, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("run = 'r2'").count() == 1


MOVE = [[1.0, 0.0, 5.0], [0.0, 1.0, -3.0], [0.0, 0.0, 1.0]]


def test_arms_of_a_pair_share_what_comes_before_detection(monkeypatch):
    a = scene(5, 96)
    b = k.warp(a, np.array([[1.0, 0.02, 2.0], [-0.02, 1.0, -1.0], [0.0, 0.0, 1.0]]), a.shape, mirror=True).astype(np.uint8)
    equalised, plain = [], k.clahe
    monkeypatch.setattr(k, "clahe", lambda *x: (equalised.append(1), plain(*x))[1])
    pair = alignment.ready(a, b, alignment.Settings())
    rows = [alignment.measured(pair, order, alignment.Settings(), features.DETECTORS) for order in arms.ARMS.values()]
    assert len(equalised) == 2 and [r["detector"] for r in rows] == ["gradient", "corners"]
    assert rows[0]["ncc_before"] == rows[1]["ncc_before"] == k.masked_correlation(a, b, np.ones(a.shape, bool))
    assert alignment.ready(np.zeros((0, 0), np.uint8), b, alignment.Settings()) is None
    assert alignment.measured(None, ("corners",), alignment.Settings(), features.DETECTORS)["degenerate"]


def test_gradients_are_worked_out_where_they_are_asked_for():
    octave = features.pyramid(scene(6, 64))[0]
    g, (h, w) = features.Gradients(octave), octave.shape[1:]
    level, y, x, before = np.array([1, 3]), np.array([[10.2, 63.4], [40.0, -3.0]]), np.array([[20.4, 30.0], [0.0, 5.0]]), g.known.sum()
    mag, ang = g.at(level, y, x)
    assert g.known.sum() == before + 1
    gx, gy = octave[1, 10, 21] - octave[1, 10, 19], octave[1, 11, 20] - octave[1, 9, 20]
    assert mag[0, 0] == np.hypot(gx, gy) and ang[0, 0] == np.arctan2(gy, gx) and (mag.ravel()[1:] == 0).all()


def test_extrema_equal_a_plain_search():
    octave = features.pyramid(scene(7, 48))[0]
    d = octave[1:] - octave[:-1]
    d[2, 20, 20:22] = d.max() + 1  # two equal ones side by side count both
    want = []
    for s in (1, -1):
        for z, y, x in np.ndindex(*(n - 2 for n in d.shape)):
            v = s * d[z : z + 3, y : y + 3, x : x + 3]
            if v[1, 1, 1] >= v.max() and v[1, 1, 1] > 0.5 * features.CONTRAST / features.LEVELS:
                want.append((z + 1, y + 1, x + 1))
    assert list(zip(*(v.tolist() for v in features._extrema(d)), strict=True)) == want


def test_ratio_matches_equal_a_plain_search_where_distances_tie():
    rng = np.random.default_rng(3)
    b = rng.normal(size=(400, 16))
    b[300:] = b[:100]
    a = np.concatenate([b[50:80] + 1e-9, rng.normal(size=(300, 16)) * 1e-4, b[150:200] + 0.01, b[:5]])
    for scale in (1.0, 1e-3, 1e3):
        ia, ib, d, _ = features.ratio_matches(a * scale, b * scale)
        full = ((a[:, None] * scale - b[None] * scale) ** 2).sum(axis=2)
        order = np.argsort(full, axis=1, kind="stable")
        d1, d2 = (np.sqrt(full[np.arange(len(a)), order[:, i]]) for i in (0, 1))
        want = np.flatnonzero((d2 > 0) & (d1 < 0.8 * d2))
        assert ia.tolist() == want.tolist() and ib.tolist() == order[want, 0].tolist() and np.allclose(d, d1[want], rtol=1e-9)
