"""Instance builders, location probes, archives and small images, on files made here."""

import os
import time
import zipfile

import numpy as np

from terrakey.functions.ground import M_PER_DEG_LAT
from terrakey.operators import alignment
from terrakey.operators import instances as ins
from terrakey.operators import kernels as k
from terrakey.operators import rounds
from terrakey.sources import archives

SOURCES = "source string, path string, dtype string, lines int, samples int, gsd double, line_share double, loc_index int"


def scene(seed, h, w):
    rng = np.random.default_rng(seed)
    return k.stretch(sum(s * k.blur(rng.normal(size=(h, w)), s) for s in (1.5, 3.0, 6.0)))


def test_pointing_draws_in_a_fixed_order():
    r = np.random.default_rng(5)
    turn, zoom, dx, dy, tilt = r.uniform(-5, 5), r.uniform(0.95, 1.05), r.uniform(-20, 20), r.uniform(-20, 20), r.uniform(-5e-6, 5e-6)
    h = ins.pointing((100, 200), np.random.default_rng(5))
    c, s = zoom * np.cos(np.radians(turn)), zoom * np.sin(np.radians(turn))
    assert np.allclose(h[:2, :2], [[c, -s], [s, c]]) and np.allclose(h[2], [tilt, 0.4 * tilt, 1])
    middle = h @ [100, 50, 1]
    assert np.allclose(middle[:2], [100 + dx, 50 + dy])
    fixed = ins.pointing((100, 200), np.random.default_rng(5), 90.0, 2.0)
    assert np.allclose(fixed[:2, :2], [[0, -2], [2, 0]])


def test_made_instances_have_their_maps(spark, tmp_path):
    img = scene(1, 420, 400)
    (tmp_path / "p.img").write_bytes(img.tobytes())
    rows = [("p", str(tmp_path / "p.img"), "UnsignedByte", 420, 400, 0.5, 0.5, 0), ("gone", str(tmp_path / "none"), "UnsignedByte", 420, 400, 0.5, 0.5, 1)]
    df = ins.made_instances(spark.createDataFrame(rows, SOURCES), tile=128)
    out = {r["id"]: r for r in df.collect()}
    levels = sum(len(f.levels) for f in ins.FAMILIES.values())
    assert len(out) == 2 * levels and all(r["status"] == "FILL" and r["pixels_a"] is None and r["split"] == "test" for r in out.values() if r["source"] == "gone")
    own = [r for r in out.values() if r["source"] == "p"]
    assert {r["status"] for r in own if r["family"] in ("sun", "view")} == {"OK"}
    assert [r["status"] for r in sorted((r for r in own if r["family"] == "scale"), key=lambda r: r["level"])] == ["OK", "OK", "FILL", "FILL"]
    coarse = next(r for r in own if r["family"] == "scale" and r["level"] == 2)
    assert coarse["coarse_px"] == round(256 * 0.5 / 4.46) and coarse["footprint_m"] == 128 and coarse["h_a"] == coarse["h_b"] == 128
    pairs = df.where("source = 'p' and family = 'view' and level in (0, 10, 30, 1.25, 90)").withColumn("pair", df["id"])
    found = {r["run"]: r for r in alignment.match_pairs(pairs).collect()}
    assert len(found) == 5
    for name, r in found.items():
        assert r["n_inliers"] >= 15 and k.disagreement(np.array(r["h"]).reshape(3, 3), np.array(out[name]["h_true"]).reshape(3, 3), 128) < 1, name
    lit = {r["level"]: r for r in own if r["family"] == "sun"}
    assert lit[0.0]["shadow_a"] == lit[180.0]["shadow_a"] or abs(lit[0.0]["shadow_a"] - lit[180.0]["shadow_a"]) < 0.1
    assert ins.made_instances(spark.createDataFrame([], SOURCES), tile=64).count() == 0


def test_band_instances_along_a_strip(spark, tmp_path):
    base = scene(2, 400, 42).astype("<f4")
    cube = np.stack([base * (1 + 0.01 * b) + np.random.default_rng(b).normal(0, 2, base.shape) for b in range(20)]).astype("<f4")
    (tmp_path / "c.qub").write_bytes(cube.tobytes())
    df = spark.createDataFrame([("c", str(tmp_path / "c.qub"), "IEEE754LSBSingle", 400, 42, 20), ("short", str(tmp_path / "c.qub"), "IEEE754LSBSingle", 60, 42, 20)], "source string, path string, dtype string, lines int, samples int, bands int")
    out = ins.band_instances(df, tile=64, lead=30, near=(2, 6), far=(10, 30)).collect()
    assert sorted(r["id"] for r in out) == [f"c_bands_L{i:04d}" for i in range(5)] and all(r["status"] == "OK" and (r["h_a"], r["w_a"]) == (64, 40) for r in out)
    first = next(r for r in out if r["loc_index"] == 1)
    want = k.stretch(cube[2:6, 94:158, 1:41].astype(float).mean(axis=0).astype(np.float32))
    assert np.array_equal(np.frombuffer(first["pixels_a"], np.uint8).reshape(64, 40), want)


def product(name, path, img, lon=0.0):
    h, w = img.shape
    step = [(lon, 0.0), (lon + (w - 1) / M_PER_DEG_LAT, 0.0), (lon, -(h - 1) / M_PER_DEG_LAT), (lon + (w - 1) / M_PER_DEG_LAT, -(h - 1) / M_PER_DEG_LAT)]
    path.write_bytes(img.tobytes())
    return (name, str(path), "UnsignedByte", h, w, *(v for p in step for v in p))


PRODUCTS = "product string, path string, dtype string, lines int, samples int, " + ", ".join(f"{c}_{x} double" for c in ("ul", "ur", "ll", "lr") for x in ("lon", "lat"))


def test_locations_are_picked_by_structure(spark, tmp_path):
    a = k.stretch(k.blur(np.random.default_rng(3).normal(size=(900, 120)), 25.0))
    a[560:700] = scene(4, 140, 120)
    fill = np.zeros((900, 120), np.uint8)
    rows = [product("a", tmp_path / "a.img", a), product("b", tmp_path / "b.img", a), product("f", tmp_path / "f.img", fill), product("far", tmp_path / "far.img", a, lon=5.0), ("gone", str(tmp_path / "gone"), *product("g", tmp_path / "g.img", a)[2:])]
    pairs = spark.createDataFrame([("1", "a", "b"), ("2", "a", "f"), ("3", "a", "far"), ("4", "a", "gone"), ("5", "a", "unknown")], "run string, a string, b string")
    out = {r["run"]: r for r in ins.pick_locations(pairs, spark.createDataFrame(rows, PRODUCTS), tile=32, probe=64).collect()}
    assert set(out) == {"1", "2", "4"}
    lat = lambda line: -line / M_PER_DEG_LAT
    # Of the middles of seven parts, line 578 is the only one whose probe lies in the textured rows; rows count from the north, parts from the south.
    assert out["1"]["probed"] and abs(out["1"]["lat"] - lat(899 * (1 - 2.5 / 7))) < 1e-6 and out["1"]["score"] > 0
    for run in "24":
        assert not out[run]["probed"] and abs(out[run]["lat"] - lat(449.5)) < 1e-6


def test_real_instances_from_products(spark, tmp_path):
    a = scene(5, 700, 260)
    b = np.roll(a, (9, -6), (0, 1))
    noise = np.random.default_rng(6).integers(0, 256, a.shape).astype(np.uint8)
    rows = [product("a", tmp_path / "a.img", a), product("b", tmp_path / "b.img", b), product("n", tmp_path / "n.img", noise)]
    pairs = spark.createDataFrame([("F1", "a", "b"), ("F2", "a", "n")], "family string, a string, b string")
    out = ins.real_instances(pairs, spark.createDataFrame(rows, PRODUCTS), tile=96, across=2, along=4, across_m=30.0, along_m=30.0, decimation=2).collect()
    by = {r["id"]: r for r in out}
    assert len(by) == 16 and all(r["h_true"] is None and r["provenance"] == "REAL" for r in out)
    good = [r for r in out if r["family"] == "F1"]
    assert sum(r["status"] == "OK" for r in good) >= 6 and all(r["split"] == ("dev" if r["loc_index"] < 3 else "test") for r in good)
    alike = []
    for r in good:
        if r["status"] == "OK" and r["id"].endswith("_0"):  # the other column's windows are pulled in from the edge
            x, y = (np.frombuffer(r[f"pixels_{s}"], np.uint8).reshape(r[f"h_{s}"], r[f"w_{s}"]).astype(float) for s in "ab")
            alike.append(np.corrcoef(x[8:-8, 8:-8].ravel(), y[8:-8, 8:-8].ravel())[0, 1] > 0.8)
    assert len(alike) >= 3 and all(alike)
    assert not any(r["status"] == "OK" and np.corrcoef(np.frombuffer(r["pixels_a"], np.uint8), np.frombuffer(r["pixels_b"], np.uint8))[0, 1] > 0.3 for r in out if r["family"] == "F2")
    crowded = ins.real_instances(pairs.where("family = 'F1'"), spark.createDataFrame(rows, PRODUCTS), tile=96, across=2, along=40, across_m=30.0, along_m=30.0, decimation=2)
    assert crowded.where("status = 'DUPLICATE'").count() > 10


def test_archives_are_unpacked_member_by_member(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "CHUNK", 100)
    data = os.urandom(5000)
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data/a.img", data)
        z.writestr("data/b.xml", "<x/>")
        z.writestr("../outside", "no")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "node_modules").mkdir()
    with zipfile.ZipFile(tmp_path / "node_modules" / "two.zip", "w") as z:
        z.writestr("x", "x")
    rows = archives.unpack(spark, str(tmp_path)).collect()
    good = {r["member"]: r for r in rows if r["error"] is None}
    assert set(good) == {"data/a.img", "data/b.xml"} and good["data/a.img"]["bytes"] == 5000
    assert (tmp_path / "one" / "data" / "a.img").read_bytes() == data and not (tmp_path / "outside").exists()
    assert sorted((r["archive"].rpartition("/")[2], r["member"]) for r in rows if r["error"]) == [("broken.zip", None), ("one.zip", "../outside")]
    again = archives.unpack(spark, str(tmp_path)).collect()
    assert [r["archive"].rpartition("/")[2] for r in again] == ["broken.zip"]
    assert archives.unpack(spark, str(tmp_path / "nothing")).count() == 0


def test_small_images_are_made_again_when_their_source_is_newer(spark, tmp_path):
    (tmp_path / "full").mkdir()
    big, little = scene(7, 400, 300), scene(8, 20, 30)
    rows = []
    for name, img in (("big", big), ("little", little)):
        (tmp_path / "full" / f"{name}.img").write_bytes(img.tobytes())
        rows.append((name, str(tmp_path / "full" / f"{name}.img"), *img.shape))
    rows.append(("gone", str(tmp_path / "full" / "gone.img"), 5, 5))
    df, small = spark.createDataFrame(rows, "name string, path string, lines int, samples int"), str(tmp_path / "small")
    made = {r["name"]: r["bytes"] for r in archives.refresh_small(df, str(tmp_path / "full"), small, 40).collect()}
    assert made == {"big": 40 * 30, "little": 600}
    got = np.frombuffer((tmp_path / "small" / "big.img").read_bytes(), np.uint8).reshape(40, 30)
    assert np.array_equal(got, k.area(big, (40, 30)))
    assert archives.refresh_small(df, str(tmp_path / "full"), small, 40).count() == 0
    later = time.time() + 5
    os.utime(tmp_path / "full" / "little.img", (later, later))
    assert [r["name"] for r in archives.refresh_small(df, str(tmp_path / "full"), small, 40).collect()] == ["little"]



def test_suns_of_a_scene_share_its_relief_and_shadows_are_those_of_plain_rays(monkeypatch):
    rng = np.random.default_rng(11)
    img = k.stretch(k.blur(rng.normal(size=(52, 44)), 2.0))
    found, plain = [], k.relief
    monkeypatch.setattr(k, "relief", lambda x: (found.append(1), plain(x))[1])
    for seed, azimuth in enumerate((45.0, 90.0, 105.0, 225.0)):
        k.relight(img, 45.0, 15.0, seed, 22.0, 0.10)
        k.relight(img, azimuth, 22.0, seed, 22.0, 0.10)
    assert len(found) == 1
    for azimuth, elevation, z in ((45.0, 15.0, plain(img)), (200.0, 4.0, plain(img)), (90.0, 60.0, rng.random((9, 30))), (0.0, 0.0, np.zeros((6, 6)))):
        slope, rows, cols = np.tan(np.radians(max(elevation, k.LEAST_ELEVATION))), *z.shape
        dx, dy = np.sin(np.radians(azimuth)), -np.cos(np.radians(azimuth))
        high, horizon = z * 22.0, np.full(z.shape, -np.inf)
        for i in range(1, int(min(160, max(24, 22.0 / max(slope, 1e-3)))) + 1):
            y, x = np.clip(np.arange(rows) + dy * i, 0, rows - 1), np.clip(np.arange(cols) + dx * i, 0, cols - 1)
            r, c = np.floor(y).astype(int), np.floor(x).astype(int)
            s, t = (y - r)[:, None], x - c
            low, up = (high[j][:, c] * (1 - t) + high[j][:, np.minimum(c + 1, cols - 1)] * t for j in (r, np.minimum(r + 1, rows - 1)))
            horizon = np.maximum(horizon, low * (1 - s) + up * s - i * slope)
        assert (k.lit(z, azimuth, elevation, 22.0) == k.blur((horizon <= high + k.TOUCH).astype(float), k.SOFT)).all()


def test_rows_leave_a_task_in_frames_of_some():
    rows = [{"id": i, "pixels": bytes(10), "h": None if i % 2 else [1.0]} for i in range(150)]
    frames = list(rounds.framed(iter(rows), ["id", "pixels", "h"], object))
    assert [len(f) for f in frames] == [64, 64, 22] and [i for f in frames for i in f["id"]] == list(range(150))
    heavy = [{"id": i, "pixels": bytes(rounds.BYTES // 2)} for i in range(5)]
    assert [len(f) for f in rounds.framed(iter(heavy), ["id", "pixels"])] == [3, 2] and list(rounds.framed([], ["id"])) == []
