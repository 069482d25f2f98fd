"""Windows of files against plain slicing, and locks from labels against known moves."""

import numpy as np
import pandas as pd
import pytest

from terrakey.functions.ground import M_PER_DEG_LAT
from terrakey.operators import alignment
from terrakey.operators import kernels as k
from terrakey.sources import windows as w

WINDOWS = "id int, path string, dtype string, lines int, samples int, bands int, sample0 int, line0 int, sample1 int, line1 int, band_lo int, band_hi int"


def pixels(r):
    return np.frombuffer(r["pixels"], r["pixel_type"]).reshape(r["h"], r["w"])


def test_windows_equal_slices(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    plain, cube = rng.integers(0, 60_000, (90, 70)).astype(">u2"), rng.normal(size=(5, 40, 30)).astype("<f4")
    (tmp_path / "plain.img").write_bytes(plain.tobytes())
    (tmp_path / "cube.qub").write_bytes(cube.tobytes())
    a, b = f"file:{tmp_path}/plain.img", str(tmp_path / "cube.qub")
    rows = [(i, a, "UnsignedMSB2", 90, 70, None, s, t, s + 20 + i, t + 15, None, None) for i, (s, t) in enumerate(rng.integers(-10, 80, (30, 2)).tolist())]
    rows += [(100 + i, b, "IEEE754LSBSingle", 40, 30, 5, i - 3, 2 * i - 5, i + 9, 2 * i + 8, lo, hi) for i, (lo, hi) in enumerate([(0, 5), (-3, 2), (4, 9), (2, 2), (9, 12), (3, 1)])]
    rows += [(200, a, "UnsignedMSB2", 90, 70, None, 0, 10, 70, 60, None, None), (201, a, "what", 90, 70, None, 0, 0, 5, 5, None, None), (202, str(tmp_path / "none"), "UnsignedByte", 9, 9, 1, 0, 0, 5, 5, None, None)]
    rows += [(203, a, "UnsignedMSB2", 900, 70, None, 0, 0, 5, 5, None, None), (204, None, None, None, None, None, None, None, None, None, None, None)]
    monkeypatch.setattr(w, "PAGE", 64)
    out = {r["id"]: r for r in w.read_windows(spark.createDataFrame(rows, WINDOWS), ["id"]).collect()}
    assert len(out) == len(rows)
    for i, _, _, lines, samples, _, s0, l0, s1, l1, lo, hi in rows[:-4]:
        box = max(0, s0), max(0, l0), min(samples, s1), min(lines, l1)
        if box[2] <= box[0] or box[3] <= box[1]:
            assert out[i]["pixels"] is None and "empty" in out[i]["error"]
            continue
        if lo is None:
            want = plain[box[1] : box[3], box[0] : box[2]]
        else:
            lo = max(0, min(4, lo))
            want = cube[lo : max(lo + 1, min(5, hi)), box[1] : box[3], box[0] : box[2]].astype(float).mean(axis=0).astype(np.float32)
        assert np.array_equal(pixels(out[i]), want) and [out[i][c] for c in w.WINDOW[:4]] == list(box) and out[i]["error"] is None
    assert all(out[i]["pixels"] is None and out[i]["error"] for i in (201, 202, 203, 204))
    assert w.read_windows(spark.createDataFrame([], WINDOWS), ["id"]).count() == 0


def test_pages_are_read_once_and_few_are_kept(tmp_path, monkeypatch):
    data = bytes(range(256)) * 40
    (tmp_path / "f").write_bytes(data)
    monkeypatch.setattr(w, "PAGE", 100)
    monkeypatch.setattr(w, "HELD", 4)
    p = w.Pages(str(tmp_path / "f"))
    assert p.read(150, 300) == data[150:450] and p.reads == 1  # pages 1 to 4 in one read
    assert p.read(210, 150) == data[210:360] and p.reads == 1  # held
    assert p.read(0, len(data)) == data and len(p.held) <= 4
    assert p.read(len(data) - 5, 5) == data[-5:]


def test_stretch_and_area_of_large_images_equal_the_plain_ones():
    rng = np.random.default_rng(2)
    for v in (rng.integers(0, 256, (97, 61)).astype(np.uint8), rng.integers(-3000, 9000, (50, 40)).astype("<i2"), np.full((9, 9), 7, ">u2"), rng.normal(size=(30, 30)).astype("f4")):
        assert np.array_equal(k.stretch8(v), k.stretch(v))
    img = rng.integers(0, 256, (101, 67)).astype(np.uint8)
    for shape in ((25, 16), (101, 33), (7, 67), (50, 50)):
        d = np.abs(k.area(img, shape, rows=3).astype(int) - k.resize(img, shape, "area").astype(int))
        assert d.max() <= 1 and (d > 0).mean() < 0.02


@pytest.mark.parametrize("ratio", [1, 2])
def test_a_moved_strip_is_found_from_its_label(spark, tmp_path, ratio):
    a = k.stretch(sum(s * k.blur(np.random.default_rng(3).normal(size=(600, 400)), s) for s in (2.0, 4.0)))
    b = np.roll(a, (-29, 18), (0, 1))  # the label does not know
    b = k.area(b, (600 // ratio, 400 // ratio))
    noise = np.random.default_rng(4).integers(0, 256, b.shape).astype(np.uint8)
    for name, img in (("a", a), ("b", b), ("n", noise)):
        (tmp_path / f"{name}.img").write_bytes(img.tobytes())
    lon, lat = 399 / M_PER_DEG_LAT, 599 / M_PER_DEG_LAT
    corners = {"ul": (0.0, 0.0), "ur": (lon, 0.0), "ll": (0.0, -lat), "lr": (lon, -lat)}

    def product(name, img, known=True):
        return {"product": name, "path": str(tmp_path / f"{name[0]}.img"), "dtype": "UnsignedByte", "lines": img.shape[0], "samples": img.shape[1]} | {f"{c}_{x}": v if known else None for c, both in corners.items() for x, v in zip(("lon", "lat"), both, strict=True)}

    kinds = "product string, path string, dtype string, lines int, samples int, " + ", ".join(f"{c}_{x} double" for c in corners for x in ("lon", "lat"))
    products = spark.createDataFrame(pd.DataFrame([product("a", a), product("b", b), product("n", noise), product("x", a), product("bare", b, False)]).astype(object).where(lambda d: d.notna(), None), kinds)
    rows = [("1", "a", "b"), ("2", "a", "n"), ("3", "a", "gone"), ("4", "a", "bare"), ("5", "x", "b"), (None, "a", "b")]
    pairs = spark.createDataFrame([(*r, lon / 2, -lat / 2) for r in rows], "run string, a string, b string, lon double, lat double")
    out = {r["run"]: r for r in alignment.lock_products(pairs, products, tile=128, across_m=60.0, along_m=80.0, decimation=2).collect()}
    assert set(out) == set("12345")
    found = out["1"]
    assert found["decision"] == "measured" and abs(found["dx"] + 18) <= ratio and abs(found["dy"] - 29) <= ratio and abs(found["gsd_ratio"] - ratio) < 0.02
    assert abs(found["shift_m_along"] - 29) <= ratio
    assert out["2"]["decision"] in ("rejected", "prior") and out["2"]["peak"] < 0.4
    assert all(out[i]["decision"] == "rejected" and out[i]["peak"] is None for i in "345")
