"""Sort-means, NN-descent and Merkle manifests against brute force, with nulls, ties, repeats and odd columns."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from terrakey.llm import merkle, registry, sort_means, vector_links

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("name", ["op11_sort_means", "op12_nn_descent", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(str(x) for _, x in sorted(zip(names, row, strict=True))) for row in found.fetchall())
    df = registry.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect()) == want


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")


def lloyd(rows, k, rounds, seed, size):
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [c for _, c in first]
    for turn in range(rounds + 1):
        found = []
        for _, v in good:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            found.append((d.index(min(d)), min(d)))
        if turn < rounds:
            for c in range(len(centroids)):
                own = [v for (_, v), (a, _) in zip(good, found, strict=True) if a == c]
                if own:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((i, *f) for (i, _), f in zip(good, found, strict=True)), centroids


def test_sort_means_equals_plain_search(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (4, 5))
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.4, 5)).round(2).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (400, None), (401, [1.0] * 4), (402, [None] * 5), (403, [float("nan")] * 5), (404, [float("inf")] + [0.0] * 4)]
    got, centroids = sort_means.sort_means(vectors(spark, rows), k=6, rounds=4, size=5)
    want, c = lloyd(rows, 6, 4, 3, 5)
    assert sorted(tuple(r) for r in got.collect()) == want and centroids.tolist() == c


def test_sort_means_of_few_large_and_no_vectors(spark):
    one, c = sort_means.sort_means(vectors(spark, [(1, [1e300, -1e300]), (1, [1e300, -1e300])]), size=2)
    assert [(r["cluster"], r["distance"]) for r in one.collect()] == [(0, 0)] * 2 and len(c) == 2 and abs(c[0][0]) == sort_means.BOUND
    none, c = sort_means.sort_means(vectors(spark, [(1, [1.0])]), size=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance"] and len(c) == 0


def brute_links(rows, similarity=0.9):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v) else None for _, v in rows]
    n, comp = [0] * len(rows), list(range(len(rows)))
    for i, u in enumerate(units):
        for j, v in enumerate(units):
            if i != j and u is not None and v is not None and len(u) == len(v) and u @ v >= similarity:
                n[i] += 1
                a, b = comp[i], comp[j]
                comp = [a if c == b else c for c in comp]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    return sorted(((i, n[k], least[comp[k]]) for k, (i, _) in enumerate(rows)), key=str)


def near(rng, v, noise):
    v = v / np.linalg.norm(v)
    return v + rng.normal(0, noise / np.sqrt(len(v)), len(v))


@pytest.mark.parametrize("noise", [0.02, 0.14, 0.3])
def test_links_equal_brute_force(spark, noise):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(200 + i, near(rng, base[0], noise).tolist()) for i in range(150)]  # a group far larger than a list
    rows += [(400 + i, near(rng, base[1 + i], noise).tolist()) for i in range(30)]
    rows += [(500, base[5].tolist()), (500, base[5].tolist()), (None, base[6].tolist()), (501, None), (502, [0.0] * 24), (503, [None] * 24), (504, [float("nan")] * 24), (505, []), (506, [1.0, 0.0]), (507, [2.0, 0.0])]
    out = vector_links.vector_links(vectors(spark, rows), k=6).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)
    want = brute_links(rows)
    true = sum(n for _, n, _ in want)
    assert len(got) == len(want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True) if g[0] != 500 and g[0] is not None)
    assert sum(n for _, n, _ in got) >= 0.97 * true and out[0]["audit_recall"] >= 0.97
    if noise < 0.3:
        assert got == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out if r["vec_id"] is not None)


def test_links_of_no_rows(spark):
    assert vector_links.vector_links(vectors(spark, [])).count() == 0
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in vector_links.vector_links(vectors(spark, [(3, None)])).collect()] == [(0, 3, True)]


def test_sketches_err_less_than_their_slack():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    v = rng.normal(size=(400, 64)) + 2 * rng.normal(size=64)
    out = next(vector_links._units(iter([pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(v.tolist())], ["vec_id", "v"])])))
    u = np.stack([np.frombuffer(x, float) for x in out.column(1).to_pylist()])
    s = vector_links._sketches(out.column(2), 0, 400)
    assert np.abs(u @ u.T - s @ s.T).max() < vector_links.SLACK


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def f(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def fold(leaves):
    siblings, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            r = p // 3 * 3
            siblings[k].append((nodes[r:p], nodes[p + 1 : r + 3]))
        nodes, at = [H("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], siblings


def brute_proofs(rows):
    leaf = lambda r, t: H("".join(map(f, (*r[:4], t))))
    trees, out = [], []
    for s in sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees.append((own, *fold([leaf(r, r[4]) for r in own])))
    root, upper = fold([t[1] for t in trees])
    for (own, sub, siblings), top in zip(trees, upper, strict=True):
        for r, path in zip(own, siblings, strict=True):
            whole, cur = path + top, leaf(r, r[4])
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            now = leaf(r, r[4].replace("\n", "")) if altered else cur
            for b, a in whole:
                now = H("".join(b) + now + "".join(a))
            out.append((r[0], cur, sub, root, H("".join(x for b, a in whole for x in b + a)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [2, 7, 20_000])
def test_manifest_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(merkle, "PART", part)
    rows = [(i * 3 % 101, "big", "en", i, f"line {i}\nmore\n") for i in range(60)]
    rows += [(7, "é", None, None, None), (8, None, "de", 0, ""), (None, "big", "en", 1, "a\nb"), (None, None, None, None, None), (9, "", "fr", 2, "x" * 50_000 + "\n"), (5, "big", "en", 2, "same"), (5, "big", "en", 2, "same"), (5, "Z", "x", 1, "y\n")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", tree string")
    got = merkle.verified(merkle.manifest(docs)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_proofs(rows)


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.verified(merkle.manifest(spark.createDataFrame([(1, "a", "en", 1, "x")], DOCS))).collect()
    assert [tuple(r) for r in one] == brute_proofs([(1, "a", "en", 1, "x")])
    m = merkle.manifest(spark.createDataFrame([], DOCS))
    assert m.root is None and merkle.verified(m).count() == 0
