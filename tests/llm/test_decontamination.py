import re

import numpy as np
from pyspark.sql import functions as F

from terrakey.llm import registry
from terrakey.llm.decontamination import contamination, edit_distance

DATA = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"(?:[^\x00-\x7f]|[A-Za-z0-9])+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def nearest(item, text):
    """Least edit distance of a word list to a part of another."""
    last = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        now = [i + 1]
        for j, y in enumerate(text):
            now.append(min(last[j] + (x != y), last[j + 1] + 1, now[j] + 1))
        last = now
    return min(last)


def test_edit_distance_against_plain_rule():
    rng = np.random.default_rng(3)
    items, regions = rng.integers(1, 4, (50, 6)).astype(np.uint64), rng.integers(1, 4, (50, 11)).astype(np.uint64)
    got, _ = edit_distance(items, regions)
    assert got.tolist() == [nearest(a.tolist(), b.tolist()) for a, b in zip(items, regions, strict=True)]


def test_whole_table_equals_brute_force(spark):
    """Brute force over all pairs that share a run of three words, which every pair in range does."""
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    grams = {}
    for i, w in items.items():
        for k in range(len(w) - 1):
            grams.setdefault(tuple(w[k : k + 2]), set()).add(i)
    want = {}
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        w = words(d.text)
        hits = {}
        for k in range(len(w) - 1):
            for i in grams.get(tuple(w[k : k + 2]), ()):
                hits[i] = hits.get(i, 0) + 1
        for i, n in hits.items():
            if n >= len(items[i]) - 1 - 2 * int(0.2 * len(items[i])):
                e = nearest(items[i], w)
                if e <= int(0.2 * len(items[i])):
                    want[d.doc_id, i] = e
    got = {(r.doc_id, r.item_id): r.edits for r in registry.QUERIES["op6_decontamination"](spark, DATA).collect()}
    assert want and got == want


def test_planted_edits_are_found(spark):
    rng = np.random.default_rng(4)
    bench = [(i, " ".join(f"b{i}x{j}" for j in range(10 + 3 * i))) for i in range(15)]
    docs, want = [], {}
    for i, text in bench:
        for e in range(4):
            w = text.split()
            k = min(e, int(0.2 * len(w)))
            for at in rng.choice(np.arange(1, len(w) - 1), k, replace=False):
                w[at] = "edited"
            if e == 3:
                del w[len(w) // 2]
                w.insert(2, "put")
            n = nearest(text.split(), w)
            d = 10 * i + e
            docs.append((d, "Before,  it " + ", ".join(w).upper() + ". After\nit " * 3))
            if n <= int(0.2 * len(text.split())):
                want[d, i] = n
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in got} == want
    texts = dict(docs)
    for r in got:
        if r.edits == 0:
            assert words(texts[r.doc_id][r.start : r.end]) == dict(bench)[r.item_id].split()


def test_edges_and_passes(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, "... !"), (None, "é ü ß x y z"), (5, "solo")], "item_id long, text string")
    rows = [(1, "xx one two three four five six yy"), (1, "xx one two three four five six yy"), (2, None), (3, ""), (None, "É é ü ß x y z"), (7, "z " * 60_000 + "one two three four five six"), (8, "a Solo act")]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, start int, item_id string")
    want = sorted([(1, 1), (1, 1), (None, -1), (7, 1), (8, 5)], key=str)
    assert sorted(((r.doc_id, r.item_id) for r in contamination(docs, bench).collect()), key=str) == want
    monkeypatch.setattr("terrakey.llm.decontamination.ITEMS_PER_PASS", 2)
    assert sorted(((r.doc_id, r.item_id) for r in contamination(docs, bench).collect()), key=str) == want
    assert contamination(docs.limit(0), bench).collect() == [] and contamination(docs, bench.where(F.lit(False))).collect() == []
