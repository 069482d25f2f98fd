import random
import re

import pytest

from terrakey.llm import near_dedup
from terrakey.llm.near_dedup import near_duplicates

DATA = "/root/testdata/sf0.01"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    at = list(range(len(sets)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for x, (_, sx) in enumerate(sets):
        for y in range(x):
            sy = sets[y][1]
            if sx and sy and min(len(sx), len(sy)) * 100 >= percent * max(len(sx), len(sy)):
                inter = len(sx & sy)
                if 100 * inter >= percent * (len(sx) + len(sy) - inter):
                    at[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        low[root(x)] = min(low.get(root(x), i), i)
    return {(i, len(s), low[root(x)], i == low[root(x)]) for x, (i, s) in enumerate(sets)}


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (2, 5):
        got = near_duplicates(docs, k=k).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, k)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "A b c d"), (3, "a B c d"), (3, "a B c d"), (None, "a b c d"), (7, None), (8, ""), (9, " \n"), (1, "one"), (2, "ONE"), (11, long), (12, long + " x"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, key string, comp int")
    got = sorted(map(tuple, near_duplicates(docs, k=2).collect()), key=str)
    want = [(5, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (1, 1, 1, True), (2, 1, 1, False), (11, 29_999, 11, True), (12, 30_000, 11, False), (None, 0, None, False)]
    assert got == sorted(want, key=str)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_chain_of_near_copies(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[: 100 - 3 * j] + [f"n{x}" for x in range(3 * j)])) for j, i in enumerate((9, 4, 6, 2, 8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(docs, k=2).collect()} == brute(rows, 2)


@pytest.mark.parametrize(("k", "most"), [(1, 22), (2, 10)])
def test_families_with_members_beyond_the_limit(spark, k, most):
    """Copies edited apart from each other, tight groups among them, and copies of a second text that shares half of the first."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for start in (base, base[:60] + [f"v{i}" for i in range(60)]):
        for _ in range(60):
            w = list(start)
            for at in rng.sample(range(120), rng.randint(2, most)):
                w[at] = f"n{rng.randrange(40)}"
            rows.append((len(rows), " ".join(w)))
            for _ in range(rng.choice([0, 0, 0, 3])):
                near = list(w)
                near[rng.randrange(120)] = "x"
                rows.append((len(rows), " ".join(near)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, k)
    assert 10 < sum(kept for *_, kept in want) < len(rows) / 2
    assert {tuple(r) for r in near_duplicates(docs, k=k).collect()} == want


def shared_third(n, seed=6):
    """Texts that share a hundred words and have eighty of their own, some with near copies."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(n):
        own = [f"o{i}_{j}" for j in range(80)]
        rows.append((len(rows), " ".join(common + own)))
        if i % 25 == 0:
            own[rng.randrange(80)] = "other"
            rows.append((len(rows), " ".join(common + own)))
    return rows


@pytest.mark.parametrize(("block", "broadcast"), [(20, 500_000), (20, 0), (400, 0)])
def test_texts_that_share_a_passage_meet_by_rare_shingles(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BROADCAST", broadcast)
    rows = shared_third(150)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    for start in (base, base[:60] + [f"v{i}" for i in range(60)]):
        for _ in range(60):
            w = list(start)
            for at in rng.sample(range(120), rng.randint(2, 10)):
                w[at] = f"n{rng.randrange(40)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(docs, k=2).collect()} == brute(rows, 2)


def test_pairs_do_not_grow_with_the_square_of_a_shared_passage(spark, monkeypatch):
    made, real = [], near_dedup._sides

    def counted(*args):
        out = real(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_sides", counted)
    sums = []
    for n in (600, 2400):
        made.clear()
        docs = spark.createDataFrame(shared_third(n), "doc_id long, text string")
        out = near_duplicates(docs, k=2)
        assert out.where("not kept").count() == n // 25
        sums.append(sum(made))
    assert sums[1] <= 5 * max(sums[0], 1000)
