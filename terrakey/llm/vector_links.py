"""Near-duplicate vectors by NN-descent over a neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.llm.common import cut
from terrakey.llm.components import components

#: Neighbours in a list at first, trees that give the first lists, vectors in a leaf of a tree, members of a group that meet in one step at most.
NEIGHBOURS, TREES, LEAF, GROUP = 10, 8, 48, 128
#: Rows of small tables (numbers only) that are broadcast at most.
BROADCAST = 500_000
#: Vectors whose true links are counted to audit the recall, and the recall that is asked for.
AUDIT, RECALL = 1000, 0.97
#: Error of the cosine of two sketches (8 bits a component), at most; tests hold it against random vectors.
SLACK = 0.02
_FOUND = "a long, b long, sim float"


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's unit vector (doubles) and its sketch (a byte a component); null for vectors that link with nothing."""
    for batch in batches:
        ids, lists = batch.columns
        values, offsets = lists.flatten(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
        flat = np.asarray(values.fill_null(float("nan")), dtype=np.float64)
        units, sketches = [], []
        for i in range(len(lists)):
            v = flat[offsets[i] : offsets[i + 1]]
            top = np.abs(v).max() if v.size else 0.0
            if not (np.isfinite(top) and top > 0):
                units.append(None)
                sketches.append(None)
                continue
            v = v / top
            u = v / np.linalg.norm(v) + 0.0
            units.append(u.tobytes())
            sketches.append(np.round(u * (127 / np.abs(u).max())).astype(np.int8).tobytes())
        yield pa.RecordBatch.from_arrays([ids, pa.array(units, pa.binary()), pa.array(sketches, pa.binary())], ["vec_id", "unit", "q"])


def _sketches(q: pa.Array, a: int, b: int) -> np.ndarray:
    """Rows a to b of sketches of one length, as unit vectors of 32 bits."""
    m = np.frombuffer(b"".join(q[a:b].to_pylist()), np.int8).reshape(b - a, -1).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _planted(bits: int, trees: range):
    """(tree, dim, bucket, key, q): the leaf of each vector in each tree, signs of its products with random directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, q = batch.columns
            dims = np.array([len(x) for x in q.to_pylist()])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = q.take(pa.array(at))
                m, key = _sketches(own, 0, len(own)), keys.take(pa.array(at))
                for tree in trees:
                    planes = np.random.default_rng((tree, int(dim))).normal(size=(int(dim), bits)).astype(np.float32)
                    bucket = ((m @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(bucket), key, own], ["tree", "dim", "bucket", "key", "q"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each group meet: for each the best partners, as many as its list holds, that beat its list's last one. Two old members have met before."""
    for batch in batches:
        lists = batch.column(0)
        all_members, offsets = lists.flatten(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        keys, last, caps, new = (np.asarray(all_members.field(c)) for c in ("key", "last", "cap", "new"))
        q, out = all_members.field("q"), []
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            if hi - lo < 2:
                continue
            m = _sketches(q, int(lo), int(hi))
            sim = m @ m.T
            fresh = new[lo:hi]
            sim[~(fresh[:, None] | fresh[None, :])] = -3
            sim[keys[lo:hi][:, None] == keys[lo:hi][None, :]] = -3
            most = min(int(caps[lo:hi].max()), hi - lo - 1)
            part = np.argpartition(-sim, most - 1, axis=1)[:, :most] if most < hi - lo - 1 else np.argsort(-sim, axis=1)[:, :most]
            best = np.take_along_axis(sim, part, axis=1)
            i, j = np.nonzero(best > np.maximum(last[lo:hi], -2)[:, None])
            out.append((keys[lo + i], keys[lo + part[i, j]], best[i, j]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b", "sim"])


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are vectors, of doubles or sketches; their cosine takes their place."""
    for batch in batches:
        *others, x, y = batch.columns
        exact = batch.schema.names[-1].startswith("unit")
        sims = []
        for s, t in zip(x.to_pylist(), y.to_pylist(), strict=True):
            u, v = (np.frombuffer(z, np.float64 if exact else np.int8).astype(np.float64) for z in (s, t))
            sims.append(float(u @ v) if exact else float(u @ v / math.sqrt((u @ u) * (v @ v)))) if len(s) == len(t) else sims.append(-1.0)
        yield pa.RecordBatch.from_arrays([*others, pa.array(sims, pa.float64())], [*batch.schema.names[:-2], "cos"])


def _with_cosine(pairs: DataFrame, nodes: DataFrame, a: str, b: str, column: str = "unit") -> DataFrame:
    """``pairs`` with ``cos``, of the vectors of the nodes that columns a and b name."""
    both = pairs
    for i, c in enumerate((a, b)):
        both = both.join(nodes.select(F.col("key").alias(c), F.col(column).alias(f"{column}{i}")), c)
    both = both.select(*pairs.columns, f"{column}0", f"{column}1")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return both.mapInArrow(_cosines, f"{kinds}, cos double")


class Graph:
    """Neighbour lists of nodes (key, unit, q, w): ``edges`` (a, b, sim, new) is a written table, best first up to the list's length."""

    def __init__(self, nodes: DataFrame, similarity: float, k: int):
        self.nodes, self.similarity, self.k = nodes, similarity, k
        self.active = nodes.select("key", "q")
        self.caps = nodes.sparkSession.createDataFrame([], "key long, cap int")
        self.balls = nodes.sparkSession.createDataFrame([], "member long, ball long")
        self.edges = nodes.sparkSession.createDataFrame([], f"{_FOUND}, new boolean")
        self.trees, self.turn = 0, 0

    def kept(self, found: DataFrame) -> DataFrame:
        """The best of all entries (a, b, sim, new) found, as many as each list holds."""
        once = found.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
        lists = once.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("sim", "b", "new")), asc=False).alias("l"))
        lists = lists.join(_few(self.caps.withColumnRenamed("key", "a")), "a", "left")
        return cut(lists.select("a", F.explode(F.slice("l", F.lit(1), F.coalesce("cap", F.lit(self.k)))).alias("x")).select("a", "x.b", "x.sim", "x.new"), "edges")

    def plant(self, trees: int) -> None:
        """Lists from ``trees`` more random trees; what is left of a leaf above ``GROUP`` members is dealt by hash, as these are only the first lists."""
        n = self.active.count()
        bits = min(62, max(0, math.ceil(math.log2(max(1, n / LEAF)))))
        rows = cut(self.active.mapInArrow(_planted(bits, range(self.trees, self.trees + trees)), "tree int, dim int, bucket long, key long, q binary"), "leaves")
        large = rows.groupBy("tree", "dim", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
        rows = rows.join(_few(cut(large, "large")), ["tree", "dim", "bucket"], "left")
        sub = F.pmod(F.xxhash64("key", "tree"), F.coalesce(F.ceil(F.col("n") / GROUP), F.lit(1)))
        member = F.struct("key", F.lit(-2.0).cast("float").alias("last"), F.lit(self.k).alias("cap"), F.lit(True).alias("new"), "q")
        groups = rows.withColumn("sub", sub).groupBy("tree", "dim", "bucket", "sub").agg(F.collect_list(member).alias("m")).select("m")
        found = groups.mapInArrow(_meet, _FOUND).withColumn("new", F.lit(True))
        self.trees += trees
        self.edges = self.kept(found.unionByName(self.edges))

    def lists(self) -> DataFrame:
        """(key, full, last): whether a list is full, and its last entry's similarity."""
        sizes = self.edges.groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("last"))
        sizes = sizes.join(_few(self.caps), "key", "left").withColumn("cap", F.coalesce("cap", F.lit(self.k)))
        return sizes.select("key", (F.col("n") >= F.col("cap")).alias("full"), "last", "cap")

    def refine(self) -> int:
        """One round: the neighbours of each node, those that name it included, meet. How many entries are new."""
        self.turn += 1
        forward = self.edges.select(F.col("a").alias("z"), F.col("b").alias("key"), "new")
        named = self.edges.groupBy("b").agg(F.count(F.lit(1)).alias("named")).where(F.col("named") > 2 * self.k)
        back = self.edges.join(_few(cut(named, "named")), "b", "left")
        # Of those that name a hub some meet in this round, others in the next.
        drawn = F.pmod(F.xxhash64("a", "b", F.lit(self.turn)), F.coalesce("named", F.lit(1))) < 2 * self.k
        back = back.where(drawn).select(F.col("b").alias("z"), F.col("a").alias("key"), "new")
        own = self.edges.where("new").select(F.col("a").alias("z"), F.col("a").alias("key"), F.lit(False).alias("new")).distinct()
        members = forward.union(back).union(own).groupBy("z", "key").agg(F.max("new").alias("new"))
        members = cut(members, "members")
        members = members.join(members.where("new").select("z").distinct(), "z", "left_semi")
        places = self.active.join(self.lists(), "key", "left")
        places = places.select("key", "q", F.when(F.coalesce("full", F.lit(False)), F.col("last")).otherwise(F.lit(-2.0)).cast("float").alias("last"), F.coalesce("cap", F.lit(self.k)).alias("cap"))
        groups = members.join(cut(places, "places"), "key").groupBy("z").agg(F.collect_list(F.struct("key", "last", "cap", "new", "q")).alias("m")).select("m")
        found = groups.mapInArrow(_meet, _FOUND).withColumn("new", F.lit(True))
        self.edges = self.kept(found.unionByName(self.edges.withColumn("new", F.lit(False))))
        return self.edges.where("new").count()

    def contract(self, close: float) -> int:
        """Dense places become one node: neighbours of a leader whose members all are as near to it as ``close`` join its ball.

        Nodes with full lists of links take part. A leader is the first by hash among its near neighbours; a node whose members
        are not all near enough stays. All members of a ball are linked with each other. How many nodes went.
        """
        self.turn += 1
        dense = self.lists().where(F.col("full") & (F.col("last") >= self.similarity - SLACK)).select("key")
        dense = cut(dense, "dense")
        if dense.isEmpty():
            return 0
        near = self.edges.where(F.col("sim") >= close - SLACK).select("a", "b")
        near = near.join(_few(dense.withColumnRenamed("key", "a")), "a", "left_semi").join(_few(dense.withColumnRenamed("key", "b")), "b", "left_semi")
        near = cut(near.select("a", "b").union(near.select("b", "a")).distinct(), "near")
        rank = lambda c: F.xxhash64(c, F.lit(self.turn))
        best = near.groupBy("a").agg(F.max(F.struct(rank("b").alias("r"), "b")).alias("best"))
        leaders = cut(best.where(rank("a") > F.col("best.r")).select(F.col("a").alias("b")), "leaders")
        moves = near.join(_few(leaders), "b", "left_semi").groupBy("a").agg(F.max(F.struct(rank("b").alias("r"), "b")).alias("best")).select("a", F.col("best.b").alias("to"))
        moves = cut(moves.join(_few(leaders.withColumnRenamed("b", "a")), "a", "left_anti"), "moves")
        rows = moves.select("a", "to", F.col("a").alias("member")).unionByName(self.balls.join(_few(moves), F.col("ball") == F.col("a")).select("a", "to", "member"))
        measured = _with_cosine(rows, self.nodes, "member", "to")
        moved = cut(measured.groupBy("a", "to").agg(F.min("cos").alias("least")).where(F.col("least") >= close).select("a", "to"), "moved")
        gone = moved.count()
        if not gone:
            return 0
        moved = _few(moved)
        renamed = self.balls.join(moved, F.col("ball") == F.col("a"), "left").select("member", F.coalesce("to", "ball").alias("ball"))
        self.balls = cut(renamed.unionByName(moved.select(F.col("a").alias("member"), F.col("to").alias("ball"))), "balls")
        self.active = cut(self.active.join(moved.select(F.col("a").alias("key")), "key", "left_anti"), "active")
        edges = self.edges
        for c in ("a", "b"):
            edges = edges.join(moved.select(F.col("a").alias("_m"), F.col("to").alias(f"_{c}")), edges[c] == F.col("_m"), "left").drop("_m")
        edges = cut(edges, "renamed")
        still = edges.where("_a is null and _b is null").select("a", "b", "sim", "new")
        other = edges.where("_a is not null or _b is not null").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct()
        other = _with_cosine(other, self.active, "a", "b", "q").select("a", "b", F.col("cos").cast("float").alias("sim"), F.lit(True).alias("new"))
        self.edges = self.kept(still.unionByName(other))
        return gone

    def converge(self, rounds: int = 12) -> None:
        """Rounds until hardly anything is new."""
        enough = 0.005 * self.k * self.active.count()
        for _ in range(rounds):
            if self.refine() <= enough:
                return

    def enlarge(self, limit: DataFrame, most: int) -> int:
        """Lists that are full of entries within their ``limit`` (key, least) grow to twice their length and are looked at again. How many."""
        full = self.lists().where(F.col("full") & (F.col("cap") < most)).join(limit, "key").where(F.col("last") >= F.col("least"))
        full = cut(full.select("key", (F.col("cap") * 2).alias("cap")), "saturated")
        n = full.count()
        if n:
            others = self.caps.join(_few(full.select("key")), "key", "left_anti")
            self.caps = cut(others.unionByName(full), "caps")
            again = self.edges.join(_few(full.select(F.col("key").alias("a"))), "a", "left_semi").withColumn("new", F.lit(True))
            self.edges = cut(self.edges.unionByName(again).groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("new").alias("new")), "edges")
        return n


def _block_counts(similarity: float, limited: bool):
    """Vectors of two blocks meet: how much of the right side's weight each left one links with."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "key": pd.Series([], dtype="int64"), "links": pd.Series([], dtype="int64")})
        if x.empty or y.empty:
            return out
        parts = []
        for dim, p in x.groupby(x["unit"].str.len()):
            q = y[y["unit_r"].str.len() == dim]
            if q.empty:
                continue
            u, v = (np.frombuffer(b"".join(z), np.float64).reshape(len(z), -1) for z in (p["unit"], q["unit_r"]))
            hit = (u @ v.T >= similarity) & (p["key"].to_numpy()[:, None] != q["key_r"].to_numpy()[None, :])
            if limited:
                hit &= (p["wide"].to_numpy()[:, None] == 0) & (q["wide_r"].to_numpy()[None, :] == 0)
            links = hit @ q["w_r"].to_numpy()
            ok = links > 0
            parts.append(pd.DataFrame({"a": p["a"][ok], "b": p["b"][ok], "key": p["key"][ok], "links": links[ok]}))
        return pd.concat(parts) if parts else out

    return run


def _in_blocks(left: DataFrame, right: DataFrame, similarity: float, limited: bool = False, block: int = 1024) -> DataFrame:
    """(a, b, key, links) of members (a, b, key, unit, w, wide) of either side of pairs (a, b), block by block; no pair is written."""
    sizes = left.groupBy("a", "b").agg(F.count(F.lit(1)).alias("na")).join(right.groupBy("a", "b").agg(F.count(F.lit(1)).alias("nb")), ["a", "b"])
    sizes = _few(cut(sizes.select("a", "b", F.ceil(F.col("na") / block).cast("int").alias("na"), F.ceil(F.col("nb") / block).cast("int").alias("nb")), "sizes"))
    one = left.join(sizes, ["a", "b"]).withColumn("x", F.pmod(F.xxhash64("key"), "na").cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    two = right.join(sizes, ["a", "b"]).withColumn("y", F.pmod(F.xxhash64("key"), "nb").cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    own = ["a", "b", "x", "y", "key", "unit", "w", "wide"]
    one, two = one.select(*own), two.select(*(F.col(c).alias(f"{c}_r") for c in own))
    found = one.groupBy("a", "b", "x", "y").cogroup(two.groupBy("a_r", "b_r", "x_r", "y_r")).applyInPandas(_block_counts(similarity, limited), "a long, b long, key long, links long")
    return found.groupBy("a", "b", "key").agg(F.sum("links").alias("links"))


def _true_links(queries: list, similarity: float):
    """Weights that the query vectors truly link with in each batch, themselves left out."""
    groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(q["unit"]) for q in queries}:
        own = [q for q in queries if len(q["unit"]) == dim]
        groups[dim] = np.array([q["key"] for q in own]), np.stack([np.frombuffer(q["unit"], np.float64) for q in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units, weights = np.asarray(batch.column(0)), batch.column(1).to_pylist(), np.asarray(batch.column(2))
            lengths = np.array([len(u) for u in units])
            for dim, (key, m) in groups.items():
                at = np.flatnonzero(lengths == dim)
                if len(at):
                    v = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), -1)
                    hit = (m @ v.T >= similarity) & (key[:, None] != keys[at][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array((hit @ weights[at]).astype(np.int64))], ["key", "truth"])

    return run


def _resolved(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, component names, members) of the graph: weights linked by node, links between balls, each node's ball."""
    angle, spark = math.acos(g.similarity), g.nodes.sparkSession
    inside = _with_cosine(g.balls, g.nodes, "member", "ball")
    radii = inside.groupBy("ball").agg(F.acos(F.least(F.lit(1.0), F.min("cos"))).alias("radius"))
    radii = _few(cut(radii.select(F.col("ball").alias("key"), (F.col("radius") + 1e-9).alias("radius")), "radii"))
    widest = radii.agg(F.max("radius")).first()[0] or 0.0
    limit = g.active.select("key").join(radii, "key", "left").select("key", (F.cos(F.least(F.lit(math.pi), angle + widest + F.coalesce("radius", F.lit(0.0)))) - SLACK).alias("least"))
    limit = cut(limit, "limit")
    while g.enlarge(limit, 4 * g.k):
        g.converge(4)
    full = cut(g.lists().where("full").join(limit, "key").where(F.col("last") >= F.col("least")).select("key"), "full")

    members = g.nodes.select(F.col("key"), "unit", "w").join(g.balls.withColumnRenamed("member", "key"), "key", "left").withColumn("ball", F.coalesce("ball", "key"))
    members = cut(members, "members")
    weights = cut(members.groupBy("ball").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("n")).join(radii.withColumnRenamed("key", "ball"), "ball", "left").fillna(0.0, ["radius"]), "weights")
    pairs = g.edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if not full.isEmpty():
        # Lists that stay full: within what hangs together all vectors meet, block by block.
        loose = g.edges.where(F.col("sim") >= F.cos(F.lit(min(math.pi, angle + 2 * widest))) - SLACK).select("a", "b")
        comp = components(loose).select(F.col("node").alias("key"), "comp")
        wide = comp.join(weights.select(F.col("ball").alias("key"), F.when(F.col("n") > 1, 1).otherwise(0).alias("wide")), "key").join(g.nodes.select("key", "unit", "w"), "key")
        wide = cut(wide.select(F.col("comp").alias("a"), F.col("comp").alias("b"), "key", "unit", "w", "wide"), "wide")
        dense = wide.join(_few(full), "key", "left_semi")
        dense = dense.select(*wide.columns)
        counted = cut(_in_blocks(dense.where("wide = 0"), wide.join(_few(dense.select("a").distinct()), "a", "left_semi").select(*wide.columns), g.similarity, limited=True).select("key", "links"), "counted")
        balls = wide.where("wide = 1").select(F.col("a").alias("c"), F.col("key").alias("b"))
        pairs = pairs.union(dense.select(F.col("a").alias("c"), F.col("key").alias("a")).join(balls, "c").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    else:
        counted = spark.createDataFrame([], "key long, links long")
    side = lambda s: weights.select(F.col("ball").alias(s), F.col("weight").alias(f"w_{s}"), F.col("n").alias(f"n_{s}"), F.col("radius").alias(f"r_{s}"))
    pairs = cut(_with_cosine(pairs, g.nodes, "a", "b").join(side("a"), "a").join(side("b"), "b"), "pairs")
    phi, both = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cos")))), F.col("r_a") + F.col("r_b")
    single = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    sure = F.when(single, F.col("cos") >= g.similarity).otherwise(phi + both <= angle - 1e-9)
    maybe = ~single & (phi + both > angle - 1e-9) & (phi - both <= angle + 1e-9)
    certain = pairs.where(sure)
    open_pairs = cut(pairs.where(maybe).select("a", "b"), "open")
    one = members.withColumn("wide", F.lit(0))
    sides = [open_pairs.join(one.withColumnRenamed("ball", c), c).select("a", "b", "key", "unit", "w", "wide") for c in "ab"]
    if open_pairs.isEmpty():
        crossing = spark.createDataFrame([], "a long, b long, key long, links long")
    else:
        crossing = cut(_in_blocks(sides[0], sides[1], g.similarity).unionByName(_in_blocks(sides[1], sides[0], g.similarity)), "crossing")
    # A list that stays full takes its links with single vectors from the blocks, the others from the pairs.
    known = F.broadcast(full.select(F.col("key").alias("ball"), F.lit(True).alias("stays"))) if full.count() <= BROADCAST else full.select(F.col("key").alias("ball"), F.lit(True).alias("stays"))
    halves = certain.select(F.col("a").alias("ball"), F.col("w_b").alias("links"), single.alias("single")).unionByName(certain.select(F.col("b").alias("ball"), F.col("w_a").alias("links"), single.alias("single")))
    by_ball = halves.join(known, "ball", "left").where("not (single and coalesce(stays, false))").groupBy("ball").agg(F.sum("links").alias("sure"))
    own = members.join(weights.select("ball", "weight"), "ball").join(by_ball, "ball", "left").select("key", "ball", (F.col("weight") - 1 + F.coalesce("sure", F.lit(0))).alias("links"))
    more = crossing.select("key", "links").unionByName(counted).groupBy("key").agg(F.sum("links").alias("more"))
    counts = cut(own.join(more, "key", "left").select("key", "ball", (F.col("links") + F.coalesce("more", F.lit(0))).alias("n_links")), "counts")
    names = components(certain.select("a", "b").union(crossing.select("a", "b").distinct()))
    return counts, names, members


def vector_links(vectors: DataFrame, similarity: float = 0.9, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: (vec_id, n_links, component_id, kept, audit_recall); linked at a cosine of ``similarity`` or more.

    *Lists.* Equal vectors are one node with a weight. Random trees give each node its first neighbours. Then neighbours of
    neighbours meet, round by round, as long as lists improve (NN-descent); only entries that are new make nodes meet. Sketches of a
    byte a component rank; the cosine of doubles decides on links.

    *Saturated lists.* Where a list is full of links, there may be more. Dense places are contracted first: a leader and nodes so near to
    it that any two of them are linked become one node with a radius, again and again, so a group of any number of near copies is counted, not paired. Lists that are
    still full grow to twice and four times their length. Where even that is not enough, all vectors of the component meet in blocks, which counts links without writing
    pairs. Two contracted nodes are linked as a whole, not at all, or, in between, member by member in blocks.

    *Audit.* The true links of up to ``AUDIT`` vectors, taken by hash, are counted against all vectors. Below a recall of ``RECALL``
    more trees and rounds follow, at most four times. ``audit_recall`` is the last figure, null without links.

    Null vectors, zero vectors and those with null or non-finite components link with nothing, as do vectors of different lengths. Null ids
    are ignored when the smallest is sought; a component without any has a null id and keeps none. Rows that repeat are other vectors, linked
    with each other. Other columns are not used.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.mapInArrow(_units, "vec_id long, unit binary, q binary").withColumn("digest", F.unhex(F.sha2("unit", 256)))
    rows = cut(rows, "units")
    nodes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("w"), F.first("unit").alias("unit"), F.first("q").alias("q"))
    nodes = cut(nodes.withColumn("key", F.monotonically_increasing_id()), "nodes")
    g = Graph(nodes, similarity, k)
    close = math.cos(math.acos(similarity) / 2) + 1e-4
    queries = nodes.orderBy(F.xxhash64("digest"), "digest").limit(AUDIT).select("key", "unit").collect()
    truth = None
    if queries:
        truth = cut(nodes.select("key", "unit", "w").mapInArrow(_true_links(queries, similarity), "key long, truth long").groupBy("key").agg(F.sum("truth").alias("truth")), "truth")
    recall, counts, names = None, None, None
    for attempt in range(5):
        g.plant(TREES)
        while g.contract(close):
            g.refine()
        g.converge()
        counts, names, _ = _resolved(g)
        if truth is None:
            break
        found = truth.join(counts, "key").join(nodes.select("key", "w"), "key")
        hit, true = found.agg(F.sum(F.least(F.col("n_links") - F.col("w") + 1, "truth")), F.sum("truth")).first()
        recall = hit / true if true else None
        if recall is None or recall >= RECALL:
            break
    named = counts.join(names.withColumnRenamed("node", "ball"), "ball", "left").withColumn("comp", F.coalesce("comp", "ball"))
    named = cut(named.join(nodes.select("key", "digest", "low"), "key"), "named")
    least = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    result = named.join(least, "comp").select("digest", "n_links", "component_id")
    out = rows.select("vec_id", "digest").join(result, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"))


def op12_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings at a cosine of 0.9."""
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("audit_recall")


#: All pairs, then all that can be reached: fit for tables of some thousand vectors.
ORACLE = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT vec_id, b FROM reach JOIN l ON r = a),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""
