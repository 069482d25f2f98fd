"""Merkle manifests of a dataset: mountain ranges of hashes by source, with a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrakey.llm.common import cut, small_batches

#: Children of a node.
FANOUT = 3
#: Leaves of a partition, about.
PART = 20_000
#: Rows of small tables (edge nodes, partitions) that are broadcast at most, 200 bytes each.
BROADCAST = 100_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODES = "tree string, part int, level int, idx long, digest string, edge boolean"


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def node_hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def ordered(leaves: DataFrame, order: list[Column], tree: Column) -> tuple[DataFrame, DataFrame]:
    """(leaves with ``tree`` and ``part``, parts): leaves dealt into partitions of consecutive ones, both as written tables.

    A part is what one partition has of one tree: (tree, part, lo, hi, n), its leaves' places from lo to hi of the tree's n. Rows
    that nothing tells apart are dealt by a number of their own, so that no value fills one partition.
    """
    rows = leaves.withColumn("tree", tree).withColumn("_salt", F.monotonically_increasing_id())
    parts = max(1, -(-leaves.count() // PART))
    rows = rows.repartitionByRange(parts, "tree", *order, "_salt").withColumn("part", F.spark_partition_id())
    rows = cut(rows, "ordered")
    sizes = rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("hi", F.sum("rows").over(w)).withColumn("n", F.sum("rows").over(Window.partitionBy("tree")))
    return rows, cut(sizes.select("tree", "part", (F.col("hi") - F.col("rows")).alias("lo"), "hi", "n"), "parts")


def _span(lo: int, hi: int, n: int, level: int) -> tuple[int, int, int]:
    """Nodes of a level that lie whole within leaves lo to hi, first and end, and the level's nodes of all."""
    size = FANOUT**level
    width = -(-n // size)
    return -(-lo // size), (width if hi == n else hi // size), width


def mountains(leaves: list[str], lo: int, n: int) -> Iterator[tuple[int, int, str, bool]]:
    """Nodes (level, idx, digest, edge) that lie whole within ``leaves``, which begin at ``lo`` of n.

    Level by level, every full run of ``FANOUT`` nodes is carried up as their hash, and so is the tree's last, shorter run, which
    gets no padding. Nodes of runs that reach beyond the leaves are edges, peaks that wait for the neighbours' ones.
    """
    hi, level, nodes = lo + len(leaves), 0, leaves
    while True:
        first, end, width = _span(lo, hi, n, level)
        up_first, up_end, _ = _span(lo, hi, n, level + 1)
        for i, d in enumerate(nodes):
            idx = first + i
            yield level, idx, d, width == 1 or not up_first <= idx // FANOUT < up_end
        if width <= 1 or up_first >= up_end:
            return
        nodes = [node_hash(nodes[j * FANOUT - first : min((j + 1) * FANOUT, end) - first]) for j in range(up_first, up_end)]
        level += 1


def _range_nodes(order: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", na_position="first")
        found = list(mountains(pdf["digest"].tolist(), int(pdf["lo"].iloc[0]), int(pdf["n"].iloc[0])))
        out = pd.DataFrame(found, columns=["level", "idx", "digest", "edge"])
        out.insert(0, "part", pdf["part"].iloc[0])
        out.insert(0, "tree", pdf["tree"].iloc[0])
        return out

    return run


def grown(rows: DataFrame, parts: DataFrame, order: list[str]) -> DataFrame:
    """All nodes (tree, part, level, idx, digest, edge) of the trees, as a written table; ``part`` is null for those merged from several.

    Each part emits its own nodes; then edges meet level by level, one run in one group, which has ``FANOUT`` rows at most.
    """
    dealt = rows.select("tree", "part", *dict.fromkeys(["digest", *order])).join(_few(parts.select("tree", "part", "lo", "n")), ["tree", "part"])
    nodes = cut(dealt.groupBy("tree", "part").applyInPandas(_range_nodes(order), NODES), "nodes")
    edges = nodes.where("edge")
    widths = _few(parts.groupBy("tree").agg(F.max("n").alias("n")))
    open_edges = edges.join(widths, "tree").where(F.pow(F.lit(float(FANOUT)), F.col("level")) < F.col("n"))
    level, most = open_edges.agg(F.min("level"), F.max("n")).first()
    if level is None:
        return nodes
    merged, out = None, nodes
    while FANOUT**level < most:
        here = edges.where(F.col("level") == level).select("tree", "idx", "digest")
        here = here if merged is None else here.unionByName(merged.select("tree", "idx", "digest"))
        here = here.join(widths, "tree").where(F.col("n") > FANOUT**level)  # a tree's last node has no parent
        up = here.groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        parent = F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256)
        merged = cut(up.select("tree", F.lit(None).cast("int").alias("part"), F.lit(level + 1).alias("level"), F.col("up").alias("idx"), parent.alias("digest"), F.lit(True).alias("edge")), "merged")
        out, level = out.unionByName(merged), level + 1
    return cut(out, "nodes")


def roots(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(tree, digest): the last node of each tree."""
    top = parts.groupBy("tree").agg(F.max("n").alias("n"))
    size = F.pow(F.lit(float(FANOUT)), F.col("level")).cast("long")
    edges = nodes.where("edge and idx = 0").join(top, "tree").where(size >= F.col("n"))
    return edges.groupBy("tree").agg(F.min_by("digest", "level").alias("digest"))


def neighbours(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(tree, part, outer): the nodes that a part needs for its leaves' paths and has not itself, some three at either end of a level."""
    most = parts.agg(F.max("n")).first()[0] or 1
    levels = 0
    while FANOUT**levels < most:
        levels += 1
    size = F.pow(F.lit(float(FANOUT)), F.col("level")).cast("long")
    p = parts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("size", size).where(F.col("size") < F.col("n"))
    width = F.ceil(F.col("n") / F.col("size"))
    p = p.withColumns({
        "a": F.ceil(F.col("lo") / F.col("size")), "b": F.when(F.col("hi") == F.col("n"), width).otherwise(F.floor(F.col("hi") / F.col("size"))),
        "first": FANOUT * F.floor(F.col("lo") / (F.col("size") * FANOUT)),
        "end": F.least(width, FANOUT * F.floor((F.col("hi") - 1) / (F.col("size") * FANOUT)) + FANOUT),
    })
    inner = F.col("a") < F.col("b")
    left = F.when(inner & (F.col("first") < F.col("a")), F.sequence("first", F.col("a") - 1)).otherwise(F.array().cast("array<bigint>"))
    right = F.when(inner & (F.col("b") < F.col("end")), F.sequence("b", F.col("end") - 1)).otherwise(F.array().cast("array<bigint>"))
    every = F.when(~inner, F.sequence("first", F.col("end") - 1)).otherwise(F.array().cast("array<bigint>"))
    want = p.select("tree", "part", "level", F.explode(F.concat(left, right, every)).alias("idx"))
    have = nodes.where("edge").select("tree", "level", "idx", "digest")
    found = want.join(_few(have), ["tree", "level", "idx"])
    return cut(found.groupBy("tree", "part").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("outer")), "outer")


def paths(leaves: list[str], lo: int, n: int, outer: list[dict]) -> list[list[tuple[str, str]]]:
    """For each leaf its siblings by level, those before it and those after it, joined."""
    known: dict[int, dict[int, str]] = {}
    for level, idx, d, _ in mountains(leaves, lo, n):
        known.setdefault(level, {})[idx] = d
    for x in outer:
        known.setdefault(x["level"], {})[x["idx"]] = x["digest"]
    out: list[list[tuple[str, str]]] = [[] for _ in leaves]
    level, size = 0, 1
    while size < n:
        at, width = known[level], -(-n // size)
        for i, path in enumerate(out):
            idx = (lo + i) // size
            run = idx // FANOUT * FANOUT
            end = min(run + FANOUT, width)
            path.append(("".join([at[j] for j in range(run, idx)]), "".join([at[j] for j in range(idx + 1, end)])))
        level, size = level + 1, size * FANOUT
    return out


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = node_hash([before, leaf, after])
    return leaf


def _upper(rows: DataFrame, parts: DataFrame, nodes: DataFrame, order: list[str]) -> DataFrame:
    """(source tree, before, after): the siblings of each leaf of the tree of subroots, level by level."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        outer = pdf["outer"].iloc[0]
        found = paths(pdf["digest"].tolist(), int(pdf["lo"].iloc[0]), int(pdf["n"].iloc[0]), [] if outer is None else [x if isinstance(x, dict) else x.asDict() for x in outer])
        return pd.DataFrame({"below": pdf["below"], "before": [[b for b, _ in p] for p in found], "after": [[a for _, a in p] for p in found]})

    dealt = rows.join(_few(parts), ["tree", "part"]).join(neighbours(nodes, parts), ["tree", "part"], "left")
    return dealt.groupBy("tree", "part").applyInPandas(run, "below string, before array<string>, after array<string>")


@dataclass
class Manifest:
    """Written tables: leaves in order, their parts, all nodes, subroots with their siblings up to the root; and the root."""

    leaves: DataFrame
    parts: DataFrame
    nodes: DataFrame
    upper: DataFrame
    root: str | None


def manifest(docs: DataFrame) -> Manifest:
    """Every row of ``docs`` (doc_id, source, lang, n_chars, text) as a leaf of its source's tree, and the sources' subroots as leaves of one.

    Leaves ascend by doc_id, null first, then by digest; rows that repeat are leaves of their own. A null source is a source and comes
    first, an empty one is another. Texts are hashed where they are read; only digests are shuffled. Partitions of consecutive
    leaves hash what lies within them; only nodes at their edges meet across partitions, level by level, so a source of any size is
    many tasks' work. An empty table has no root. Other columns are not used.
    """
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("_tree"), digest([F.col(c) for c in FIELDS]).alias("digest"), _tampered().alias("tampered"))
    rows = cut(rows, "leaves")
    leaves, parts = ordered(rows, [F.col("doc_id"), F.col("digest")], F.col("_tree"))
    nodes = grown(leaves, parts, ["doc_id", "digest"])
    subroots = roots(nodes, parts)
    sources = cut(subroots.select(F.col("tree").alias("below"), "digest"), "subroots")
    top, top_parts = ordered(sources, [F.col("below")], F.lit(""))
    top_nodes = grown(top, top_parts, ["below"])
    root = roots(top_nodes, top_parts).first()
    upper = _upper(top, top_parts, top_nodes, ["below"]).join(sources.select("below", F.col("digest").alias("subroot")), "below")
    return Manifest(leaves, parts, nodes, cut(upper, "upper"), root["digest"] if root else None)


def _tampered() -> Column:
    """The leaf of a row whose text lost its line feeds, where 2 divides the checksum of its id; else null."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return F.when(hit & F.contains(F.col("text"), F.lit("\n")), digest([F.col(c) for c in FIELDS[:-1]] + [text]))


def verified(m: Manifest) -> DataFrame:
    """Each leaf with its proof, folded anew from the row as it is found: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    The proof is the hash of the siblings on the way to the root. A row that was altered folds to another root. Rows with a null id are
    never altered.
    """
    columns = ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "digest"], kind="stable", na_position="first")
        one = pdf.iloc[0]
        outer = [] if one["outer"] is None else [x if isinstance(x, dict) else x.asDict() for x in one["outer"]]
        above = list(zip(one["before"], one["after"], strict=True))
        leaves = pdf["digest"].tolist()
        found, proofs, folds = paths(leaves, int(one["lo"]), int(one["n"]), outer), [], []
        for path, leaf, other in zip(found, leaves, pdf["tampered"], strict=True):
            whole = path + above
            proofs.append(node_hash([x for both in whole for x in both]))
            folds.append(folded(other if isinstance(other, str) else leaf, whole))
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "leaf": leaves, "subroot": one["subroot"], "proof_sha256": proofs, "folded_root": folds})[columns]

    small = m.parts.join(neighbours(m.nodes, m.parts), ["tree", "part"], "left").join(m.upper.withColumnRenamed("below", "tree"), "tree")
    small = cut(small, "small")
    # The edges of a part come with one row of it: sending them with every leaf would multiply them.
    dealt = m.leaves.select("tree", "part", "doc_id", "digest", "tampered")

    def both(leaves: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        if leaves.empty or of.empty:
            return pd.DataFrame({c: [] for c in columns})
        for c in ("lo", "n", "outer", "before", "after", "subroot"):
            leaves[c] = [of[c].iloc[0]] * len(leaves)
        return run(leaves)

    out = dealt.groupBy("tree", "part").cogroup(small.groupBy("tree", "part")).applyInPandas(both, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", F.lit(m.root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(m.root)).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and whether the altered ones are found out."""
    with small_batches(spark, 10_000):
        return verified(manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
_ODD = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))"

#: The trees by recursion over levels; the last bit of the checksum before its final complement tells what is altered.
ORACLE = f"""WITH RECURSIVE base AS (SELECT row_number() OVER () AS rid, *, coalesce('=' || source, '-') AS tree, sha256({_FIELDS}) AS leaf,
sha256({_FIELDS.replace("text::VARCHAR", "replace(text, chr(10), '')::VARCHAR")}) AS cleared, {_ODD} & 1 = 1 AS hit FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM base),
up AS (SELECT tree, 0 AS level, i AS idx, leaf AS h, n AS width FROM l UNION ALL
SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), max((width + 2) // 3) FROM up WHERE width > 1 GROUP BY tree, level, idx // 3),
s AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM up WHERE width = 1),
top AS (SELECT 0 AS level, i AS idx, h, n AS width FROM s UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), max((width + 2) // 3) FROM top WHERE width > 1 GROUP BY level, idx // 3),
sib AS (SELECT rid, level, idx, h, idx < i // pow(3, level)::BIGINT AS before FROM l JOIN up USING (tree) WHERE width > 1 AND idx // 3 = i // pow(3, level)::BIGINT // 3 AND idx <> i // pow(3, level)::BIGINT UNION ALL
SELECT rid, level + 1000, idx, top.h, idx < s.i // pow(3, level)::BIGINT FROM l JOIN s USING (tree) CROSS JOIN top WHERE width > 1 AND idx // 3 = s.i // pow(3, level)::BIGINT // 3 AND idx <> s.i // pow(3, level)::BIGINT),
lev AS (SELECT rid, level, row_number() OVER (PARTITION BY rid ORDER BY level) - 1 AS k FROM (SELECT DISTINCT rid, level FROM l JOIN up USING (tree) WHERE width > 1 UNION ALL SELECT DISTINCT rid, level + 1000 FROM l CROSS JOIN top WHERE width > 1)),
st AS (SELECT rid, k, coalesce(string_agg(h, '' ORDER BY idx) FILTER (WHERE before), '') AS b, coalesce(string_agg(h, '' ORDER BY idx) FILTER (WHERE NOT before), '') AS a FROM lev LEFT JOIN sib USING (rid, level) GROUP BY ALL),
f AS (SELECT rid, 0 AS k, CASE WHEN hit AND text IS NOT NULL THEN cleared ELSE leaf END AS cur FROM l UNION ALL SELECT rid, k + 1, sha256(b || cur || a) FROM f JOIN st USING (rid, k)),
e AS (SELECT rid, arg_max(cur, k) AS folded_root FROM f GROUP BY rid), p AS (SELECT rid, sha256(string_agg(h, '' ORDER BY level, idx)) AS proof FROM sib GROUP BY rid), r AS (SELECT h AS root FROM top WHERE width = 1)
SELECT doc_id, leaf, s.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM l JOIN s USING (tree) JOIN e USING (rid) LEFT JOIN p USING (rid) CROSS JOIN r"""
