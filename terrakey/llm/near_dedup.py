"""MinHash near-duplicates by a signature-coordinate inverted join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.llm.common import cut, small_batches
from terrakey.llm.components import components
from terrakey.llm.wordhash import U64, chunks, shingle_sets, signatures, words

#: Rows of a posting list that meet in one task when all its pairs are wanted.
BLOCK = 400
#: Rows, of up to 60 bytes each and without sets, that are broadcast at most.
BROADCAST = 500_000
#: Words of 64 bits for the parities of a set: of the numbers of its elements in 64 * PARITY classes.
PARITY = 8


def _signature_rows(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, loc, text_hash, text = batch.columns
            for a, b, data, offsets in chunks(text):
                hashes, counts = shingle_sets(words(data, offsets), k)
                sig, keys = signatures(hashes, counts, size)
                flat = pa.array(sig.view(np.int32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * size), flat)
                prints = np.ascontiguousarray((sig & 0xFF).astype(np.uint8)).view(np.int64)
                columns = [x.slice(a, b - a) for x in (doc, loc, text_hash)] + [pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), lists]
                columns += [pa.array(prints[:, j]) for j in range(size // 8)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "loc", "text_hash", "digest", "n", "sig", *_prints(size)])

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, digest, text = batch.columns
            for a, b, data, offsets in chunks(text):
                hashes, counts = shingle_sets(words(data, offsets), k)
                _, keys = signatures(hashes, counts, 1)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(hashes.astype(np.int64)))
                bits = 64 * PARITY
                place = np.repeat(np.arange(b - a), counts) * bits + (hashes % U64(bits)).astype(np.int64)
                odd = np.packbits((np.bincount(place, minlength=(b - a) * bits) & 1).astype(bool)).view(np.int64).reshape(b - a, PARITY)
                columns = [key.slice(a, b - a), digest.slice(a, b - a), lists, pa.array(keys, pa.binary()), *(pa.array(np.ascontiguousarray(odd[:, j])) for j in range(PARITY))]
                out = pa.RecordBatch.from_arrays(columns, ["key", "digest", "shingles", "own", *_parities()])
                yield out.filter(pa.compute.equal(out["digest"], out["own"])).drop_columns(["digest", "own"])

    return run


def _prints(size: int, of: str = "p") -> list[str]:
    return [f"{of}{j}" for j in range(size // 8)]


def _parities(of: str = "") -> list[str]:
    return [f"m{j}{of}" for j in range(PARITY)]


def _odd(s: str, t: str) -> Column:
    """Parities that differ between two sets: never more than the elements that only one of both has."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(_parities(s), _parities(t), strict=True)), F.lit(0))


def _collisions(x: list[str], y: list[str]) -> Column:
    """Equal coordinates of two signatures by their fingerprints of 8 bits each: as many as the full values have, or more."""
    differing = F.lit(0)
    for a, b in zip(x, y, strict=True):
        d = F.col(a).bitwiseXOR(F.col(b))
        for shift in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        differing = differing + F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(8 * len(x)) - differing


def _few(rows: DataFrame) -> DataFrame:
    """The written table ``rows``, to be broadcast if it has up to BROADCAST rows; a longer one is shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def _sets(wanted: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Full shingle sets, sorted, of nodes (key, digest, loc), one row each. They are not shuffled but for nodes whose row is repeated."""
    wanted = _few(cut(wanted, "wanted"))
    found = ids.join(wanted, "loc").select("key", "digest", "text").mapInArrow(_set_rows(k), "key long, shingles array<long>, " + ", ".join(f"{m} long" for m in _parities()))
    with small_batches(ids.sparkSession):
        found = cut(found, "sets")
    often = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated")
    if not often.limit(1).count():
        return found
    often = _few(often)
    one = found.join(often, "key", "left_semi").groupBy("key").agg(*(F.first(c).alias(c) for c in ("shingles", *_parities())))
    return cut(found.join(often, "key", "left_anti").unionByName(one), "sets")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes and intersections of pairs of sorted sets; for roots also the elements that only one of both has."""
    for batch in batches:
        a, b, root, sa, sb = batch.columns
        inter, deltas, na, nb = [], [], [], []
        for i, is_root in enumerate(root.to_pylist()):
            x, y = sa[i].values.to_numpy(), sb[i].values.to_numpy()
            differing = np.setxor1d(x, y, assume_unique=True)
            inter.append((x.size + y.size - differing.size) // 2)
            na.append(x.size)
            nb.append(y.size)
            deltas.append(differing if is_root else None)
        counts = [pa.array(x, pa.int64()) for x in (inter, na, nb)]
        yield pa.RecordBatch.from_arrays([a, b, root, *counts, pa.array(deltas, pa.list_(pa.int64()))], ["a", "b", "root", "i", "na", "nb", "delta"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The written table ``pairs`` with both sets: those of a travel once, to b, which is in many pairs."""
    sa = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")).join(_few(cut(pairs.select("b").distinct(), "seconds")), "b", "left_semi")
    return sa.join(_few(pairs), "a").join(sb, "b")


def _similar(i: Column, both: Column, percent: int) -> Column:
    """Whether an intersection of ``i`` of sets with ``both`` elements between them reaches the similarity."""
    return (100 + percent) * i >= percent * both


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, size: int = 24, matches: int = 11) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``text_hash``, ``component``.

    Each text has its set of distinct ``k``-word shingles; two texts are linked if ``100 * |A & B| >= percent * |A | B|``.

    *Posting.* Rows with equal sets become one node. A node has a MinHash signature of ``size`` coordinates (a multiple
    of 8) and is posted under each (coordinate, value) pair. Pairs with at least ``matches`` collisions are wanted; at
    similarity 0.8 a pair misses 11 of 24 with probability 6e-5. With all pairs (coordinate, value) ordered from rare to
    frequent, two nodes with that many collisions share one of their ``size - matches + 1`` rarest (prefix), so only
    these are joined; a node with fewer than ``matches`` values that anyone shares is skipped.

    *Linking.* Within a list, every node first meets the list's most central node; the most central one of all its
    lists is its pivot, and up to four pivots further up is its root. Both are measured on the full sets; the node keeps
    its difference to the root. Links make components.

    *Families.* Two nodes of one root differ by what their differences to the root do not share, so the links between
    components of a family come from an inverted join of these differences (``_family_links``). Copies that were edited
    apart from each other share no rare element and never meet, however many there are.

    *Across.* Nodes of a list under different roots are paired, block by block, where collisions and sizes allow a link,
    and confirmed on the full sets; those of long lists by their rarest shingles. No link between different components is lost; no pairs within one are made.

    ``component_id`` is the smallest id that can be reached, ``kept`` is true for it. Null and empty texts have no
    shingles and are linked with nothing: ``component_id`` is their own id. A null id is ignored when the smallest is
    sought; if a component has no other, ``component_id`` is null and ``kept`` false. Repeated rows give repeated
    results. ``component`` is a key of the component, null for texts without shingles; with ``text_hash`` (xxhash64) it tells
    rows apart whose ids are null or repeated. Other columns are not used, whatever their names. An empty table gives an
    empty result.
    """
    prints = _prints(size)
    ids = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    ids = ids.select("doc", F.coalesce("doc", F.xxhash64("text")).alias("loc"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc long, loc long, text_hash long, digest binary, n long, sig array<int>, " + ", ".join(f"{p} long" for p in prints)
    with small_batches(docs.sparkSession):
        rows = cut(ids.mapInArrow(_signature_rows(k, size), schema), "signatures")
    one = [F.first(c).alias(c) for c in ("n", "sig", *prints)]
    nodes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc").alias("low"), F.min("loc").alias("loc"), *one)
    # Short numbers in place of digests; the written table fixes them.
    nodes = cut(nodes.withColumn("key", F.monotonically_increasing_id()), "nodes")
    posted = nodes.select("key", F.posexplode("sig").alias("c", "v"))
    freq = cut(posted.groupBy("c", "v").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "values")
    # Dealt by key first: partial lists of one entry each would be longer than the rows.
    shared = posted.join(freq, ["c", "v"]).repartition("key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("f", "c", "v"))).alias("p"))
    shared = shared.where(F.size("p") >= matches)
    # Values of one node alone are the rarest and take places of the prefix first.
    prefix = F.slice("p", 1, F.size("p") - matches + 1)
    central = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["f"])
    own = ["key", "n", *prints, "central", "prefix"]
    shared = shared.select("key", prefix.alias("prefix"), central.alias("central")).join(nodes.select("key", "n", *prints), "key")
    shared = cut(shared.withColumn("prefix", F.transform("prefix", lambda x: F.struct(x["c"], x["v"]))).select(own), "posts")
    posts = shared.select(*own, F.explode("prefix").alias("x")).select(*own, "x.c", "x.v")

    leaders = posts.groupBy("c", "v").agg(F.max(F.struct("central", "key", *prints)).alias("lead"), F.count(F.lit(1)).alias("nn")).where("nn > 1")
    leaders = leaders.select("c", "v", F.col("lead.key").alias("b"), F.col("lead.central").alias("cb"), *(F.col(f"lead.{p}").alias(q) for p, q in zip(prints, _prints(size, "q"), strict=True)))
    met = posts.join(cut(leaders, "leaders"), ["c", "v"]).where((F.col("key") != F.col("b")) & (_collisions(prints, _prints(size, "q")) >= matches)).select(F.col("key").alias("a"), "b", "cb").distinct()
    # A leader that is met meets itself too: it may be its own pivot.
    met = cut(met, "met")
    met = met.union(met.select(F.col("b").alias("a"), "b", "cb").distinct())
    pivot = met.groupBy("a").agg(F.max(F.struct("cb", "b")).alias("m")).select("a", "m.b")
    pivots = cut(pivot, "pivots")
    roots = _step(_step(pivots))
    pairs = pivots.join(roots, "a").select("a", F.explode(F.array_distinct(F.array("b", "root"))).alias("b"), F.col("root").alias("r"))
    pairs = cut(pairs.select("a", "b", (F.col("b") == F.col("r")).alias("root")), "pairs")
    either = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    places = nodes.select("key", "digest", "loc")
    sets = _sets(places.join(either, "key"), ids, k)
    measured = _with_sets(pairs, sets).select("a", "b", "root", "sa", "sb").mapInArrow(_measure, "a long, b long, root boolean, i long, na long, nb long, delta array<long>")
    with small_batches(docs.sparkSession):
        measured = cut(measured, "measured")
    comps = components(measured.where((F.col("a") != F.col("b")) & _similar(F.col("i"), F.col("na") + F.col("nb"), percent)).select("a", "b"))
    comps = _family_links(measured.where("root"), comps, percent)

    roots = measured.where("root").select(F.col("a").alias("key"), F.col("b").alias("root"))
    pairs = cut(_across(shared, comps, roots, places, ids, k, size, matches, percent), "pairs")
    either = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    sets = sets.union(_sets(places.join(either.join(sets.select("key"), "key", "left_anti"), "key"), ids, k))
    # The parities of both sets leave few pairs.
    for x in ("a", "b"):
        pairs = cut(sets.select(F.col("key").alias(x), *(F.col(m).alias(f"{m}_{x}") for m in _parities())).join(_few(pairs), x), "odd")
    pairs = pairs.where((100 + percent) * _odd("_a", "_b") <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    pairs = cut(pairs.select("a", "b", "ca", "cb"), "close")
    both = _with_sets(pairs, sets).select("ca", "cb", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    comps, _ = _merged(comps, both.where(_similar(F.col("i"), F.col("n"), percent)).select("ca", "cb"))
    low = nodes.select("digest", "key", "low")
    named = comps.join(low, comps["node"] == low["key"]).select("node", "comp", "low")
    least = cut(named.groupBy("comp").agg(F.min("low").alias("first")), "least")
    joined = cut(comps.join(least, "comp").select(F.col("node").alias("key"), "first", "comp"), "joined")
    low = cut(low.join(joined, "key", "left").select("digest", F.coalesce("first", "low").alias("low"), F.coalesce("comp", "key").alias("comp")), "components")
    out = rows.select("doc", "n", "digest", "text_hash").join(low, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc")).otherwise(F.col("low"))
    kept = F.coalesce(F.col("doc") == component, F.lit(False))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "text_hash", F.col("comp").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``near_groups`` without the keys: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    return near_groups(docs, id_col, text_col, k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _step(up: DataFrame) -> DataFrame:
    """Each node's pointer, followed twice: (a, root)."""
    up = up.toDF("a", "to")
    far = up.toDF("_a", "root")
    return cut(up.join(far, up["to"] == far["_a"]).select("a", "root"), "roots")


def _merged(comps: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``comps`` with the components (ca, cb) of each found link made one, and the new names of those that changed."""
    found = cut(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
    if not found.limit(1).count():
        return comps, None
    names = components(found).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    known = comps.join(names, comps["comp"] == names["old"], "left").select("node", F.coalesce("new", "comp").alias("comp"))
    alone = names.join(comps.select("node"), names["old"] == comps["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("comp"))
    return cut(known.union(alone), "comps"), names


def _renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    return cut(rows.join(names, rows["comp"] == names["old"], "left").withColumn("comp", F.coalesce("new", "comp")).select(*rows.columns), "renamed")


def _blocks(rows: DataFrame, by: list[str], lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` of the written table ``lists`` (by, nn) twice, so that each two rows of a list meet in one block (by, x, y) of about BLOCK rows a side."""
    lists = _few(lists).withColumn("nb", F.ceil(F.col("nn") / BLOCK).cast("int")).drop("nn")
    rows = rows.join(lists, by).withColumn("at", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    one = rows.withColumn("x", F.col("at")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb", "at")
    two = rows.withColumn("y", F.col("at")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb", "at")
    return one, two


def _sides(one: DataFrame, two: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    on = [*by, "x", "y"]
    a = one.select(*on, *(F.col(c).alias(f"{c}_a") for c in columns))
    return a.join(two.select(*on, *(F.col(c).alias(f"{c}_b") for c in columns)), on)


def _centred(roots: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of roots with several components (key, root, comp, n, delta), and how often elements differ (root, e, f > 1).

    ``delta`` becomes the difference to the family's centre, which has what most of its nodes have, in place of that to the root.
    """
    named = comps.select(F.col("node").alias("key"), "comp")
    here = roots.select(F.col("a").alias("key"), F.col("b").alias("root"), F.col("na").alias("n"), "delta").join(named, "key", "left")
    here = here.withColumn("comp", F.coalesce("comp", "key"))
    mixed = here.groupBy("root").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("nodes")).where("lo <> hi").select("root", "nodes")
    here = cut(here.join(mixed, "root"), "families")
    often = here.select("root", "nodes", F.explode("delta").alias("e")).groupBy("root", "e").agg(F.count(F.lit(1)).alias("f"), F.first("nodes").alias("nodes"))
    often = cut(often.where("f > 1"), "often")
    centre = often.where("2 * f > nodes").groupBy("root").agg(F.collect_list("e").alias("m"))
    here = here.join(centre, "root", "left").withColumn("m", F.coalesce("m", F.array().cast("array<long>")))
    here = here.withColumn("delta", F.concat(F.array_except("delta", "m"), F.array_except("m", "delta"))).drop("m", "nodes")
    often = often.select("root", "e", F.when(F.expr("2 * f > nodes"), F.col("nodes") - F.col("f")).otherwise(F.col("f")).alias("f")).where("f > 1")
    return cut(here, "centred"), often


def _family_links(roots: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """``comps`` with all links between nodes (a, of size na) of one root (b), from their differences delta to the root.

    With p = percent and c = (100 - p) / (100 + p), A and B are linked if |A ^ B| <= c (|A| + |B|), and A ^ B is what their
    differences dA and dB to any third set, here the centre of ``_centred``, do not share. So they are linked if they share at
    least (tA + tB) / 2 elements of their differences, where t = |d| - c |A|. The node with the least t, the innermost, is linked
    with all nodes that need not share any; of two nodes in different components, at most one is among them. So one that is
    shares at least (t - least t) / 2 with a node of another component, one that is not (t + least t) / 2, and two such
    nodes meet under one of their |d| - share + 1 rarest elements. Elements of one node alone are the rarest; they take
    the first places and are not posted.

    Every list first meets one member, at first the innermost, then others by hash, until this links nothing more: tight
    groups of copies become one component so. Then what is left of the lists meets, if components differ. ``els`` are all elements of
    a node that others have too; ``s`` is their number, ``m0`` and on are their parities. These travel with the posts and
    leave few pairs, which alone meet ``els``.
    """
    here, often = _centred(roots, comps)
    size, columns = 100 + percent, ["key", "comp", "t", "s", *_parities()]
    here = here.withColumn("t", size * F.size("delta") - (100 - percent) * F.col("n"))
    inner = here.groupBy("root").agg(F.min(F.struct("t", "key", "comp")).alias("least"))
    inner = cut(inner.select("root", F.col("least.t").alias("t0"), F.col("least.comp").alias("comp0")), "inner")
    here = here.join(inner, "root").withColumn("in", F.col("t") + F.col("t0") <= 0)
    comps, names = _merged(comps, here.where("in and comp <> comp0").select(F.col("comp").alias("ca"), F.col("comp0").alias("cb")))
    here = here.select("root", "key", "comp", "t", "delta", F.when(F.col("in"), F.col("t") - F.col("t0")).otherwise(F.col("t") + F.col("t0")).alias("share"))
    if names is not None:
        here = _renamed(here, names)
    els = here.select("key", "root", F.explode("delta").alias("e")).join(often, ["root", "e"])
    els = els.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("els"))
    here = here.withColumn("share", F.greatest(F.lit(1), F.ceil(F.col("share") / (2 * size))).cast("int")).drop("delta").join(els, "key")
    prefix = F.slice("els", 1, F.greatest(F.lit(0), F.size("els") - F.col("share") + 1))
    here = here.withColumn("prefix", F.transform(prefix, lambda x: x["e"])).withColumn("els", F.transform("els", lambda x: x["e"]))
    parity = "aggregate(els, 0L, (acc, x) -> acc ^ if(x % {n} = {j}, shiftleft(1L, cast(x div {n} % 64 as int)), 0L)) as m{j}"
    here = here.select("root", "prefix", "key", "comp", "t", F.size("els").alias("s"), "els", *(F.expr(parity.format(n=PARITY, j=j)) for j in range(PARITY)))
    here = cut(here, "members")
    posts = cut(here.select("root", F.explode("prefix").alias("e"), *columns), "posts")
    both = F.col("t_a") + F.col("t_b")
    near = (F.col("comp_a") != F.col("comp_b")) & (both <= size * (F.col("s_a") + F.col("s_b") - _odd("_a", "_b")))

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs of components (ca, cb) from those pairs of nodes that do share enough."""
        pairs = cut(pairs.select("key_a", "key_b", "comp_a", "comp_b", both.alias("both")).distinct(), "near")
        for x in ("a", "b"):
            pairs = pairs.join(here.select(F.col("key").alias(f"key_{x}"), F.col("els").alias(f"els_{x}")), f"key_{x}")
        pairs = pairs.where(F.col("both") <= 2 * size * F.size(F.array_intersect("els_a", "els_b")))
        return pairs.select(F.col("comp_a").alias("ca"), F.col("comp_b").alias("cb"))

    names, turn = comps, 0
    while names is not None:
        rank = F.col("t").cast("long") if turn == 0 else F.xxhash64("key", "e", F.lit(turn))
        lists = posts.groupBy("root", "e").agg(F.min(F.struct(rank.alias("rank"), *columns)).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        lists = lists.where("lo <> hi").select("root", "e", *(F.col(f"lead.{c}").alias(f"{c}_b") for c in columns))
        met = posts.select("root", "e", *(F.col(c).alias(f"{c}_a") for c in columns)).join(cut(lists, "leaders"), ["root", "e"]).where("key_a <> key_b")
        met = cut(met.select("root", "e", *(F.col(f"{c}_a").alias(c) for c in columns), "key_b", "comp_b", "t_b", near.alias("near")), "met")
        pairs = met.where("near").select(F.col("key").alias("key_a"), "key_b", F.col("comp").alias("comp_a"), "comp_b", F.col("t").alias("t_a"), "t_b")
        comps, names = _merged(comps, linked(pairs))
        # A list's member that has met all others leaves it.
        posts, turn = met.select("root", "e", *columns), turn + 1
        if names is not None:
            posts = _renamed(posts, names)
    lists = posts.groupBy("root", "e").agg(F.count(F.lit(1)).alias("nn"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").drop("lo", "hi")
    met = _sides(*_blocks(posts, ["root", "e"], cut(lists, "mixed")), ["root", "e"], columns)
    return _merged(comps, linked(met.where((F.col("key_a") < F.col("key_b")) & near)))[0]


def _across(posts: DataFrame, comps: DataFrame, roots: DataFrame, places: DataFrame, ids: DataFrame, k: int, size: int, matches: int, percent: int) -> DataFrame:
    """Pairs (a, b, and their components ca, cb) of different roots and components that share a list, collide often enough and may be alike.

    One side leaves out the root that most nodes of the list have, as its nodes need not meet each other. Nodes of a list of more than ``BLOCK``
    rows meet by their rarest shingles instead (``_rare``): texts that share a frequent passage and little else have none in common.
    """
    prints = _prints(size)
    own = ["key", "n", "before", *prints, "comp", "root"]
    named = comps.select(F.col("node").alias("key"), "comp")
    posts = posts.join(named, "key", "left").join(roots, "key", "left").withColumns({"comp": F.coalesce("comp", "key"), "root": F.coalesce("root", "key")})
    posts = posts.withColumn("p", F.explode("prefix"))
    # The lists of earlier coordinates that the node is in as well.
    before = F.transform(F.filter("prefix", lambda x: x["c"] < F.col("p.c")), lambda x: x["c"].cast("long") * (1 << 32) + x["v"])
    posts = cut(posts.withColumn("before", before).select("p.c", "p.v", *own), "across")
    lists = _mixed(posts, ["c", "v"])
    met = _tops_apart(posts, lists.where(F.col("nn") <= BLOCK), ["c", "v"], own)
    enough = _collisions([f"{p}_a" for p in prints], [f"{p}_b" for p in prints]) >= matches
    # Of the lists that a pair shares, the first alone gives the pair; it may be a long one, which gives the pair itself.
    earlier = F.arrays_overlap("before_a", "before_b")
    met = met.where(enough & _similar(F.least("n_a", "n_b"), F.col("n_a") + F.col("n_b"), percent) & ~earlier)
    names = [F.col("key_a").alias("a"), F.col("key_b").alias("b"), F.col("comp_a").alias("ca"), F.col("comp_b").alias("cb"), "n_a", "n_b"]
    long = lists.where(F.col("nn") > BLOCK).select("c", "v")
    if long.isEmpty():
        return met.select(*names)
    wanted = cut(posts.join(_few(long), ["c", "v"], "left_semi").select("key", "n", "comp", "root").distinct(), "long")
    sets = _sets(places.join(_few(wanted.select("key")), "key"), ids, k)
    return met.select(*names).unionByName(_rare(wanted, sets, percent).select(*names)).distinct()


def _mixed(posts: DataFrame, by: list[str]) -> DataFrame:
    """Lists of ``posts`` with several components and roots: (by, nn, top), ``top`` being the root that most of their nodes have."""
    tops = posts.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("nr"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    lists = tops.groupBy(*by).agg(F.sum("nr").alias("nn"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.struct("nr", "root")).alias("top"))
    return cut(lists.where((F.col("lo") != F.col("hi")) & (F.col("nn") > F.col("top.nr"))).select(*by, "nn", F.col("top.root").alias("top")), "mixed")


def _tops_apart(posts: DataFrame, lists: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Pairs of nodes of different roots and components that share one of ``lists``, by columns ..._a and ..._b; once for each list."""
    one, two = _blocks(posts, by, lists)
    met = _sides(one.where(F.col("root") != F.col("top")), two, by, [*columns, "top"])
    return met.where((F.col("comp_a") != F.col("comp_b")) & (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("top_b")) | (F.col("key_a") < F.col("key_b"))))


def _rare(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``nodes`` (key, n, comp, root) that may be linked, by shared rare elements of their ``sets``.

    Two linked sets share at least percent / 100 of either's elements, so with elements ordered from rare to frequent they share
    one of the n - ceil(percent * n / 100) + 1 first ones of both. Elements of one node alone come first and are not posted.
    """
    els = nodes.select("key").join(sets.select("key", "shingles"), "key").select("key", F.explode("shingles").alias("e"))
    often = cut(els.groupBy("e").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "elements")
    shared = els.join(often, "e").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("els"))
    rows = nodes.join(shared, "key")
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("els"))
    rows = rows.withColumn("first", F.transform(F.slice("els", F.lit(1), F.greatest(F.lit(0), keep).cast("int")), lambda x: x["e"])).drop("els")
    posts = rows.withColumn("e", F.explode("first"))
    before = F.filter("first", lambda x: x < F.col("e"))
    own = ["key", "n", "comp", "root", "before"]
    posts = cut(posts.withColumn("before", before).select("e", *own), "rare")
    met = _tops_apart(posts, _mixed(posts, ["e"]), ["e"], own)
    return met.where(_similar(F.least("n_a", "n_b"), F.col("n_a") + F.col("n_b"), percent) & ~F.arrays_overlap("before_a", "before_b"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-copies among all documents, on two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
