"""Sharding by balanced label propagation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.llm.common import cut, ranked


def _quotas(want: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """Moves allowed between shards that leave every count as it is: of linked rows, and of unlinked rows the other way.

    ``want`` and ``free`` have one number per pair of shards and per shard, whatever the input's size.
    """
    linked, back = {}, {}
    left = dict(free)
    for s in range(shards):
        for t in range(s):
            a, b = want.get((s, t), 0), want.get((t, s), 0)
            if a < b:
                (x, y), a, b = (t, s), b, a
            else:
                x, y = s, t
            # As many go x to y as come back: linked rows first, then unlinked ones.
            fill = min(a - b, left.get(y, 0))
            left[y] = left.get(y, 0) - fill
            linked[x, y], linked[y, x], back[y, x] = b + fill, b, fill
    return linked, back


#: Groups of at least a ``1 / LARGE`` of a shard get their shard first. There are at most LARGE groups for each shard.
LARGE = 16


def _anchors(groups: list[tuple[int, int]], shards: int, room: int) -> dict[int, int]:
    """A shard for each group (key, members), largest first: the one with the least room that holds it whole, else the one with the most.

    ``groups`` has at most LARGE entries for each shard, whatever the input's size.
    """
    left, out = dict.fromkeys(range(shards), room), {}
    for key, members in sorted(groups, key=lambda g: (-g[1], g[0])):
        fits = [s for s in left if left[s] >= members]
        s = min(fits, key=lambda s: (left[s], s)) if fits else max(left, key=lambda s: (left[s], -s))
        left[s] = max(0, left[s] - members)
        out[key] = s
    return out


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``rows``: the shards' counts differ by one at most. Rows of equal text are linked, through their group
    rather than pair by pair. Only a group that no shard could hold is split, into the fewest parts of a shard's size and a rest;
    the parts are linked within.

    Rows start in the shard of their rank. In each round every group finds the shard that holds most of it (ties: by hash),
    and its rows elsewhere want to move there. Groups of a sixteenth of a shard or more, of which there are few, are given shards beforehand that have room for
    all of them, as several that drew each other's shard would block one another. Quotas for each pair of shards let as many go one way as come back:
    linked rows in both directions, then unlinked rows, which lose nothing by moving. Movers are ranked within their
    pair of shards, bucket by bucket. So counts stay even in every round while the number of cut links falls. Linked rows only move to where most
    of their group is, so each round gathers groups further; it ends when no move is wanted or allowed.

    Null texts are empty and, like all empty texts, form one group. Null and repeated ids are kept as they are, rows are told
    apart by a number of their own. Other columns are not used. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    room = max(1, n // shards)
    sizes = cut(rows.groupBy("g1", "text_crc32", "size").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "groups")
    rows = cut(ranked(rows, [], ["row"], "rank"), "ranked")
    linked = rows.join(sizes, ["g1", "text_crc32", "size"])
    # What no shard holds is cut into parts of a shard's size, by rank within the group.
    key = F.xxhash64("g1", "text_crc32", "size")
    huge = linked.where(F.col("members") > room).select("row", key.alias("key"))
    whole = linked.where(F.col("members") <= room).select(F.col("row").alias("_row"), key.alias("group"))
    dealt = ranked(cut(huge, "huge"), ["key"], ["row"], "at").select(F.col("row").alias("_row"), F.xxhash64("key", F.floor(F.col("at") / room)).alias("group"))
    named = cut(whole.unionByName(dealt), "members")
    large = named.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") * LARGE >= room)
    anchors = _anchors([(r.group, r.members) for r in large.collect()], shards, room) if room >= LARGE else {}
    fixed = F.broadcast(docs.sparkSession.createDataFrame(list(anchors.items()), "_a long, anchor int"))
    state = rows.join(named, rows["row"] == named["_row"], "left").select("row", "group", (F.col("rank") % shards).cast("int").alias("shard"))
    state = cut(state, "state")
    turn = 0
    while True:
        turn += 1
        here = state.where("group is not null").groupBy("group", "shard").agg(F.count(F.lit(1)).alias("k"))
        best = here.groupBy("group").agg(F.max(F.struct("k", F.xxhash64("group", "shard").alias("tie"), "shard")).alias("b"))
        best = best.join(fixed, best["group"] == F.col("_a"), "left")
        target = cut(best.select(F.col("group").alias("_g"), F.coalesce("anchor", "b.shard").alias("to"), F.col("b.k").alias("pull")), "targets")
        moving = state.where("group is not null").join(target, state["group"] == target["_g"]).where("shard <> to").select("row", "shard", "to", "pull")
        moving = cut(moving, "movers")
        want = {(r.shard, r.to): r.n for r in moving.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not want:
            break
        free = {r.shard: r.n for r in state.where("group is null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        allowed, back = _quotas(want, free, shards)
        spark = docs.sparkSession
        quota = F.broadcast(spark.createDataFrame([(s, t, x) for (s, t), x in allowed.items() if x], "shard int, to int, quota long"))
        go = ranked(moving, ["shard", "to"], ["pull", "row"], "at").join(quota, ["shard", "to"]).where("at < quota").select("row", "to")
        # Unlinked rows of a shard that have to come back, dealt out by consecutive ranges of their ranks.
        ranges, first = [], {}
        for (s, t), x in sorted(back.items()):
            if x:
                ranges.append((s, t, first.get(s, 0), first.get(s, 0) + x))
                first[s] = first.get(s, 0) + x
        if ranges:
            dealt = F.broadcast(spark.createDataFrame(ranges, "shard int, to int, low long, high long"))
            alone = cut(state.where("group is null").select("row", "shard", F.xxhash64("row", F.lit(turn)).alias("o")), "alone")
            fill = ranked(alone, ["shard"], ["o", "row"], "at").join(dealt, "shard").where("at >= low and at < high").select("row", "to")
            go = go.unionByName(fill)
        go = cut(go.select(F.col("row").alias("_row"), "to"), "moves")
        if not go.limit(1).count():
            break
        state = cut(state.join(go, state["row"] == go["_row"], "left").select("row", "group", F.coalesce("to", "shard").alias("shard")), "state")
    placed = cut(rows.join(state.select(F.col("row").alias("_row"), "shard"), rows["row"] == F.col("_row")).select("doc_id", "size", "text_crc32", "row", "shard"), "placed")
    out = ranked(placed, ["shard"], ["row"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
