"""Secret scans with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.llm.common import cut

# The kinds in their order, each with its pattern, the group that holds the value, and its least length.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs [0-9a-f]+ of 24 or more characters
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ["assign", "access", "hex", "opaque"]
SPAN = "array<struct<start:int,kind:int,end:int,v:long>>"


def _matches(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of the matches whose value has ``least`` characters or more; code points, end exclusive.

    What lies between matches comes from splitting at the pattern, so that running lengths give the places.
    """
    full = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else full
    rows = F.arrays_zip(F.transform(F.split(text, pattern), F.length).alias("gap"), F.transform(full, F.length).alias("len"), value.alias("v"))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["len"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(x["v"]).alias("v")))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _spans(text: Column, low: Column) -> Column:
    none = F.array().cast(SPAN)
    keyword = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        keyword = keyword | low.contains(word)
    opaque = _matches(text, OPAQUE, 3, 0, 24)
    return F.concat(
        F.when(keyword, _matches(text, ASSIGN, 0, 1, 6)).otherwise(none),
        F.when(text.contains("AKIA"), _matches(text, ACCESS, 1, 0, 20)).otherwise(none),
        F.when(text.rlike(HEX), _matches(text, HEX, 2, 0, 24)).otherwise(none),
        F.when(text.rlike(OPAQUE), opaque).otherwise(none),
    )


def _joined(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_k1"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_k2")]


def _named(column: str) -> Column:
    """A text that tells null from empty."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def scan_secrets(docs: DataFrame, repo: str = "doc_id", owner: str = "source", text: str = "text", max_owners: int = 2, max_repos: int = 1000) -> DataFrame:
    """Adds to every row of ``docs``: ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``live_spans``.

    Base candidates are assignments to credential names, access keys and long hexadecimal runs. The method adds opaque
    runs of key characters. Candidate values are hashed and aggregated over the corpus by distinct repositories and
    owners: a value that more than ``max_owners`` owners or ``max_repos`` repositories have is a widely copied example, any other
    is owner-specific and looks live. An opaque run becomes a span if it is owner-specific and overlaps no base span (a run in
    many hands is boilerplate); base spans stay whatever the verdict. ``live_spans`` are the spans, as structs, that look live.

    Values are counted by ever fewer columns, (value, owner, repository), (value, owner), (value), each combined before
    its shuffle, so a value in a third of all rows is no hot key. Verdicts are per content, never per id: null or
    repeated ids do no harm. Null and empty texts have no spans. Null owners count as one owner, null repositories as one, apart from empty ones.
    Other columns pass through, save those with the names of the results, which are replaced.
    """
    own = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "live_spans"]
    keep = [c for c in docs.columns if c not in own]
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*_key(F.col(text)), _named(owner).alias("owner"), _named(repo).alias("repo"), t.alias("t"))
    rows = rows.withColumn("low", F.lower("t")).select("_k1", "_k2", "owner", "repo", _spans(F.col("t"), F.col("low")).alias("s"))
    found = cut(rows.where(F.size("s") > 0), "candidates")
    values = found.select("owner", "repo", F.explode(F.array_distinct(F.col("s.v"))).alias("v")).distinct()
    values = values.groupBy("v", "owner").agg(F.count(F.lit(1)).alias("repos")).groupBy("v").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    verdicts = cut(values.select("v", ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).alias("live")), "verdicts")
    contents = cut(found.groupBy("_k1", "_k2").agg(F.first("s").alias("s")), "contents")
    spans = contents.select("_k1", "_k2", F.explode("s").alias("x")).select("_k1", "_k2", "x.*").join(verdicts, "v")
    spans = spans.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "kind", "end", "live")).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < 3)
    added = F.filter("all", lambda s: (s["kind"] == 3) & s["live"] & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    judged = spans.withColumn("base", base).select("_k1", "_k2", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", added)).alias("both"))
    judged = cut(judged.select(F.col("_k1").alias("_r1"), F.col("_k2").alias("_r2"), "base", "both"), "judged")
    out = docs.select(*keep, *_key(F.col(text)))
    out = out.join(judged, (F.col("_k1") == F.col("_r1")) & (F.col("_k2") == F.col("_r2")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    base, both = F.coalesce("base", none), F.coalesce("both", none)
    counts = [F.size(F.filter(F.transform(base, lambda s: s["kind"] == F.lit(k)), lambda same: same)).cast("long").alias(own[k]) for k in range(3)]
    return out.select(*keep, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(both).alias("spans"), F.filter(both, lambda s: s["live"]).alias("live_spans"))


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """A text with spans replaced by a mask; overlapping spans become one."""
    done = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of secrets in all documents."""
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.size("live_spans").alias("n_live"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS owner, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, owner, kind, name, least, f, v, g, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS i
  FROM (
    SELECT doc_id, owner, kind, name, least, unnest(range(1, len(fs) + 1)) AS i, unnest(fs) AS f, unnest(vs) AS v, unnest(gs[:len(fs)]) AS g
    FROM (
      SELECT doc_id, owner, kind, name, least, CASE kind WHEN 0 THEN a0 WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END AS fs,
             CASE kind WHEN 0 THEN v0 WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END AS vs,
             CASE kind WHEN 0 THEN g0 WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE g3 END AS gs
      FROM (SELECT doc_id, owner,
              regexp_extract_all(t, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS a0,
              regexp_extract_all(t, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS v0,
              regexp_split_to_array(t, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS g0,
              regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS a1, regexp_split_to_array(t, 'AKIA[A-Z0-9]+') AS g1,
              regexp_extract_all(t, '[0-9a-f]+') AS a2, regexp_split_to_array(t, '[0-9a-f]+') AS g2,
              regexp_extract_all(t, '[A-Za-z0-9+/_-]{24,}') AS a3, regexp_split_to_array(t, '[A-Za-z0-9+/_-]{24,}') AS g3
            FROM d), (VALUES (0, 'assign', 6), (1, 'access', 20), (2, 'hex', 24), (3, 'opaque', 24)) AS q(kind, name, least)))),
s AS (
  SELECT doc_id, owner, kind, name, least, v, CAST(sum(length(g) + length(f)) OVER w - length(f) AS BIGINT) AS a, CAST(sum(length(g) + length(f)) OVER w AS BIGINT) AS b
  FROM m WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
c AS (SELECT * FROM s WHERE length(v) >= least),
live AS (SELECT v, count(DISTINCT owner) <= 2 AND count(DISTINCT coalesce('=' || doc_id, '')) <= 1000 AS live FROM c GROUP BY v),
spans AS (
  SELECT c.*, live FROM c JOIN live USING (v)
  WHERE kind < 3 OR (live AND NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.kind < 3 AND b.a < c.b AND c.a < b.b))),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (WHERE kind < 3), '') AS base,
         string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans, CAST(count(*) FILTER (WHERE live) AS INTEGER) AS n_live
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (doc_id)
"""
