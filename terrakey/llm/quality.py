"""Quality rules with cross-document line frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.llm.common import SPACE_RUN, cut, words_of

SYMBOLS = "[#*$%&|<>]+"


def _text_features(docs: DataFrame, text: str) -> DataFrame:
    """Adds the base counts of each whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"_w": words_of(F.col(text)), "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, SPACE_RUN, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        }
    ).drop("_w", "_lines")
    at = lambda i: F.get(F.col("_h"), i)
    starts = F.when(F.size("_h") >= 3, F.sequence(F.lit(0), F.size("_h") - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_win", F.transform(starts, lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("p")))).drop("_h")
    # Only a text in which some window comes twice is sorted.
    twice = F.size(F.array_distinct(F.col("_win.h"))) < F.size("_win")
    df = df.withColumn("_s", F.when(twice, F.sort_array("_win"))).drop("_win")
    near = lambda x, i: F.get(F.col("_s"), i)["h"] == x["h"]
    same = F.filter("_s", lambda x, i: F.coalesce((i > 0) & near(x, i - 1), F.lit(False)) | F.coalesce(near(x, i + 1), F.lit(False)))
    df = df.withColumn("_p", F.sort_array(F.transform(same, lambda x: x["p"]))).drop("_s")
    # Each repeated window adds the words that the one before it did not cover.
    steps = F.zip_with(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), F.slice("_p", 1, F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: F.least(a - b, F.lit(3)))
    covered = F.aggregate(steps, F.lit(3), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.when(F.size("_p") > 0, covered).otherwise(0).cast("long")).drop("_p")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def _line_rows(text: Column) -> Column:
    """(hash, words) of each line with a word, normalised: lower case, white space runs as one space, trimmed."""
    clean = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _normal)
    return F.transform(F.filter(clean, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w")))


def quality(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_docs: int = 20,
    max_share: float = 0.05,
    min_left: float = 0.3,
    min_words: int = 50,
) -> DataFrame:
    """Adds base counts, line-frequency counts, a verdict and the text without common lines to every row of ``docs``.

    Lines are normalised and hashed; for each host and line the distinct documents are counted, where equal texts of a
    host count as one document (copies are the business of deduplication, not of this rule). A line is above the limit
    if it is in more than ``min_docs`` documents of a host and in more than ``max_share`` of them; it is removed there:
    ``cleaned`` is the text without those lines, all others as they are. A document is depleted, and so not kept, when less than ``min_left`` of its words are left. ``base_failed``
    documents are never kept.

    A null or empty text has no words and fails the base rule. A null host is a host of its own. Repeated rows get equal
    results. Other columns pass through, save those with the names of the results, which are replaced.

    Words of removed lines are summed by host and content, never by document id, so ids may be null or repeat. The
    aggregations combine before they shuffle; a line shared by a third of all rows arrives as one row per task. Verdicts
    are joined back from a written table, so that Spark can split the rows of a content that has very many copies.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept"]
    keep = [c for c in docs.columns if c not in (*own, "cleaned")]
    # A null host is a host of its own, not the host with the empty name.
    host_key = F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("-"))
    named = [F.xxhash64(host_key, F.col(text)).alias("_k1"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_k2")]
    lines = docs.select(host_key.alias("_host"), *named, F.explode(_line_rows(F.col(text))).alias("x")).select("_host", "_k1", "_k2", "x.h", "x.w")
    # One row for each host, content and line; copies of a content add equal parts, so every sum is divided by them.
    seen = cut(lines.groupBy("_host", "_k1", "_k2", "h").agg(F.sum("w").alias("w")), "lines")
    counts = own[:5]
    contents = _text_features(docs.select(host_key.alias("_host"), *named, F.col(text).alias("_text")), "_text")
    contents = cut(contents.groupBy("_host", "_k1", "_k2").agg(F.count(F.lit(1)).alias("_copies"), *(F.max(c).alias(c) for c in counts)), "contents")
    hosts = cut(contents.groupBy("_host").agg(F.count(F.lit(1)).alias("_all")), "hosts")
    frequent = seen.groupBy("_host", "h").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") > min_docs)
    frequent = cut(frequent.join(hosts, "_host").where(F.col("_docs") > max_share * F.col("_all")).select("_host", "h"), "frequent")
    removed = seen.join(frequent, ["_host", "h"], "left_semi").groupBy("_k1", "_k2").agg(F.sum("w").alias("_sum"), F.collect_list("h").alias("_gone"))
    n, gone = F.col("n_words"), F.coalesce(F.expr("_sum div _copies"), F.lit(0)).cast("long")
    judged = contents.join(removed, ["_k1", "_k2"], "left").withColumn("n_removed_words", gone)
    judged = judged.withColumn("base_failed", (n < min_words) | (100 * F.col("n_repeat_words") > 50 * n))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (n - F.col("n_removed_words") >= min_left * n))
    judged = cut(judged.select(F.col("_k1").alias("_r1"), F.col("_k2").alias("_r2"), *own, "_gone"), "judged")
    out = docs.select(*keep, *named, F.col(text).alias("_text")).join(judged, (F.col("_k1") == F.col("_r1")) & (F.col("_k2") == F.col("_r2")))
    left = F.filter(F.split("_text", "\n"), lambda x: ~F.array_contains("_gone", F.xxhash64(_normal(x))))
    cleaned = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))
    return out.select(*keep, *own, cleaned.alias("cleaned"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality verdicts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce('h' || source, '-') AS host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
ln AS (SELECT doc_id, host, t, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS x FROM d, LATERAL (SELECT unnest(ls) AS x)),
sizes AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY host),
freq AS (SELECT host, x, count(DISTINCT t) AS n FROM ln GROUP BY host, x),
bad AS (SELECT f.host, f.x FROM freq f JOIN sizes s USING (host) WHERE f.n > 20 AND f.n > 0.05 * s.n),
gone AS (SELECT doc_id, sum(len(string_split(x, ' '))) AS n FROM ln JOIN bad USING (host, x) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept,
       n_removed_words
FROM base
"""
