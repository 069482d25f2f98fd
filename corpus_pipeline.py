"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.llm.common import cut, small_batches
from terrakey.llm.decontamination import contamination
from terrakey.llm.near_dedup import BROADCAST, near_groups
from terrakey.llm.packing import pack_documents
from terrakey.llm.quality import quality
from terrakey.llm.secrets import redacted, scan_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above the limits; n_chars is counted anew where lines went."""
    out = quality(docs.select(COLUMNS)).where("kept")
    n_chars = F.when(F.col("n_removed_words") > 0, F.length("cleaned").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the smallest id, then the smallest hash of its text.

    Texts are compared on five-word shingles at a similarity of 0.8. Rows are told apart by id and text, so a text whose id
    another document has too is judged for itself, and null ids, which come last, are ids like any other. Of rows with
    equal id and text the one with the smallest other columns stays. Texts without a word are in no group and stay. Up to
    BROADCAST keys of rows that go are broadcast; beyond that the texts are shuffled once to meet them.
    """
    content = F.xxhash64("text")
    groups = near_groups(docs).where("component is not null").select("component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("row"))
    least = groups.groupBy("component").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    groups = cut(groups.join(least, "component").select("row.doc_id", "row.text_hash", (F.col("row") == F.col("least")).alias("first")), "copies")
    key = [F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")]
    often = cut(groups.where("first").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), "repeated")
    out = cut(groups.where("not first").select(*key).distinct().union(often), "dropped")
    often, out = (F.broadcast(x) if x.count() <= BROADCAST else x for x in (often, out))
    same = [docs["doc_id"].eqNullSafe(F.col("_d")), content == F.col("_h")]
    once = docs.select(COLUMNS).join(out, same, "left_anti")
    others = ["lang", "source", "n_chars"]
    again = docs.select(COLUMNS).join(often, same, "left_semi").groupBy("doc_id", content.alias("_h")).agg(F.min(F.struct(*others)).alias("x"), F.first("text").alias("text"))
    return once.unionByName(again.select("doc_id", "text", "x.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. What is found is keyed by id and text, so null ids do no harm."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    with small_batches(spark):
        found = cut(found.select(F.col("text_hash").alias("_h"), F.col("doc_id").alias("_d")).distinct(), "contaminated")
    return docs.select(COLUMNS).join(found, F.xxhash64("text").eqNullSafe(F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti").select(COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that look live replaced by a mask and n_chars counted anew for those."""
    out = scan_secrets(docs.select(COLUMNS))
    text = redacted(F.col("text"), F.col("live_spans"))
    n_chars = F.when(F.size("live_spans") > 0, F.length("masked").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("masked", text).select("doc_id", F.col("masked").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents left."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: CGK hashing and sum-of-squares packing are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
