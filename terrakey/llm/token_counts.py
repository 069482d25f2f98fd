"""Token counts with a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from terrakey.llm.common import cut, fresh_dir, small_batches
from terrakey.llm.wordhash import chunks

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = SentencePieceProcessor(model_file=path)
        for batch in batches:
            digest, text = batch.columns
            for a, b, _, _ in chunks(text):
                ids = library.encode(text.slice(a, b - a).to_pylist(), num_threads=1)
                yield pa.RecordBatch.from_arrays([digest.slice(a, b - a), pa.array([len(x) for x in ids], pa.int64())], ["digest", "n_tokens"])

    return run


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer's file; other bytes are another version."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    try:
        return spark.read.schema(T.StructType.fromDDL(CACHE_SCHEMA)).parquet(cache).where(F.col("version") == version).select("digest", "n_tokens")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def token_counts(docs: DataFrame, cache: str, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Content is normalised by taking null as empty (the tokenizer sees every other difference, so nothing else may be
    merged) and digested by SHA-256. (tokenizer version, digest) is looked up in the Parquet table ``cache``; of the
    digests that it lacks, one text each is encoded, and the counts are appended. A later run on the same cache encodes
    only what is new. The text of a digest is found again by an id of its rows (a hash of the text where the id
    is null), so that thousands of copies meet their digest without meeting in one task.

    Empty texts have no tokens. Repeated rows give repeated results. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.coalesce("doc_id", F.xxhash64("text")).alias("at"))
    stored = _cached(spark, cache, version)
    wanted = rows.groupBy("digest", "at").agg(F.count(F.lit(1)).alias("rows")).groupBy("digest").agg(F.min(F.struct("rows", "at")).alias("m")).select("digest", "m.at", "m.rows")
    if stored is not None:
        wanted = wanted.join(stored, "digest", "left_anti")
    wanted = cut(wanted, "misses")
    found = rows.select("digest", "at", "text").join(wanted, ["digest", "at"])
    # Where every row of a text shares its place (null ids, rows that repeat an id), one of them is taken first.
    once = found.where("rows > 1").groupBy("digest").agg(F.first("text").alias("text"))
    new = found.where("rows = 1").select("digest", "text").unionByName(once).mapInArrow(_counts(path), "digest binary, n_tokens long")
    with small_batches(spark):
        new.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    known = cut(_cached(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    sizes = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    out = sizes.join(known, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from an empty cache."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, fresh_dir(spark, "token-cache"), public_tokenizers.path("piece_bpe_32k.model"))
