"""Language identification by nearest centroid over TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.llm.common import cut
from terrakey.llm.wordhash import U64, chunks, mix

#: Dimensions of the hashed n-gram vectors, byte lengths of the n-grams.
DIMENSIONS, LENGTHS = 8192, (1, 2, 3, 4)
#: Bounds of the fit: labelled texts of one language, centroids of a language, rounds of clustering. The number of languages has no bound.
TEXTS_PER_LANGUAGE, CENTROIDS, TURNS = 1000, 4, 8
#: Share of a language's texts that may lie below its distance limit.
REJECTED = 0.01

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] = _FOLD[97:123]
# Marks, digits and white space tell nothing of the language: all of them are one gap.
_GAP = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])
_FOLD[_GAP] = 32


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n-gram counts (texts x DIMENSIONS) of the whole texts of a chunk, as logarithms."""
    texts = offsets.size - 1
    out = np.zeros(texts * DIMENSIONS, np.float32)
    if data.size:
        letters = _FOLD[data]
        owner = np.repeat(np.arange(texts, dtype=np.int64), np.diff(offsets))
        h = np.zeros(data.size, U64)
        for n in range(1, max(LENGTHS) + 1):
            m = data.size - n + 1
            if m <= 0:
                break
            h = h[:m] * U64(257) + letters[n - 1 :]
            if n in LENGTHS:
                # n-grams within one text that do not run over a gap, but may begin or end at it
                inner = np.ones(m, bool)
                for j in range(1, n - 1):
                    inner &= letters[j : j + m] != 32
                if n == 1:
                    inner &= letters != 32
                inner &= owner[:m] == owner[n - 1 :]
                place = owner[:m][inner] * DIMENSIONS + (mix(h[inner] + U64(n << 56)) >> U64(51)).astype(np.int64)
                out += np.bincount(place, minlength=out.size)
    return np.log1p(out.reshape(texts, DIMENSIONS))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Languages with their centroids and distance limits: CENTROIDS vectors a language, all that the driver ever holds of the fit."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Largest cosine of each text with each language's centroids."""
        near = _unit(x * self.idf) @ self.centroids.T
        return np.maximum.reduceat(near, np.searchsorted(self.owner, np.arange(len(self.languages))), axis=1)


def _text_vectors(texts: pa.Array) -> np.ndarray:
    return np.concatenate([vectors(d, o) for _, _, d, o in chunks(texts)]) if len(texts) else np.zeros((0, DIMENSIONS), np.float32)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a batch each dimension occurs, and the number of texts as the last one."""
    for batch in batches:
        texts, total = batch.column(0), np.zeros(DIMENSIONS + 1, np.int64)
        for i in range(0, len(texts), 256):
            x = _text_vectors(texts.slice(i, 256))
            total[:-1] += (x > 0).sum(axis=0)
            total[-1] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(total)], ["dim", "n"])


def _clustered(idf: np.ndarray):
    """Spherical k-means of one language's texts, which are ordered by hash: its centroids and its distance limit."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h").slice(0, TEXTS_PER_LANGUAGE)
        x = _unit(_text_vectors(table["text"].combine_chunks()) * idf)
        c = x[np.linspace(0, len(x) - 1, min(CENTROIDS, len(x))).astype(int)]
        for _ in range(TURNS):
            at = (x @ c.T).argmax(axis=1)
            c = _unit(np.stack([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))]))
        limit = float(np.quantile((x @ c.T).max(axis=1), REJECTED))
        return pa.table({"lang": [table["lang"][0].as_py()], "limit": [limit], "centroids": pa.array([c.astype(np.float32).tobytes()], pa.binary())})

    return run


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Model from rows with a language and a text.

    The fit takes a bounded sample: of each language the TEXTS_PER_LANGUAGE texts with the smallest hashes, equal texts once. A task
    clusters the sample of one language (spherical k-means); only centroids, limits and the counts of dimensions come to the driver, never
    a text. Languages are as many as there are. Without any labelled text the model knows no language.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # Hashes below a language's limit hold somewhat more than the texts wanted; the rest is cut exactly.
    share = F.least(F.lit(1.0), (1.5 * TEXTS_PER_LANGUAGE + 100) / F.col("n"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", (share * (1 << 30)).cast("long").alias("most"))
    near = rows.join(cut(sizes, "languages"), "lang").where(F.pmod("h", F.lit(1 << 30)) <= F.col("most")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    near = cut(near, "labelled")
    seen = np.zeros(DIMENSIONS + 1)
    for r in near.select("text").mapInArrow(_seen, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        seen[r.dim] = r.n
    if not seen[-1]:
        return Model([], np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])).astype(np.float32)
    found = near.groupBy("lang").applyInArrow(_clustered(idf), "lang string, limit double, centroids binary").orderBy("lang").collect()
    parts = [np.frombuffer(r.centroids, np.float32).reshape(-1, DIMENSIONS) for r in found]
    owner = np.repeat(np.arange(len(parts)), [len(c) for c in parts])
    return Model([r.lang for r in found], idf, np.concatenate(parts), owner, np.array([r.limit for r in found]))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, object)
        for batch in batches:
            text, *rest = batch.columns
            for a, b, data, offsets in chunks(text):
                best, score, far = [], [], []
                for i in range(0, b - a, 256):
                    o = offsets[i : min(i + 256, b - a) + 1]
                    near = model.cosines(vectors(data[o[0] : o[-1]], o - o[0]))
                    at = near.argmax(axis=1)
                    best.append(at)
                    score.append(near[np.arange(len(at)), at])
                    far.append(score[-1] < model.limits[at])
                at = np.concatenate(best)
                columns = [x.slice(a, b - a) for x in rest]
                columns += [pa.array(names[at], pa.string()), pa.array(np.clip(np.concatenate(score), 0, 1).astype(float)), pa.array(np.concatenate(far))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lettered", "held_out", "lang", "score", "far"])

    return run


def predict(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected``.

    A whole text's n-grams of 1 to 4 bytes within words (A-Z as a-z, marks and digits as gaps) are hashed, weighted by
    TF-IDF and compared with all centroids by cosine; the nearest centroid's language wins, ties the first in
    alphabetical order, and ``score`` is the cosine. ``rejected`` is true where the text lies farther from it than all
    but REJECTED of the language's own texts: trust such a prediction less. A null text or one without a letter is
    ``und`` with score 0, and rejected; so is every text if the model knows no language. Repeated rows give repeated results. An empty table gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"), held_out.alias("held_out"))
    if not model.languages:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    out = rows.mapInArrow(_predict(model), "doc_id long, lettered boolean, held_out boolean, lang string, score double, far boolean")
    none = ~F.col("lettered")
    return out.select(
        "doc_id",
        "held_out",
        F.when(none, F.lit("und")).otherwise(F.col("lang")).alias("lang_pred"),
        F.when(none, F.lit(0.0)).otherwise(F.col("score")).alias("score"),
        (none | F.col("far")).alias("rejected"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from those that are not held out. A null id counts as the empty text there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return predict(docs, fit(docs.where(~held_out)), held_out)
