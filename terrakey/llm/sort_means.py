"""Centroid clustering by sort-means over integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.llm.common import cut, discard, written

#: Vectors of a block, which is one row of the written tables.
BLOCK = 2048
#: Bound of the integers' magnitude: squared distances of 64 of them fit a long with room for sums over a block.
BOUND = 1 << 23


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), x as double; beyond ``BOUND`` the bound."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -BOUND, BOUND).astype(np.int64)


def kept_vectors(embedding: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists with exactly ``size`` elements, none null or not finite, and their values."""
    if isinstance(embedding, pa.ChunkedArray):
        embedding = embedding.combine_chunks()
    lengths = np.asarray(embedding.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == size)
    flat = embedding.take(pa.array(at)).flatten() if len(at) else pa.array([], embedding.type.value_type)
    values = np.asarray(flat.fill_null(float("nan")), dtype=np.float64).reshape(len(at), size)
    ok = np.isfinite(values).all(axis=1)
    return at[ok], values[ok]


def order_of(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others from near to far, and their squared distances to it."""
    d = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(d, axis=1, kind="stable")
    order = np.stack([row[row != i] for i, row in enumerate(order)]) if len(centroids) > 1 else np.zeros((len(centroids), 0), int)
    return order, np.take_along_axis(d, order, axis=1)


def assign(v: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector and the squared distance, ties to the smaller number.

    A vector starts from its previous centroid at distance d and meets the others in that one's order; it stops at the first
    that is strictly farther than 2 d from it, as by the triangle inequality that one and all later ones are strictly farther
    from the vector than d. In squares that is 4 d².
    """
    first = ((v - centroids[before]) ** 2).sum(axis=1)
    best, dist = before.copy(), first.copy()
    for c in np.unique(before):
        mine = np.flatnonzero(before == c)
        for other, gap in zip(order[c], apart[c], strict=True):
            mine = mine[gap <= 4 * first[mine]]
            if not len(mine):
                break
            d = ((v[mine] - centroids[other]) ** 2).sum(axis=1)
            nearer = (d < dist[mine]) | ((d == dist[mine]) & (other < best[mine]))
            best[mine[nearer]], dist[mine[nearer]] = other, d[nearer]
    return best, dist


_BLOCKS = "ids array<long>, q binary, cluster binary, distance binary, counts array<long>, sums array<long>"


def _block(ids: pa.Array, v: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> list:
    best, dist = assign(v, before, centroids, order, apart)
    sums = np.zeros(centroids.shape, np.int64)
    np.add.at(sums, best, v)
    return [ids, v.astype(np.int32).tobytes(), best.astype(np.int32).tobytes(), dist.tobytes(), np.bincount(best, minlength=len(centroids)).tolist(), sums.ravel().tolist()]


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["ids", "q", "cluster", "distance", "counts", "sums"])


def _packed(size: int, scale: int, centroids: np.ndarray):
    """Vectors as blocks, assigned to the first centroids."""
    order, apart = order_of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = kept_vectors(batch.column(1), size)
            v, ids = integers(values, scale), batch.column(0).take(pa.array(at))
            for i in range(0, len(at), BLOCK):
                part = v[i : i + BLOCK]
                yield _batch([_block(ids[i : i + BLOCK].to_pylist(), part, np.zeros(len(part), np.int64), centroids, order, apart)])

    return run


def _moved(centroids: np.ndarray):
    """Blocks assigned to new centroids, from the previous assignment."""
    order, apart = order_of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, q, cluster in zip(*(batch.column(c) for c in ("ids", "q", "cluster")), strict=True):
                v = np.frombuffer(q.as_py(), np.int32).astype(np.int64).reshape(-1, centroids.shape[1])
                yield _batch([_block(ids.as_py(), v, np.frombuffer(cluster.as_py(), np.int32).astype(np.int64), centroids, order, apart)])

    return run


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, cluster, distance in zip(*(batch.column(c) for c in ("ids", "cluster", "distance")), strict=True):
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(cluster.as_py(), np.int32)), pa.array(np.frombuffer(distance.as_py(), np.int64))], ["vec_id", "cluster", "distance"])


def _updated(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each component; empty clusters keep their centroid. Only sums by block are read, only k rows come here."""
    k, size = centroids.shape
    counts = blocks.select(F.posexplode("counts").alias("c", "x")).groupBy("c").agg(F.sum("x").alias("n")).collect()
    sums = blocks.select(F.posexplode("sums").alias("c", "x")).groupBy("c").agg(F.sum("x").alias("s")).collect()
    n, s = np.zeros(k, np.int64), np.zeros(k * size, np.int64)
    for row in counts:
        n[row["c"]] = row["n"]
    for row in sums:
        s[row["c"]] = row["s"]
    s = s.reshape(k, size)
    return np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], centroids)


def sort_means(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids): ``rounds`` of assignment and update, then a last assignment; distances are squared.

    Vectors with exactly ``size`` components, none null or not finite, count, as integers floor(scale * x). The first centroids are
    the k with the smallest hash of seed and id, ascending; of equal ids, the smaller vector; null ids come last. With fewer vectors
    there are fewer centroids, without any no rows. Repeated rows are rows of their own. Components beyond ``BOUND`` / scale count as that bound, so that all
    arithmetic is exact in longs.

    Blocks of vectors with their assignment are a written table, replaced in every round; a round reads it once, and writes each
    block's sums beside it, so that the update reads these alone. Centroids (k * size numbers) travel with the tasks; nothing is
    shuffled but k sums a task, and no cluster is one task's work, whatever its size.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = rows.where((F.size("v") == size) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = good.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), np.zeros((0, size), np.int64)
    centroids = integers(np.array([r["v"] for r in first]), scale)
    path = written(rows.mapInArrow(_packed(size, scale, centroids), _BLOCKS), "blocks")
    spark = vectors.sparkSession
    for _ in range(rounds):
        blocks = spark.read.schema(_BLOCKS).parquet(path)
        centroids = _updated(blocks, centroids)
        before, path = path, written(blocks.select("ids", "q", "cluster").mapInArrow(_moved(centroids), _BLOCKS), "blocks")
        discard(spark, before)
    last = spark.read.schema(_BLOCKS).parquet(path).select("ids", "cluster", "distance")
    out = cut(last.mapInArrow(_flat, "vec_id long, cluster int, distance long"), "assigned")
    discard(spark, path)
    return out, centroids


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings, with each cluster's distances summed and the hash of its centroid."""
    rows, centroids = sort_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    by = rows.groupBy("cluster").agg(exact.alias("d"))
    total = by.agg(F.sum("d")).first()[0]
    texts = spark.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster int, text string")
    by = by.join(texts, "cluster").select("cluster", F.expr("try_cast(d as long)").alias("cluster_inertia"), F.sha2("text", 256).alias("centroid_sha256"))
    inertia = F.lit(None if total is None else str(total)).cast("string")
    return rows.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", inertia.try_cast("long").alias("inertia"), "centroid_sha256")


def _oracle(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Each round as one expression after the other: all distances, the least of them, exact means."""
    parts = [
        f"v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, q FROM v QUALIFY c < {k})",
    ]
    pick = "SELECT rid, vec_id, v.q, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d, c FROM v CROSS JOIN {} c QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1"
    for i in range(rounds):
        parts += [
            f"a{i} AS MATERIALIZED ({pick.format(f'c{i}')})",
            f"e{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{i}) GROUP BY ALL)",
            f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.q, o.q) AS q FROM c{i} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM e{i} GROUP BY c) m USING (c))",
        ]
    parts.append(f"z AS MATERIALIZED ({pick.format(f'c{rounds}')})")
    hashed = f"(SELECT c, sha256(array_to_string(q, ',')) AS h FROM c{rounds})"
    return f"WITH {', '.join(parts)} SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM z JOIN {hashed} USING (c)"


ORACLE = _oracle()
