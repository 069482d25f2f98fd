"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.llm.wordhash import LOOSE, U64, chunks, grams, mix, words

#: Items that one pass over the documents looks for; more items take more passes.
ITEMS_PER_PASS = 20_000
#: Share of an item's words that may be edited.
MAX_EDITS = 0.2
#: Share of embedded symbols taken to differ at that distance, and the recall wanted of the hashing.
DIFFERING, RECALL = 0.5, 0.999
#: Embeddings, and symbols sampled for one hash.
EMBEDDINGS, SAMPLED = 4, 2
HASHES = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DIFFERING) ** SAMPLED) / EMBEDDINGS)
PER_STEP = 4096


def cgk(symbols: np.ndarray, seed: int) -> np.ndarray:
    """CGK random walks of rows of symbols (0 pads): 3n output symbols each.

    At output step j a walk writes its current symbol and moves on if a random bit of (j, symbol) says so. Rows at a
    small edit distance come into step again soon after each edit, so their outputs have a small Hamming distance.
    """
    m, n = symbols.shape
    padded = np.concatenate([symbols, np.zeros((m, 1), U64)], axis=1)
    out = np.empty((3 * n, m), U64)
    at, rows = np.zeros(m, np.int64), np.arange(m)
    keys = mix(np.arange(3 * n, dtype=U64) + (U64(seed) << U64(32)))
    for j in range(3 * n):
        out[j] = padded[rows, at]
        step = ((out[j] ^ keys[j]) * U64(0x9E3779B97F4A7C15) >> U64(63)).astype(np.int64)
        at = np.minimum(at + step, n)
    return out


def lsh_keys(symbols: np.ndarray) -> np.ndarray:
    """Hashes (EMBEDDINGS * HASHES, rows) of symbols sampled from the embeddings."""
    keys = []
    for e in range(EMBEDDINGS):
        out = cgk(symbols, e + 1)
        picks = np.random.default_rng((e, symbols.shape[1])).integers(0, out.shape[0], (HASHES, SAMPLED))
        for pick in picks:
            h = np.zeros(symbols.shape[0], U64)
            for p in pick:
                h = mix(h + out[p])
            keys.append(h)
    return np.array(keys)


def edit_distance(items: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item to a part of its region, row by row, and where the first such part ends."""
    m, width = regions.shape
    steps = np.arange(width + 1, dtype=np.int32)
    last = np.zeros((m, width + 1), np.int32)
    for i in range(items.shape[1]):
        now = np.empty_like(last)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(last[:, :-1] + (regions != items[:, i : i + 1]), last[:, 1:] + 1)
        last = np.minimum.accumulate(now - steps, axis=1) + steps
    return last.min(axis=1), last.argmin(axis=1)


@dataclass
class Class:
    """Items of one length in words."""

    n: int
    edits: int
    items: np.ndarray
    ids: np.ndarray
    hashes: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


@dataclass
class Index:
    """What the tasks need of the items; its size follows the number of items of a pass only."""

    classes: dict[int, Class]
    #: By gram length: sorted hashes, and (class, offset) rows with the first row of each hash.
    anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def build_index(ids: list[int], texts: list[str]) -> Index:
    """Index of a bounded list of items. Items without a word are left out: nothing can be found of them."""
    classes: dict[int, Class] = {}
    found: dict[int, dict[int, set[tuple[int, int]]]] = {}
    column = pa.array(texts, pa.string())
    rows: dict[int, tuple[list, list]] = {}
    for a, _, data, offsets in chunks(column):
        w = words(data, offsets, LOOSE)
        first = np.concatenate([[0], np.cumsum(w.counts)])
        for i, n in enumerate(w.counts.tolist()):
            if n:
                own = rows.setdefault(n, ([], []))
                own[0].append(w.hashes[first[i] : first[i + 1]])
                own[1].append(ids[a + i])
    for n, (hashes, own) in rows.items():
        c = classes[n] = Class(n, int(MAX_EDITS * n), np.array(hashes), np.array(own))
        for key in lsh_keys(c.items):
            order = np.argsort(key, kind="stable")
            c.hashes.append((key[order], order))
        # With k edits one of k + 1 parts of an item is left as it is, so a window without any such part is out of range.
        q = min(4, n // (c.edits + 1))
        for item in hashes:
            h, at = grams(words_like(item), q)
            for x, o in zip(h.tolist(), at.tolist(), strict=True):
                found.setdefault(q, {}).setdefault(x, set()).add((n, o))
    anchors = {}
    for q, by in found.items():
        sorted_h = np.array(sorted(by), U64)
        lists = [sorted(by[x]) for x in sorted_h.tolist()]
        anchors[q] = (sorted_h, np.array([y for x in lists for y in x]).reshape(-1, 2), np.concatenate([[0], np.cumsum([len(x) for x in lists])]))
    return Index(classes, anchors)


def words_like(hashes: np.ndarray):
    """One text's words, of which only the hashes are known."""
    from terrakey.llm.wordhash import Words

    zero = np.zeros(hashes.size, np.int64)
    return Words(hashes, zero, zero, zero, np.array([hashes.size]))


def _windows(w, index: Index) -> dict[int, np.ndarray]:
    """By class: first words of the windows that hold an unedited part of some item where an item could have it."""
    first = np.concatenate([[0], np.cumsum(w.counts)])
    starts: dict[int, list[np.ndarray]] = {}
    for q, (known, rows, bounds) in index.anchors.items():
        h, at = grams(w, q)
        maybe = np.zeros(1 << 20, bool)
        maybe[(known >> U64(44)).astype(np.int64)] = True
        near = np.flatnonzero(maybe[(h >> U64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(known, h[near]), known.size - 1)
        hit = known[place] == h[near]
        at, place = at[near[hit]], place[hit]
        if not at.size:
            continue
        many = bounds[place + 1] - bounds[place]
        which = np.repeat(bounds[place] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        at = np.repeat(at, many)
        for n in np.unique(rows[which, 0]).tolist():
            mine = rows[which, 0] == n
            k = index.classes[n].edits
            s = (at[mine] - rows[which[mine], 1])[:, None] + np.arange(-k, k + 1)
            owner = np.repeat(w.owner[at[mine]], 2 * k + 1)
            s = np.clip(s.ravel(), first[owner], first[owner + 1] - 1)
            starts.setdefault(n, []).append(np.unique(s))
    return {n: np.unique(np.concatenate(x)) for n, x in starts.items()}


def _gather(w, at: np.ndarray, width: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Word hashes from ``at`` on; 0 outside ``low`` to ``high``."""
    cols = at[:, None] + np.arange(width)
    out = w.hashes[np.clip(cols, 0, w.hashes.size - 1)]
    out[(cols < low[:, None]) | (cols >= high[:, None])] = 0
    return out


def find_items(w, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, end word) of the best place of each item in each text of a chunk."""
    first = np.concatenate([[0], np.cumsum(w.counts)])
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for n, all_starts in _windows(w, index).items():
        c = index.classes[n]
        for at in range(0, all_starts.size, PER_STEP):
            s = all_starts[at : at + PER_STEP]
            owner = w.owner[s]
            keys = lsh_keys(_gather(w, s, n, first[owner], first[owner + 1]))
            pairs = []
            for key, (known, order) in zip(keys, c.hashes, strict=True):
                lo, hi = np.searchsorted(known, key), np.searchsorted(known, key, side="right")
                many = hi - lo
                which = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                pairs.append(np.repeat(np.arange(s.size), many) * len(c.ids) + order[which])
            pairs = np.unique(np.concatenate(pairs))
            for b in range(0, pairs.size, PER_STEP):
                win, item = np.divmod(pairs[b : b + PER_STEP], len(c.ids))
                o = w.owner[s[win]]
                far = _gather(w, s[win] - c.edits, n + 2 * c.edits, first[o], first[o + 1])
                dist, end = edit_distance(c.items[item], far)
                for x in np.flatnonzero(dist <= c.edits).tolist():
                    key = (int(o[x]), int(c.ids[item[x]]))
                    now = (int(dist[x]), int(s[win[x]] - c.edits + end[x]), int(item[x]), n)
                    if key not in best or now < best[key]:
                        best[key] = now
    out = []
    for (text, item_id), (dist, end, item, n) in best.items():
        c = index.classes[n]
        low = np.array([first[text]])
        back = _gather(w, np.array([end - n - c.edits]), n + c.edits, low, np.array([end]))[:, ::-1]
        _, length = edit_distance(c.items[item : item + 1, ::-1], back)
        out.append((text, item_id, dist, max(end - int(length[0]), int(first[text])), end))
    return out


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, digest, text = batch.columns
            for a, _, data, offsets in chunks(text):
                w = words(data, offsets, LOOSE)
                rows = []
                for t, item, dist, start, end in find_items(w, index):
                    base = int(offsets[t])
                    chars = [len(data[base : int(x)].tobytes().decode("utf-8", "replace")) for x in (w.starts[start], w.ends[end - 1])]
                    rows.append((doc[a + t].as_py(), digest[a + t].as_py(), item, dist, end - start, *chars))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "item_id", "edits", "n_words", "start", "end"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every (document, benchmark item) with the item in the document: the best place of the item.

    (doc_id, text_hash, item_id, edits, n_words, start, end): edits in words, start and end in code points, end exclusive.
    Texts are compared as lower-case (A-Z) words of letters and digits. An item is in a text if its edit distance to some
    part of it is at most MAX_EDITS of the item's words.

    Windows of each item's length begin at those words where an unedited part of an item could lie (with k edits one of
    k + 1 parts is unedited, so nothing in range is passed over). They and the items are embedded by CGK walks; samples
    of the embedded symbols are hashed so often that a window at the limit shares a hash with its item with probability
    RECALL; each of the many windows about a place has its own chance. Pairs that share a hash are measured exactly.

    Items are taken ITEMS_PER_PASS at a time, each pass with an index of bounded size. Items without a word and null or
    empty texts match nothing. A null item id is taken as -1. Repeated rows give repeated results; an item id that repeats is one item
    with several texts. Other columns are not used. An empty table gives an empty result.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    passes = max(1, -(-items.count() // ITEMS_PER_PASS))
    # Somewhat more parts than needed, as hashing does not deal them out evenly.
    parts = passes if passes == 1 else passes + passes // 4 + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    out = None
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text").collect()
        index = build_index([r.item_id for r in own], [r.text for r in own])
        found = rows.mapInArrow(_search(index), "doc_id long, text_hash long, item_id long, edits int, n_words int, start long, end long")
        out = found if out is None else out.unionByName(found)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items found in all documents."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).drop("text_hash")
