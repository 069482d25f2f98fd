"""Best-fit packing of tokenised documents by the sum-of-squares rule."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from terrakey.llm.common import cut, small_batches
from terrakey.llm.wordhash import chunks

#: Pieces or open sequences that one task packs.
GROUP = 20_000
#: Words whose ids a worker remembers.
REMEMBERED = 250_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Characters below U+0180 that neither normalisation nor white-space rules of the vocabulary treat specially; any other
# text goes to the library as a whole.
_UNUSUAL = re.compile("[^\t\n\r -~¡-įı-ſ]|<\\|")
_LETTERS = "a-zªµºß-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


class WordCoder:
    """Ids of whole texts as little-endian bytes, with the ids of words seen before taken from memory.

    The vocabulary splits text into words before it merges letters, so a text's ids are those of its words, one after
    the other. Ids of unknown words come from the library, many words at a time; a word ends at the id of a token with
    the end mark.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        # Its merges alone, for words that are split already.
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # Words used of late, and those used before that; what the older ones know moves up when it is met again.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        lines = [" ".join(new[i : i + 500]) for i in range(0, len(new), 500)]
        ids = np.array([x for e in self.merges.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids], "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(new):
            raw, at = ids.tobytes(), 0
            for word, stop in zip(new, (4 * stops).tolist(), strict=True):
                self.known[word] = raw[at:stop]
                at = stop
        else:
            for word in new:
                self.known[word] = self._whole(word)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        parts = [None if _UNUSUAL.search(x) else _WORDS.findall(x.lower()) for x in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        out: list[bytes] = []
        unknown: list[int] = []
        known = self.known.__getitem__
        for i, x in enumerate(parts):
            try:
                out.append(self._whole(texts[i]) if x is None else b"".join(map(known, x)))
            except KeyError:
                out.append(b"")
                unknown.append(i)
        if unknown:
            # Only texts with a word that is not known are looked through for their new words.
            new: set[str] = set()
            for i in unknown:
                new.update(parts[i])
            new.difference_update(self.known)
            again = new.intersection(self.older)
            self.known.update((x, self.older[x]) for x in again)
            new -= again
            if new:
                self._learn(list(new))
            for i in unknown:
                out[i] = b"".join(map(known, parts[i]))
        yield from out


_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each whole text and one ``end_id``, cut into pieces of at most ``capacity`` tokens.

    (doc_id, piece, start, length, ids_crc32), and ``ids`` if wanted. A null text is empty and gives the end id alone.
    Null and repeated ids are kept as they are; every row gives its own pieces.
    """
    step, last = 4 * capacity, np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path).encode
        for batch in batches:
            doc, text = batch.columns
            text = text.fill_null("")
            for a, b, _, _ in chunks(text):
                out: list[tuple] = []
                for i, raw in zip(doc.slice(a, b - a).to_pylist(), encode(text.slice(a, b - a).to_pylist()), strict=True):
                    raw += last
                    for k, at in enumerate(range(0, len(raw), step)):
                        part = raw[at : at + step]
                        out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if with_ids else [])))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the given order.

    With N(g) open bins of residual gap g, an item goes where the sum of the N(g) squared grows least: into an open bin
    that it fits, or a new one. Ties go to the smallest gap left.
    """
    bins, offsets = np.zeros(sizes.size, np.int64), np.zeros(sizes.size, np.int64)
    # By fill level: open bins, the same with none as minus infinity, and the bins themselves.
    after = np.zeros(capacity + 1)
    after[capacity] = -0.5  # a full bin leaves the count
    before = np.full(capacity + 1, -np.inf)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i, s in enumerate(sizes.tolist()):
        level = 0
        if s < capacity:
            growth = after[s + 1 :] - before[1 : capacity - s + 1]
            best = growth.size - 1 - int(np.argmin(growth[::-1]))
            if growth[best] + 1 <= after[s] + 0.5:
                level = best + 1
        if level:
            bins[i] = stacks[level].pop()
            offsets[i] = level
            after[level] -= 1
            before[level] = after[level] or -np.inf
        else:
            bins[i] = made
            made += 1
        if level + s < capacity:
            stacks[level + s].append(bins[i])
            after[level + s] += 1
            before[level + s] = after[level + s]
    return bins, offsets


def packed_well(sizes: np.ndarray, capacity: int, turns: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """``sum_of_squares`` of sizes in falling order, then again of what lies in bins that are not full.

    In a further turn the items of open bins are placed anew in a shuffled order (the same each time), which mixes
    large and small ones; the turn counts if it takes fewer bins.
    """
    bins, offsets = sum_of_squares(sizes, capacity)
    for turn in range(turns):
        loose = np.flatnonzero((np.bincount(bins, sizes) < capacity)[bins])
        order = np.random.default_rng(turn).permutation(loose)
        again, at = sum_of_squares(sizes[order], capacity)
        if not order.size or again.max() + 1 >= np.unique(bins[order]).size:
            continue
        offsets[order] = at
        bins[order] = bins.max() + 1 + again
        bins = np.unique(bins, return_inverse=True)[1]
    return bins, offsets


def _level(level: int, capacity: int):
    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "top"], ascending=[False, True])
        bins, offsets = packed_well(pdf["fill"].to_numpy(), capacity)
        return pd.DataFrame({"old": pdf["top"], "shift": offsets, "new": (level << 56) | (pdf["_g"].to_numpy() << 32) | bins})

    return again


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (columns of ``token_pieces``), with as few sequences as it can.

    Groups of about GROUP pieces, dealt by hash, are packed in parallel (``packed_well``). What a group leaves open
    is packed again as one item, level by level, until one group holds all of it; so hardly more than one sequence in
    the whole stays open for want of partners. A piece longer than ``capacity`` is an error; an empty table gives none.
    """
    with small_batches(pieces.sparkSession):
        pieces = cut(pieces, "pieces")
    n, low = pieces.agg(F.count(F.lit(1)), F.max("length")).first()
    if n and low > capacity:
        raise ValueError(f"a piece of {low} tokens is longer than {capacity}")
    order = ["doc_id", "piece", "ids_crc32"]
    groups = max(1, -(-n // GROUP))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *order], ascending=[False, True, True, True], kind="stable")
        bins, offsets = packed_well(pdf["length"].to_numpy(), capacity)
        return pdf.assign(bin=(pdf["_g"].to_numpy() << 32) | bins, at=offsets).drop(columns="_g")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", bin long, at long"
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64(*order, F.lit(0)), F.lit(groups)))
    packed = cut(dealt.groupBy("_g").applyInPandas(first, schema), "packed")
    fills = packed.groupBy("bin").agg(F.sum("length").alias("fill"))
    places = cut(fills.select("bin", F.lit(0).cast("long").alias("at"), F.col("bin").alias("top"), "fill"), "bins")
    level = 1
    while groups > 1:
        tops = places.groupBy("top").agg(F.max(F.col("at") + F.col("fill")).alias("fill"))
        tops = cut(tops.where(F.col("fill") < capacity), "open")
        n = tops.count()
        fewer = max(1, -(-n // GROUP))

        tops = tops.withColumn("_g", F.pmod(F.xxhash64("top", F.lit(level)), F.lit(fewer)))
        moved = cut(tops.groupBy("_g").applyInPandas(_level(level, capacity), "old long, shift long, new long"), "moved")
        places = places.join(moved, places["top"] == moved["old"], "left")
        places = cut(places.select("bin", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"), F.coalesce("new", "top").alias("top"), "fill"), "bins")
        groups = fewer if fewer < groups else 1
        level += 1
    where = places.select(F.col("bin").alias("_bin"), F.col("at").alias("_at"), "top")
    out = packed.join(where, packed["bin"] == where["_bin"])
    return out.select(*pieces.columns, F.col("top").alias("sequence_id"), (F.col("at") + F.col("_at")).alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """All documents as packed sequences of word_bpe_49k ids."""
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
