"""Vectorised word and shingle hashing of whole texts, used inside tasks.

A batch of texts is taken as one byte buffer. Words are runs of bytes outside a separator set; a word's hash is a
polynomial in its (mapped) bytes, taken from running sums, so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = pow(0x9E3779B97F4A7C15, 1, 1 << 64) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Shingle hashes keep this many bits, so that a text's number in its chunk fits beside them in one sortable word.
HASH_BITS = 52
MAX_TEXTS = 1 << (64 - HASH_BITS)
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_tables(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    is_sep = np.zeros(256, dtype=bool)
    is_sep[list(separators)] = True
    fold = np.arange(256, dtype=np.uint64)
    if lower:
        fold[65:91] = fold[97:123]
    return is_sep, mix(fold + U64(1))


_SPACES = bytes([0x20, 9, 10, 11, 12, 13])
_PUNCTUATION = bytes(i for i in range(33, 127) if not chr(i).isalnum())
#: Words as the contracts have them, A-Z in lower case.
PLAIN = _byte_tables(_SPACES, lower=True)
#: Words of letters and digits only: ASCII marks separate words too, so that reformatting does not matter.
LOOSE = _byte_tables(_SPACES + _PUNCTUATION, lower=True)

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if _powers[0].size < n:
        size = max(n, CHUNK_BYTES * 2)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """The words of a chunk of texts: hash, first byte, end byte and text number of each; word counts by text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    counts: np.ndarray


def chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a column into runs of whole texts of about CHUNK_BYTES: (first, end, bytes, offsets). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, at + 1), at + MAX_TEXTS, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray] = PLAIN) -> Words:
    """The words of a chunk, hashed."""
    is_sep, value = tables
    n_texts = offsets.size - 1
    none = np.zeros(0, np.int64)
    if not data.size:
        return Words(np.zeros(0, U64), none, none, none, np.zeros(n_texts, np.int64))
    inside = ~is_sep[data]
    first = np.zeros(data.size + 1, bool)
    first[offsets] = True
    after_gap = np.empty(data.size, bool)
    after_gap[0] = True
    np.logical_not(inside[:-1], out=after_gap[1:])
    starts = np.flatnonzero(inside & (after_gap | first[:-1]))
    before_gap = np.empty(data.size, bool)
    before_gap[-1] = True
    np.logical_not(inside[1:], out=before_gap[:-1])
    ends = np.flatnonzero(inside & (before_gap | first[1:])) + 1
    power, inverse = _power_arrays(data.size)
    sums = np.zeros(data.size + 1, U64)
    np.cumsum(value[data] * power, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    hashes = mix(hashes + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    return Words(hashes, starts, ends, np.repeat(np.arange(n_texts), counts), counts)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a text, and the number of each run's first word."""
    n = w.hashes.size
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.full(n - k + 1, U64(k), U64)
    for j in range(k):
        h = h * U64(0x9FB21C651E98DF25) + w.hashes[j : n - k + 1 + j]
    same = w.owner[: n - k + 1] == w.owner[k - 1 :]
    return mix(h[same]), np.flatnonzero(same)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles by text: sorted hashes of HASH_BITS bits, and their number in each text.

    A text of fewer words, but one, has its whole sequence as its only shingle.
    """
    h, at = grams(w, k)
    owner = w.owner[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if short.size:
        first = np.searchsorted(w.owner, short)
        whole = np.empty(short.size, U64)
        for i, (a, n) in enumerate(zip(first.tolist(), w.counts[short].tolist(), strict=True)):
            x = U64(n)
            with np.errstate(over="ignore"):
                for y in w.hashes[a : a + n]:
                    x = x * U64(0x9FB21C651E98DF25) + y
            whole[i] = x
        h, owner = np.concatenate([h, mix(whole)]), np.concatenate([owner, short])
    keyed = np.sort((owner.astype(U64) << U64(HASH_BITS)) | (h >> U64(64 - HASH_BITS)))
    if keyed.size:
        keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
    counts = np.bincount((keyed >> U64(HASH_BITS)).astype(np.int64), minlength=w.counts.size)
    return keyed & U64((1 << HASH_BITS) - 1), counts


def signatures(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, list[bytes | None]]:
    """MinHash signatures (texts x size, 32-bit; rows of empty sets are 0) and a 128-bit key of each set's content."""
    full = np.flatnonzero(counts > 0)
    sig = np.zeros((counts.size, size), np.uint32)
    keys: list[bytes | None] = [None] * counts.size
    if not full.size:
        return sig, keys
    first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    seeds = mix(np.arange(1, size + 1, dtype=U64) * U64(0xA0761D6478BD642F))
    for j in range(size):
        x = (hashes ^ (seeds[j] >> U64(1))) * (seeds[j] | U64(1))
        x = (x ^ (x >> U64(29))) * U64(0x94D049BB133111EB)
        sig[full, j] = np.minimum.reduceat((x >> U64(32)).astype(np.uint32), first)
    both = np.empty((full.size, 2), U64)
    both[:, 0] = np.add.reduceat(mix(hashes + U64(0x1D8E4E27C47D124F)), first)
    both[:, 1] = np.add.reduceat(mix(hashes * U64(0xE7037ED1A0B428DB) + U64(1)), first)
    raw = both.tobytes()
    for i, at in enumerate(full.tolist()):
        keys[at] = raw[16 * i : 16 * i + 16]
    return sig, keys
