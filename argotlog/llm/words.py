"""Words of whole Arrow text columns as 64-bit hashes, found with array operations on the UTF-8 bytes.

A word is a maximal run of word bytes within one text.  All bytes above 0x7F are word bytes, so that multi-byte characters stay
whole and the byte classes are exactly the code-point classes of the operators.  A word's hash is a polynomial over scrambled
bytes, taken from running sums, and a final mix; the same word has the same hash in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from argotlog.session import give_back

U64 = np.uint64

_BASE = 0x9E3779B97F4A7C15 | 1
_SCRAMBLE = np.random.Generator(np.random.PCG64(20_240_607)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
# Bytes of text looked at together: small enough for the processor's cache, so memory does not grow with the batch.
CHUNK_BYTES = 1 << 20

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS_DIGITS = np.zeros(256, dtype=bool)
LETTERS_DIGITS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        base = np.full(size, _BASE, dtype=np.uint64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
        base[1:] = pow(_BASE, -1, 1 << 64)
        _inverses = np.multiply.accumulate(base)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Words:
    """Words of some consecutive texts: ``hash``, byte range ``start``/``end`` in ``data``, and ``first``: word offsets by text."""

    __slots__ = ("_run", "data", "end", "first", "hash", "start", "texts")

    def __init__(self, data, texts, start, end, first, run):
        self.data, self.texts, self.start, self.end, self.first, self._run = data, texts, start, end, first, run
        self.hash = self.hash_of(start, end)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte range."""
        return mix((self._run[end] - self._run[start]) * _inverses[start] + (end - start).astype(np.uint64))

    def beginning(self, n: int) -> np.ndarray:
        """Hash of the first ``n`` bytes of each word; of the whole word where it is shorter."""
        return self.hash_of(self.start, np.minimum(self.end, self.start + n))

    def doc(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "") if column.null_count else column
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, text offsets in them) of runs of whole texts of about ``size`` bytes."""
    if not len(column):
        return
    data, at = _buffers(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        stop = min(stop, len(column))
        yield row, stop, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def spans(data: np.ndarray, texts: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) of the words of the texts whose bytes lie one after the other in ``data``."""
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[:-1] = word_bytes[data]
    opens = np.empty(len(data), dtype=bool)
    if len(data):
        opens[0] = inside[0]
        np.greater(inside[1:-1], inside[:-2], out=opens[1:])
        closes = inside[:-1] > inside[1:]
        edges = texts[:-1][texts[:-1] < texts[1:]]
        opens[edges] = inside[edges] > 0
        last = texts[1:][texts[:-1] < texts[1:]] - 1
        closes[last] = inside[last] > 0
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    else:
        start = end = np.zeros(0, dtype=np.int64)
    return start, end, np.searchsorted(start, texts)


def words(column: pa.Array, word_bytes: np.ndarray, lower: bool = True, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of runs of whole texts; null has no words."""
    for row, stop, data, texts in chunks(column, size):
        data = LOWER[data] if lower else data
        start, end, first = spans(data, texts, word_bytes)
        _grow(len(data) + 1)
        run = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_SCRAMBLE[data] * _powers[: len(data)], out=run[1:])
        yield row, stop, Words(data, texts, start, end, first, run)
    give_back()


_SEATS = [U64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values, also across texts: the caller leaves those out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = (total + hashes[j : j + n] * _SEATS[j % 5]) * U64(0x9E3779B97F4A7C15)
    return mix(total + U64(k))


def shingles_by_text(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text) of the runs of ``k`` words within each text; a shorter text that has words is one run."""
    sizes = np.diff(w.first)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(at[-1], dtype=np.uint64)
    every = shingles(w.hash, k)
    texts = np.flatnonzero(sizes >= k)
    if len(texts):
        text_of = np.repeat(texts, counts[texts])
        place = np.arange(len(text_of)) - np.repeat(np.cumsum(counts[texts]) - counts[texts], counts[texts])
        out[at[text_of] + place] = every[w.first[text_of] + place]
    for text in np.flatnonzero((sizes > 0) & (sizes < k)):
        out[at[text]] = shingles(w.hash[w.first[text] : w.first[text + 1]], int(sizes[text]))[0]
    return out, at


def sorted_sets(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, ascending, and their offsets."""
    out = values.copy()
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[lo:hi].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][at[:-1] < len(out)]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], before[at]
