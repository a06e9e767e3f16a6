"""A shard of token ids as a wavelet matrix in one compressed file: access, counting and occurrence lookup without unpacking the whole.

The ids are written bit by bit, highest bit first.  Plane ``b`` holds bit ``b`` of every id in the order that the planes above leave them in:
zeros before ones, each in their former order.  A plane is cut into blocks that are compressed one by one; the number of ones before each
block is stored, so the rank of a place costs one block, and following an id through all planes costs one block in each.

File: fixed head, document table (ids, which of them are null, ends), then for every plane its number of zeros, ones before each block, size of
each packed block, and the packed blocks.  Bytes after that are not looked at.  All numbers are little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

MAGIC = b"WVMX"
# magic, version, planes, tokens, documents, part, number within the part, bits of a block, bytes of the packed document table
_HEAD = struct.Struct("<4sHHqqqqqq")
BLOCK_BITS = 1 << 16
_CODEC = "zstd"


def _pack(data: bytes) -> bytes:
    return pa.compress(data, codec=_CODEC, asbytes=True)


def _unpack(data, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec=_CODEC, asbytes=True) if size else b""


def encode(ids: np.ndarray, ends: np.ndarray, keys: np.ndarray, null: np.ndarray, part: int = 0, seq: int = 0) -> bytes:
    """The file of ``ids``: documents end before ``ends`` and are called ``keys``, or null where ``null`` says so."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    documents = _pack(np.asarray(keys, "<i8").tobytes() + np.asarray(ends, "<i8").tobytes() + np.packbits(null).tobytes()) if len(keys) else b""
    out = [_HEAD.pack(MAGIC, 1, planes, len(ids), len(keys), part, seq, BLOCK_BITS, len(documents)), documents]
    row = ids.astype(np.uint16) if planes <= 16 else ids
    for bit in range(planes - 1, -1, -1):
        one = (row >> row.dtype.type(bit)) & row.dtype.type(1) != 0
        packed = np.packbits(one).tobytes()
        step = BLOCK_BITS // 8
        blocks = [_pack(packed[at : at + step]) for at in range(0, len(packed), step)]
        high = np.flatnonzero(one)
        ones = np.searchsorted(high, np.append(np.arange(0, len(one), BLOCK_BITS), len(one)))
        out += [struct.pack("<q", len(one) - int(ones[-1])), ones.astype("<i8").tobytes(), np.array([len(b) for b in blocks], "<i4").tobytes(), *blocks]
        row = np.concatenate([row[np.flatnonzero(~one)], row[high]])
    return b"".join(out)


class Shard:
    """A file of ``encode``, read in place: only the blocks that a question touches are unpacked, and kept while the shard is."""

    def __init__(self, data):
        self._data = data = memoryview(data)
        magic, version, self.planes, self.n_tokens, self.n_docs, self.part, self.seq, self._bits, size = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size
        n = self.n_docs
        table = _unpack(data[at : at + size], 16 * n + (n + 7) // 8)
        self.keys, self.ends = np.frombuffer(table, "<i8", n), np.frombuffer(table, "<i8", n, 8 * n)
        self.null = np.unpackbits(np.frombuffer(table, np.uint8, -1, 16 * n), count=n).astype(bool)
        at += size
        blocks = -(-self.n_tokens // self._bits)
        self._zeros, self._ones, self._at = [], [], []
        for _ in range(self.planes):
            self._zeros.append(struct.unpack_from("<q", data, at)[0])
            self._ones.append(np.frombuffer(data, "<i8", blocks + 1, at + 8))
            sizes = np.frombuffer(data, "<i4", blocks, at + 16 + 8 * blocks)
            begin = at + 16 + 12 * blocks
            self._at.append(begin + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
            at = int(self._at[-1][-1])
        self._open: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if self.n_docs else np.zeros(0, np.int64)

    def _raw(self, plane: int, block: int) -> bytes:
        at = self._at[plane]
        bits = min(self._bits, self.n_tokens - block * self._bits)
        return _unpack(self._data[at[block] : at[block + 1]], (bits + 7) // 8)

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(bits, ones before each of them) of a block."""
        found = self._open.get((plane, block))
        if found is None:
            bits = np.unpackbits(np.frombuffer(self._raw(plane, block), np.uint8), count=min(self._bits, self.n_tokens - block * self._bits))
            found = self._open[plane, block] = (bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]))
        return found

    def _look(self, plane: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit at, ones before) each place; a place may be the end, where there is no bit."""
        bit, ones = np.zeros(len(places), np.int64), np.empty(len(places), np.int64)
        number = places // self._bits
        for block in np.unique(number):
            here = number == block
            if block * self._bits >= self.n_tokens:
                ones[here] = self._ones[plane][-1]
                continue
            bits, before = self._block(plane, int(block))
            inside = places[here] - block * self._bits
            ones[here] = self._ones[plane][block] + before[inside]
            bit[here] = bits[np.minimum(inside, len(bits) - 1)]
        return bit, ones

    def access(self, places: Iterable[int]) -> np.ndarray:
        """The ids at ``places``."""
        at = np.asarray(places, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n_tokens):
            raise IndexError("no such place in the shard")
        ids = np.zeros(len(at), np.int64)
        for plane in range(self.planes):
            bit, ones = self._look(plane, at)
            ids = 2 * ids + bit
            at = np.where(bit == 1, self._zeros[plane] + ones, at - ones)
        return ids

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among the places ``low`` to ``high`` lie below the last plane."""
        if token < 0 or token >> self.planes:
            return 0, 0
        ends = np.array([low, high], np.int64)
        for plane in range(self.planes):
            _, ones = self._look(plane, ends)
            ends = self._zeros[plane] + ones if token >> (self.planes - 1 - plane) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often ``token`` occurs from place ``low`` up to, not with, ``high``."""
        a, b = self._range(token, low, self.n_tokens if high is None else high)
        return b - a

    def occurrences(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """The places of ``token`` in ascending order."""
        a, b = self._range(token, low, self.n_tokens if high is None else high)
        at = np.arange(a, b, dtype=np.int64)
        for plane in range(self.planes - 1, -1, -1):
            one = bool(token >> (self.planes - 1 - plane) & 1)
            at = self._select(plane, one, at - self._zeros[plane] if one else at)
        return at

    def _select(self, plane: int, one: bool, ranks: np.ndarray) -> np.ndarray:
        """Place of the bit that has ``ranks`` like ones before it."""
        if not len(ranks):
            return ranks
        ones = self._ones[plane]
        counts = ones if one else np.minimum(np.arange(len(ones)) * self._bits, self.n_tokens) - ones
        number = np.searchsorted(counts, ranks, side="right") - 1
        out = np.empty(len(ranks), np.int64)
        for block in np.unique(number):
            here = number == block
            bits, _ = self._block(plane, int(block))
            out[here] = block * self._bits + np.flatnonzero(bits == one)[ranks[here] - counts[block]]
        return out

    def tokens(self) -> np.ndarray:
        """All ids in order."""
        ids = np.zeros(self.n_tokens, np.uint16 if self.planes <= 16 else np.uint32)
        blocks = -(-self.n_tokens // self._bits)
        for plane in range(self.planes - 1, -1, -1):
            raw = b"".join(self._raw(plane, block) for block in range(blocks))
            one = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n_tokens).astype(bool)
            above = np.empty_like(ids)
            zeros = self._zeros[plane]
            above[np.flatnonzero(~one)] = ids[:zeros]
            above[np.flatnonzero(one)] = ids[zeros:] | ids.dtype.type(1 << (self.planes - 1 - plane))
            ids = above
        return ids.astype(np.uint32)
