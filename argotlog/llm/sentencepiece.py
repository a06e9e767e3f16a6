"""SentencePiece encoding and decoding of whole texts with a given vocabulary of the BPE kind with byte fallback.

Encoding is by suffix-array matching.  The distinct stretches of a batch of texts (a run of blanks and what follows it; no piece crosses
from one to the next) are concatenated and their suffixes sorted.  A binary search of every piece in them gives its occurrences as one
range.  These are the edges of a graph over the positions; sorted by position, they are relaxed from left to right for all
stretches at once: a piece can end here if it can follow the piece that ends where it begins.  Whether two pieces can stand side by side
is what makes the path the BPE encoding: undoing their merges from the last one on, no merge across their border may come
before the merge that removed it.  The path is unique, and the ids are those of the sequential merge procedure.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argotlog.llm.tables import fresh
from argotlog.llm.words import give_back

BLANK = "▁"
_STRETCH = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
# Characters of texts of which each distinct stretch is encoded once, and of stretches that share a suffix array.
BATCH_CHARS = 2_000_000
INDEX_CHARS = 400_000
_NEVER = np.iinfo(np.int64).max


@dataclass
class Vocabulary:
    """Pieces with their ids, merge ranks (0 for single characters) and scores, and the ids of the bytes."""

    piece: list[str]
    id: np.ndarray
    rank: np.ndarray
    score: dict[str, float]
    byte_id: np.ndarray
    text_of_id: list[bytes]
    pair: np.ndarray = field(default=None)  # sorted keys (left, right) of all merges
    merged: np.ndarray = field(default=None)
    left: np.ndarray = field(default=None)  # last merge of each piece
    right: np.ndarray = field(default=None)

    @property
    def unknown(self) -> int:
        return len(self.piece)

    def merge(self, text: str) -> list[str]:
        """The merge procedure on one stretch: best score first, leftmost of equals.  For vocabularies, runs of blanks, and tests."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


def load(path: str) -> Vocabulary:
    """Read a model file; pieces that the merges never make are left out of the matching."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    score = {model.id_to_piece(i): model.get_score(i) for i in normal}
    byte_id = np.zeros(256, dtype=np.int32)
    text_of_id = [b""] * size
    for i in range(size):
        if model.is_byte(i):
            byte_id[int(model.id_to_piece(i)[3:5], 16)] = i
            text_of_id[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
    for i in normal:
        text_of_id[i] = model.id_to_piece(i).replace(BLANK, " ").encode()
    ids = {model.id_to_piece(i): i for i in normal}
    v = Vocabulary([], np.zeros(0), np.zeros(0), score, byte_id, text_of_id)
    last: dict[str, tuple[str, str]] = {}
    for text in score:
        parts = list(text)
        made: tuple[str, str] | None = None
        while len(parts) > 1:
            options = [(score[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in score]
            if not options:
                break
            i = -max(options)[1]
            made = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 1 and not text.strip(BLANK) == "" or text == BLANK:
            last[text] = made or (text, text)
    v.piece = list(last)
    number = {p: i for i, p in enumerate(v.piece)}
    by_score = sorted({score[p] for p in v.piece if len(p) > 1}, reverse=True)
    rank_of = {s: i + 1 for i, s in enumerate(by_score)}
    v.id = np.array([ids[p] for p in v.piece] or [], dtype=np.int32)
    v.rank = np.array([rank_of[score[p]] if len(p) > 1 else 0 for p in v.piece] + [0], dtype=np.int64)
    v.left = np.array([number.get(last[p][0], i) for i, p in enumerate(v.piece)] + [len(v.piece)], dtype=np.int64)
    v.right = np.array([number.get(last[p][1], i) for i, p in enumerate(v.piece)] + [len(v.piece)], dtype=np.int64)
    pairs = sorted((number[p[:i]] << 20 | number[p[i:]], rank_of[score[p]]) for p in score for i in range(1, len(p)) if p[:i] in number and p[i:] in number and score[p] in rank_of)
    v.pair = np.array([k for k, _ in pairs], dtype=np.int64)
    v.merged = np.array([m for _, m in pairs], dtype=np.int64)
    return v


def can_follow(v: Vocabulary, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Can these pieces stand side by side in an encoding?  Both are taken apart, latest merge first, down to their border."""
    good = np.ones(len(first), dtype=bool)
    row, x, y, limit = np.arange(len(first)), first.astype(np.int64), second.astype(np.int64), np.full(len(first), _NEVER)
    while len(row):
        key = x << 20 | y
        at = np.searchsorted(v.pair, key).clip(max=len(v.pair) - 1)
        bad = (v.pair[at] == key) & (v.merged[at] < limit)
        good[row[bad]] = False
        # Of equal merges the left one comes first, so a merge across the border loses against its equal on the left only.
        take_left = v.rank[x] > v.rank[y]
        limit = np.where(take_left, v.rank[x], v.rank[y] + 1)
        done = bad | ((v.rank[x] == 0) & (v.rank[y] == 0))
        x, y = np.where(take_left, v.right[x], x), np.where(take_left, y, v.left[y])
        keep = ~done
        row, x, y, limit = row[keep], x[keep], y[keep], limit[keep]
    return good


def _suffixes(chars: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` characters that begin there, by doubling ranks."""
    bits = max(1, int(chars.max()).bit_length())
    width = 62 // bits
    padded = np.concatenate([chars, np.zeros(width, dtype=np.int64)])
    key = np.zeros(len(chars), dtype=np.int64)
    for j in range(width):
        key = (key << bits) | padded[j : j + len(chars)]
    known = width
    while True:
        order = np.argsort(key)
        if known >= depth:
            return order
        ordered = key[order]
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        after = np.concatenate([rank[known:], np.zeros(min(known, len(rank)), dtype=np.int64)])[: len(rank)]
        key = (rank << 31) | after
        known *= 2


def _occurrences(chars: np.ndarray, order: np.ndarray, pieces: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (row of characters, 0 beyond its size) the range of the sorted suffixes that begin with it."""
    padded = np.concatenate([chars, np.zeros(pieces.shape[1], dtype=chars.dtype)])

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(pieces), dtype=np.int64), np.full(len(pieces), len(order))
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            at = order[np.minimum(mid, len(order) - 1)]
            sign = np.zeros(len(pieces), dtype=np.int8)  # of the suffix against the piece
            for j in range(pieces.shape[1]):
                live = (sign == 0) & (j < size)
                if not live.any():
                    break
                difference = padded[at + j] - pieces[:, j]
                sign = np.where(live, np.sign(difference).astype(np.int8), sign)
            below = open_ & ((sign <= 0) if after else (sign < 0))
            lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)

    return bound(False), bound(True)


class Encoder:
    """Encodes stretches of text; keeps what it has found out about pairs of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs = np.zeros(0, dtype=np.int64)  # sorted key << 1 | can follow
        self.code = np.concatenate([np.array([ord(c) for c in p], dtype=np.int64) for p in vocabulary.piece] or [np.zeros(0, np.int64)])
        self.size = np.array([len(p) for p in vocabulary.piece], dtype=np.int64)

    def _can_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key, back = np.unique(first << 20 | second, return_inverse=True)
        at = np.searchsorted(self.pairs, key << 1)
        at = np.minimum(at, max(len(self.pairs) - 1, 0))
        known = self.pairs[at] >> 1 == key if len(self.pairs) else np.zeros(len(key), bool)
        new = key[~known]
        answer = np.empty(len(key), dtype=bool)
        if known.any():
            answer[known] = self.pairs[at[known]] & 1
        if len(new):
            answer[~known] = can_follow(self.v, new >> 20, new & 0xFFFFF)
            if len(self.pairs) > 1_000_000:
                self.pairs = self.pairs[:0]
            self.pairs = np.sort(np.concatenate([self.pairs, new << 1 | answer[~known]]))
        return answer[back]

    def encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by stretch)."""
        group = np.cumsum([0, *map(len, stretches)])[:-1] // INDEX_CHARS
        edges = [*np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist(), len(stretches)] if len(group) else [0]
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            got, at = self._encode(stretches[a:b])
            ids.append(got)
            sizes.append(np.diff(at))
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        v = self.v
        by_hand = {i: self._by_hand(s) for i, s in enumerate(stretches) if s.startswith(BLANK * 2)}
        lengths = np.array([0 if i in by_hand else len(s) for i, s in enumerate(stretches)], dtype=np.int64)
        code = np.frombuffer("".join(s if i not in by_hand else "" for i, s in enumerate(stretches)).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        start = np.cumsum(lengths) - lengths
        n = len(code)
        end_piece = np.full(n + 1, -1, dtype=np.int64)  # piece that ends before this position on the path
        if n:
            alphabet, chars = np.unique(code, return_inverse=True)
            chars = chars.astype(np.int64) + 1
            place = np.searchsorted(alphabet, self.code).clip(max=len(alphabet) - 1)
            there = alphabet[place] == self.code
            first = np.cumsum(self.size) - self.size
            usable = np.flatnonzero(np.logical_and.reduceat(there, first))
            width = int(self.size[usable].max()) if len(usable) else 1
            at = first[usable][:, None] + np.arange(width)
            used = np.arange(width) < self.size[usable][:, None]
            pieces = np.where(used, place[np.minimum(at, len(place) - 1)] + 1, 0)
            order = _suffixes(chars, width)
            lo, hi = _occurrences(chars, order, pieces, self.size[usable])
            count = hi - lo
            owner = np.repeat(np.arange(len(usable), dtype=np.int32), count)
            begin = order.astype(np.int32)[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo, count)]
            piece = usable.astype(np.int32)[owner]
            del order, owner
            # A character that is no piece is an edge of its own.
            single = np.zeros(len(alphabet) + 1, dtype=bool)
            ones = usable[self.size[usable] == 1]
            single[place[first[ones]] + 1] = True
            odd = np.flatnonzero(~single[chars])
            begin, piece = np.concatenate([begin, odd.astype(np.int32)]), np.concatenate([piece, np.full(len(odd), v.unknown, np.int32)])
            size = np.append(self.size, 1).astype(np.int32)[piece]
            owner_of = np.repeat(np.arange(len(lengths)), lengths)
            offset = (np.arange(n) - start[owner_of]).astype(np.int32)
            inside = offset[begin] + size <= lengths[owner_of].astype(np.int32)[begin]
            begin, piece, size = begin[inside], piece[inside], size[inside]
            finish = offset[begin] + size
            by = np.argsort(finish.astype(np.uint16) if n < 1 << 16 or finish.max() < 1 << 16 else finish, kind="stable")
            begin, piece, size, finish = begin[by], piece[by], size[by], finish[by]
            steps = np.flatnonzero(np.concatenate([[True], finish[1:] != finish[:-1], [True]]))
            # end_piece is kept at the position of the last character
            last = np.full(n, -1, dtype=np.int64)
            for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
                at, what, long_ = begin[a:b], piece[a:b], size[a:b]
                before = np.where(offset[at] > 0, last[at - 1], -2)
                good = before == -2
                rest = np.flatnonzero(before >= 0)
                good[rest] = self._can_follow(before[rest], what[rest].astype(np.int64))
                last[at[good] + long_[good] - 1] = what[good]
            end_piece = last
        return self._collect(stretches, by_hand, lengths, start, code, end_piece)

    def _by_hand(self, stretch: str) -> list[int]:
        """Ids by the merge procedure, where merges of equal score meet: a long run of blanks."""
        ids_of = self.ids_by_text
        out: list[int] = []
        for part in self.v.merge(stretch):
            out += [ids_of[part]] if part in ids_of else [int(self.v.byte_id[b]) for b in part.encode("utf-8", "surrogatepass")]
        return out

    @property
    def ids_by_text(self) -> dict[str, int]:
        if not hasattr(self, "_ids"):
            of_bytes = set(self.v.byte_id.tolist())
            self._ids = {t.decode().replace(" ", BLANK): i for i, t in enumerate(self.v.text_of_id) if t and i not in of_bytes}
        return self._ids

    def _collect(self, stretches, by_hand, lengths, start, code, last) -> tuple[np.ndarray, np.ndarray]:
        """Walk all paths back from their ends at once, then put the ids in order."""
        v = self.v
        sizes = np.append(self.size, 1)
        at = np.flatnonzero(lengths)
        position = start[at] + lengths[at] - 1
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            piece = last[position]
            steps.append((at, position, piece))
            position = position - sizes[piece]
            more = position >= start[at]
            at, position = at[more], position[more]
        if steps:
            owner, position, piece = (np.concatenate(x) for x in zip(*steps, strict=True))
            by = np.argsort(position)
            owner, position, piece = owner[by], position[by], piece[by]
        else:
            owner = position = piece = np.zeros(0, dtype=np.int64)
        odd = piece == v.unknown
        ids = np.append(v.id, 0)[piece].astype(np.int32)
        width = np.ones(len(piece), dtype=np.int64)
        if odd.any():
            c = code[position[odd]]
            width[odd] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        count = np.bincount(owner, weights=width, minlength=len(stretches)).astype(np.int64)
        for i, found in by_hand.items():
            count[i] = len(found)
        offsets = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(offsets[-1], dtype=np.int32)
        within = np.cumsum(width) - width
        first_of = np.searchsorted(owner, np.arange(len(stretches)))
        base = np.where(first_of < len(within), within[np.minimum(first_of, max(len(within) - 1, 0))], 0) if len(within) else np.zeros(len(stretches), np.int64)
        target = offsets[owner] + within - base[owner]
        out[target[~odd]] = ids[~odd]
        for t, c in zip(target[odd].tolist(), code[position[odd]].tolist(), strict=True):
            raw = chr(c).encode("utf-8", "surrogatepass")
            out[t : t + len(raw)] = v.byte_id[list(raw)]
        for i, found in by_hand.items():
            out[offsets[i] : offsets[i + 1]] = found
        return out, offsets


def _encode_texts(encoder: Encoder, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by text) of some texts: each distinct stretch is encoded once."""
    number: dict[str, int] = {}
    found: list[int] = []
    counts = []
    for text in texts:
        parts = _STRETCH.findall(BLANK + text.replace(" ", BLANK)) if text else []
        found += [number.setdefault(p, len(number)) for p in parts]
        counts.append(len(parts))
    ids, at = encoder.encode(list(number))
    stretch = np.array(found, dtype=np.int64)
    size = at[stretch + 1] - at[stretch]
    end = np.cumsum(size)
    out = ids[np.arange(end[-1] if len(end) else 0) - np.repeat(end - size - at[stretch], size)]
    return out, np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)])]


class Decoder:
    """Bytes of ids; U+FFFD for ids outside the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        texts = [*vocabulary.text_of_id, "\ufffd".encode()]
        self.other = len(texts) - 1
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def raw(self, ids: np.ndarray) -> bytes:
        ids = np.where((ids < 0) | (ids >= self.other), self.other, ids)
        n = self.size[ids]
        end = np.cumsum(n)
        return self.pool[np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[ids] - end + n, n)].tobytes()

    def text(self, ids: np.ndarray) -> str:
        return self.raw(ids).removeprefix(b" ").decode("utf-8", "replace")


def encoded(spark, vocabulary: Vocabulary, text: Column) -> Column:
    """(ids: of the whole text; same: do they decode to it?); null stays null ids, the empty text has none."""
    sent = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = Encoder(sent.value), Decoder(sent.value)
        for column in columns:
            sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy()
            group = np.cumsum(sizes) // BATCH_CHARS
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(1, np.int64)
            ids, offsets, same, before = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [], 0
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(column)], strict=True):
                texts = column.slice(a, b - a).to_pylist()
                got, at = _encode_texts(encoder, texts)
                same += [t is None or decoder.text(got[lo:hi]) == t for t, lo, hi in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)]
                offsets.append(at[1:] + before)
                ids.append(got)
                before += len(got)
            at = np.concatenate(offsets).astype(np.int32)
            at = pa.array(at, mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False)) if column.null_count else at
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids))), pa.array(same, pa.bool_())], names=["ids", "same"])
            del ids, offsets, got, at, same, texts
            give_back()

    return encode(text)


def decoded(spark, vocabulary: Vocabulary, ids: Column) -> Column:
    """The text of arrays of ids: the bytes of all pieces, without the blank put before the text.  Bytes that are no UTF-8 become
    U+FFFD, as do ids outside the vocabulary; null stays null."""
    sent = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(sent.value)
        for column in columns:
            out = [decoder.text(row.values.fill_null(-1).to_numpy()) if row.is_valid else None for row in column]
            yield pa.array(out, pa.string())
            del out
            give_back()

    return decode(ids)


def tokenized(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``same``: does decoding give the text back?

    Null texts have null ids, no tokens and are the same; empty ones have no ids.  Only a text with U+2581 in it comes back changed, as
    blanks.  Columns that bear the new names already are replaced; rows stay as they are, however often repeated.
    """
    spark = docs.sparkSession
    name = fresh(docs.columns, "_ids")[0]
    found = docs.withColumn(name, encoded(spark, vocabulary, F.col(f"`{text}`").cast("string")))
    ids = F.col(name)["ids"]
    return found.withColumns({"ids": ids, "n_tokens": F.when(ids.isNull(), F.lit(0)).otherwise(F.size(ids)).cast("bigint"), "same": F.col(name)["same"]}).drop(name)
