"""Benchmark decontamination with a positional inverted index of the training texts.

The index is partitioned by document: a segment holds, for some thousands of whole texts, each distinct token with the ascending
list of its positions.  A phrase is looked up within each segment: the list of its rarest token gives candidate places, and the
lists of its other tokens, moved by their offsets, are intersected with them one by one, rarest first.  Nothing is shuffled to build
or to search the index, and a token that is in every text costs no more than its share of each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argotlog.llm.tables import drop, fresh, table
from argotlog.llm.words import LETTERS_DIGITS, words

# Texts of a segment, and test texts sent to all tasks at once, in bytes; a segment or block is at least one text.
SEGMENT_BYTES = 1 << 23
BLOCK_BYTES = 1 << 22
# Candidate places looked at together.
CANDIDATES = 1 << 20


def build_index(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """A table of segments: ``carry`` and number of words of its texts, first position of each text, tokens, their postings.

    Null, empty and wordless texts are part of a segment with 0 words.  Positions count on through the texts of a segment.
    """
    names = [f"c{i}" for i in range(len(carry))]
    fields = docs.select(*carry).schema
    columns = ", ".join(f"{n} array<{f.dataType.simpleString()}>" for n, f in zip(names, fields, strict=True))
    schema = f"segment bigint, {columns}, n_words array<bigint>, token binary, list binary, position binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 33
        kept, hashes, sizes, used = [], [], [], 0

        def segment_row() -> pa.RecordBatch:
            every = np.concatenate(hashes)
            order = np.argsort(every, kind="stable")
            ordered = every[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(every) else np.zeros(0, np.int64)
            lists = np.append(first, len(every)).astype(np.int32)
            whole = pa.Table.from_batches(kept).combine_chunks()
            n = np.concatenate(sizes)
            one = np.array([0, len(n)], dtype=np.int32)
            arrays = [pa.ListArray.from_arrays(one, whole.column(i).combine_chunks()) for i in range(len(names))]
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (ordered[first], lists, order.astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([segment]), *arrays, pa.ListArray.from_arrays(one, pa.array(n, pa.int64())), *packed], names=["segment", *names, "n_words", "token", "list", "position"])

        for b in batches:
            for row, stop, w in words(b.column(len(names)), LETTERS_DIGITS):
                kept.append(b.slice(row, stop - row).select(list(range(len(names)))))
                hashes.append(w.hash)
                sizes.append(np.diff(w.first))
                used += len(w.data)
                if used >= SEGMENT_BYTES:
                    yield segment_row()
                    kept, hashes, sizes, used, segment = [], [], [], 0, segment + 1
        if kept:
            yield segment_row()

    chosen = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)), F.col(f"`{text}`").cast("string").alias(fresh(names, "text")[0]))
    return table(chosen.mapInArrow(run, schema), "index", "zstd")


def documents_of(index: DataFrame, carry: list[str]) -> DataFrame:
    """(segment, at, ``carry``, n_words) of all texts of the index."""
    names = [f"c{i}" for i in range(len(carry))]
    rows = index.select("segment", F.posexplode(F.arrays_zip(*names, "n_words")).alias("at", "doc"))
    return rows.select("segment", "at", *(F.col("doc")[n].alias(c) for n, c in zip(names, carry, strict=True)), F.col("doc")["n_words"].alias("n_words"))


class _Segment:
    """One segment of the index, and lists of wanted tokens in it."""

    def __init__(self, n_words: np.ndarray, token: bytes, lists: bytes, position: bytes, wanted: np.ndarray):
        self.token, self.list, self.position = np.frombuffer(token, np.uint64), np.frombuffer(lists, np.int32), np.frombuffer(position, np.int32)
        self.first = np.concatenate([[0], np.cumsum(n_words)])
        if len(self.token):
            place = np.searchsorted(self.token, wanted).clip(max=len(self.token) - 1)
            there = self.token[place] == wanted
        else:
            place, there = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        self.lo = np.where(there, self.list[place], 0).astype(np.int64)
        self.n = np.where(there, self.list[np.minimum(place + 1, len(self.list) - 1)] - self.list[place], 0).astype(np.int64)

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def search(self, token: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Where in the postings of each ``token`` the first position not below ``position`` is: a binary search in all lists at once."""
        lo, hi = self.lo[token], self.lo[token] + self.n[token]
        end = hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return np.where(lo < end, lo, -1)
            mid = (lo + hi) >> 1
            below = open_ & (self.position[np.minimum(mid, len(self.position) - 1)] < position)
            lo = np.where(below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)

    def has(self, token: np.ndarray, position: np.ndarray) -> np.ndarray:
        at = self.search(token, position)
        return (at >= 0) & (self.position[at] == position)


def _runs(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, index) of every element of the runs ``lo .. lo + n``."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[owner]


def _phrases(s: _Segment, phrase: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase number, first position) of all places of the phrases: rows of token numbers, ``size`` of them used."""
    used = np.arange(phrase.shape[1]) < size[:, None]
    often = np.where(used, s.n[phrase], np.iinfo(np.int64).max)
    there = np.flatnonzero((often > 0).all(axis=1))
    rank = np.argsort(often[there], axis=1, kind="stable")
    begin = 0
    total = np.cumsum(often[there, rank[:, 0]]) if len(there) else np.zeros(0, np.int64)
    while begin < len(there):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + CANDIDATES, side="right")))
        rows, ranks = there[begin:stop], rank[begin:stop]
        begin = stop
        rarest = ranks[:, 0]
        owner, at = _runs(s.lo[phrase[rows, rarest]], s.n[phrase[rows, rarest]])
        start = s.position[at].astype(np.int64) - rarest[owner]
        last = start + size[rows][owner] - 1
        good = (start >= 0) & (last < s.first[-1])
        owner, start, last = owner[good], start[good], last[good]
        good = s.doc(start) == s.doc(last)
        owner, start = owner[good], start[good]
        for j in range(1, phrase.shape[1]):
            if not len(start):
                break
            offset = ranks[owner, j]
            token = phrase[rows[owner], offset]
            good = (offset >= size[rows[owner]]) | s.has(token, start + offset)
            owner, start = owner[good], start[good]
        yield rows[owner], start


def _near(s: _Segment, phrase: np.ndarray, size: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase number, position of its rarest token) where all its tokens are within ``distance`` words of it in the same text."""
    for i in range(len(phrase)):
        tokens = np.unique(phrase[i, : size[i]])
        tokens = tokens[np.argsort(s.n[tokens], kind="stable")]
        if not s.n[tokens[0]]:
            continue
        lo = s.lo[tokens[0]]
        here = s.position[lo : lo + s.n[tokens[0]]].astype(np.int64)
        for token in tokens[1:]:
            doc = s.doc(here)
            low, high = np.maximum(here - distance, s.first[doc]), np.minimum(here + distance, s.first[doc + 1] - 1)
            at = s.search(np.full(len(here), token), low)
            here = here[(at >= 0) & (s.position[at] <= high)]
        yield np.full(len(here), i), here


def _blocks(items: DataFrame, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(item ids, tokens, phrases as token numbers, their sizes with the item's number) of bounded blocks of the test items."""
    texts = table(items.where("text is not null").distinct(), "items")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        ids, phrases, owner, sizes = [r["item_id"] for r in rows], [], [], []
        for row, _, w in words(pa.array([r["text"] for r in rows], pa.large_string()), LETTERS_DIGITS):
            for i in range(len(w.first) - 1):
                h = w.hash[w.first[i] : w.first[i + 1]]
                k = min(window, len(h))
                if k:
                    part = np.lib.stride_tricks.sliding_window_view(h, k)
                    phrases.append(np.pad(part, ((0, 0), (0, window - k)), mode="edge"))
                    owner.append(np.full(len(part), row + i))
                    sizes.append(np.full(len(part), k))
        if phrases:
            every = np.concatenate(phrases)
            tokens, number = np.unique(every, return_inverse=True)
            yield np.array(ids, dtype=object), tokens, number.reshape(every.shape), np.stack([np.concatenate(sizes), np.concatenate(owner)])


def matches(index: DataFrame, items: DataFrame, window: int = 10, within: int | None = None) -> DataFrame:
    """Where the ``window``-word phrases of ``items`` (item_id, text) occur in the texts of ``index``.

    One row per text and item with a match: segment, at, item_id (as text; null is the empty one), ``starts`` and ``ends`` (end after
    the last word) of the merged stretches of words, counted within the text.  With ``within``, a phrase matches where each of its words is at most so
    many words from an occurrence of its rarest one; a stretch is then that occurrence.  Items without words have no phrase.
    """
    spark = index.sparkSession
    found, broadcasts = None, []
    schema = "segment bigint, at int, item_id string, starts array<int>, ends array<int>"
    chosen = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    for block in _blocks(chosen, window):
        sent = spark.sparkContext.broadcast(block)
        broadcasts.append(sent)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, tokens, phrase, (size, owner) = sent.value
            for b in batches:
                for row in range(b.num_rows):
                    sizes = b.column(1)[row].values.to_numpy()
                    s = _Segment(sizes, *(b.column(i)[row].as_buffer() for i in (2, 3, 4)), tokens)
                    places = _phrases(s, phrase, size) if within is None else _near(s, phrase, size, within)
                    hits = [(owner[p], start, size[p] if within is None else np.ones(len(p), np.int64)) for p, start in places if len(p)]
                    if hits:
                        item, start, n = (np.concatenate(x) for x in zip(*hits, strict=True))
                        yield _merged(b.column(0)[row].as_py(), s, ids, item, start, start + n)

        part = index.select("segment", "n_words", "token", "list", "position").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    out = table(found if found is not None else spark.createDataFrame([], schema), "matches")
    for sent in broadcasts:
        sent.destroy()
    return out


def _merged(segment: int, s: _Segment, ids: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Stretches of one item in one text, merged where they touch; positions within the text."""
    doc = s.doc(start)
    order = np.lexsort((start, item, doc))
    doc, item, start, end = doc[order], item[order], start[order], end[order]
    group = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    number = np.cumsum(group)
    shift = number * (s.first[-1] + 1)  # keeps the running maximum within a group
    reach = np.maximum.accumulate(end + shift) - shift
    opens = np.concatenate([[True], group[1:] | (start[1:] > reach[:-1])])
    begins = np.flatnonzero(opens)
    closes = np.append(begins[1:], len(start)) - 1
    heads = np.flatnonzero(group[begins])
    at = np.append(heads, len(begins)).astype(np.int32)
    base = s.first[doc[begins]]
    rows = begins[heads]
    lists = [pa.ListArray.from_arrays(at, pa.array(x - base, pa.int32())) for x in (start[begins], reach[closes])]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), segment)), pa.array(doc[rows], pa.int32()), pa.array(ids[item[rows]], pa.string()), *lists], names=["segment", "at", "item_id", "starts", "ends"])


def _words_hit(spans: Column) -> Column:
    """Number of words in the union of sorted (start, end) spans."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("bigint"), x["end"] - F.greatest(a["upto"], x["start"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")),
    )
    return step["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), window: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``carry``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    Words are runs of letters (A-Z lower-cased), digits and all non-ASCII characters.  A window is ``window`` consecutive words of an
    item, or all of a shorter one; a document word within any occurrence of a window is hit.  Null and wordless texts have no words and no
    hits, null and wordless items no windows; items of the same id are one item.  Repeated rows and null ids stay as they are.
    """
    index = build_index(docs, text, list(carry))
    hits = matches(index, benchmark.select("item_id", "text"), window)
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(x["starts"].cast("bigint").alias("start"), x["ends"].cast("bigint").alias("end")))
    by_doc = hits.groupBy("segment", "at").agg(F.sort_array(F.flatten(F.collect_list(spans))).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = documents_of(index, list(carry)).join(by_doc, ["segment", "at"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce(_words_hit(F.col("spans")), F.lit(0).cast("bigint"))
    out = table(
        rows.select(*carry, "n_words", hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (hit > 0).alias("contaminated")),
        "contamination",
    )
    drop(index, hits)
    return out
