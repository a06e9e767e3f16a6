"""Reversed ranked search: the queries are the index, and the documents pass by.

An inverted index over the terms of a bounded block of items is sent to all tasks.  Each document's term counts are looked up in it, scores of all
items with a common term are added up, and each task keeps the best documents of every item in a heap of ``k`` places, whatever it reads.  The heaps of all
tasks are merged by Spark.  A larger set of items is taken block by block, so neither the index nor the heaps grow with it.

Words are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argotlog.llm.tables import drop, table
from argotlog.llm.words import LETTERS_DIGITS, give_back, words

K = 10
# Length weight in hundredths, and the scale of the whole-number scores.
B = 75
SCALE = 1_000_000_000
# Bytes of item texts in a block: a term takes at least two bytes with its separator, so the index has at most half as many entries.
BLOCK_BYTES = 4 << 20
# Postings and score cells that are worked on at once.
POSTINGS = 1 << 20
CELLS = 1 << 20
# Up to here, sums of whole numbers are exact in doubles.
_EXACT = float(1 << 53)
_ALL, _TERMS = -1, -2


class Index:
    """Terms of a block of items, ascending by hash, each with the items that hold it and how often."""

    def __init__(self, texts: list[str | None]):
        item, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for row, _, w in words(pa.array(texts, pa.large_string()), LETTERS_DIGITS):
            item.append(w.doc() + row)
            hashes.append(w.hash)
        item, hashes = np.concatenate(item), np.concatenate(hashes)
        order = np.lexsort((item, hashes))
        item, hashes = item[order], hashes[order]
        first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])])) if len(item) else np.zeros(0, np.int64)
        self.items = len(texts)
        self.item, self.times = item[first].astype(np.int32), np.diff(np.append(first, len(item))).astype(np.int64)
        held = hashes[first]
        begin = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
        self.terms = held[begin]
        self.postings = np.append(begin, len(held)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def _counted(column: pa.Array, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, terms of each text, and for distinct indexed terms of each: text, term, times)."""
    for row, _, w in words(column, LETTERS_DIGITS):
        term = index.find(w.hash)
        known = np.flatnonzero(term >= 0)
        pair = w.doc()[known] * max(1, len(index.terms)) + term[known]
        pair, times = np.unique(pair, return_counts=True)
        yield row, np.diff(w.first), pair // max(1, len(index.terms)), pair % max(1, len(index.terms)), times.astype(np.int64)


def _statistics(docs: DataFrame, sent) -> dict[int, int]:
    """Number of documents with each indexed term, of all with a term (-1), and of all terms (-2); sums of at most one row per term and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        df, every, total = np.zeros(len(index.terms), np.int64), 0, 0
        for b in batches:
            for _, sizes, _, term, _ in _counted(b.column(0), index):
                df += np.bincount(term, minlength=len(df))
                every += int((sizes > 0).sum())
                total += int(sizes.sum())
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, [_ALL, _TERMS]]), pa.int64()), pa.array(np.concatenate([df[used], [every, total]]), pa.int64())], names=["term", "n"])
        give_back()

    return dict(docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())


class Heaps:
    """The best ``k`` documents of each item so far: by score falling, then null ids first, then ids ascending, then rows as they came."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item = np.zeros(0, np.int64)
        self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.least = np.zeros(items, np.int64)  # a score has to reach this to matter

    def add(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        null, doc = np.concatenate([self.null, null]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, ~null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[place < self.k]
        self.item, self.score, self.null, self.doc = item[place < self.k], score[keep], null[keep], doc[keep]
        last = np.flatnonzero(place == self.k - 1)
        self.least[item[last]] = score[order[last]]


def _best(docs: DataFrame, sent, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc, score): the heaps of all tasks."""
    weight = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, w = sent.value, weight.value
        heaps = Heaps(index.items, k)
        for b in batches:
            ids = b.column(1)
            null, doc = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            for row, sizes, text, term, times in _counted(b.column(0), index):
                m = (100 - B) + (B * sizes * n_docs) // max(1, n_terms)
                part = w[term] * ((SCALE * times) // (1000 * times + 8 * m[text]))
                low, n = index.postings[term], np.diff(index.postings)[term]
                at = np.concatenate([[0], np.cumsum(n)])
                first = np.searchsorted(text, np.arange(len(sizes) + 1))
                step = max(1, CELLS // max(1, index.items))
                begin = 0
                while begin < len(sizes):
                    # As many texts as keep the postings and the cells within bounds, one at least.
                    stop = int(np.searchsorted(at[first], at[first[begin]] + POSTINGS, side="right")) - 1
                    stop = min(max(stop, begin + 1), begin + step, len(sizes))
                    a, z = first[begin], first[stop]
                    if z > a:
                        place = np.repeat(low[a:z] - (at[a:z] - at[a]), n[a:z]) + np.arange(at[z] - at[a])
                        cell = np.repeat((text[a:z] - begin) * index.items, n[a:z]) + index.item[place]
                        value = np.repeat(part[a:z], n[a:z]) * index.times[place]
                        if value.sum(dtype=np.float64) < _EXACT:
                            score = np.bincount(cell, value, (stop - begin) * index.items).astype(np.int64)
                        else:
                            score = np.zeros((stop - begin) * index.items, np.int64)
                            np.add.at(score, cell, value)
                        least = np.broadcast_to(np.maximum(heaps.least, 1), (stop - begin, index.items)).ravel()
                        good = np.flatnonzero(score >= least)
                        if len(good):
                            of = row + begin + good // index.items
                            heaps.add(good % index.items, score[good], null[of], doc[of])
                    begin = stop
        yield pa.RecordBatch.from_arrays([pa.array(heaps.item, pa.int32()), pa.array(heaps.doc, pa.int64(), mask=heaps.null), pa.array(heaps.score)], names=["item", "doc", "score"])
        give_back()

    found = table(docs.select("text", "id").mapInArrow(run, "item int, doc bigint, score bigint"), "heaps")
    weight.destroy()
    return found


def ranked(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of every item: ``item_key``, rank (from 1), ``key``, score; equal scores by ascending id, null first.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  With N documents that have a term, L terms in all of them, a
    document's n terms, and ``df`` documents with a term, the weight of a term is floor(1000 ln((2 N + 2) / (2 df + 1))), m is 25 + 75 n N div L, and a document's
    score is the sum over the item's terms, repeats included, of weight * (10^9 tf div (1000 tf + 8 m)).  Only scores above 0 count, so null and wordless texts are in no
    list and null and wordless items have none.  Repeated rows are ranked each for itself, repeated item rows get a list each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{key}`").cast("bigint").alias("id"))
    kind = items.schema[item_key].dataType.simpleString()
    asked = items.where(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_key}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    # Numbered once, so that a block is the same rows whenever it is read.
    asked = table(asked.withColumn("row", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("item_id", "text").collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(index := Index([r["text"] for r in rows]))
        counts = _statistics(chosen, sent)
        n_docs, n_terms = counts.pop(_ALL, 0), counts.pop(_TERMS, 0)
        df = np.zeros(len(index.terms))
        df[list(counts)] = list(counts.values())
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        heaps = _best(chosen, sent, weights, n_docs, n_terms, k)
        sent.destroy()
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_first())
        best = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        # The names of a block are as few as its texts, whose size is bounded.
        part = best.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_key), "rank", F.col("doc").alias(key), "score")
        found.append(table(part, "ranked"))
        drop(heaps)
    drop(asked)
    if not found:
        return spark.createDataFrame([], f"{item_key} {kind}, rank int, {key} bigint, score bigint")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
