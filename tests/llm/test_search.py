"""Ranked search against a plain version."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from argotlog.llm.search import ranked
from tests.llm.conftest import PROSE, odd_rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return TERM.findall(lowered)


def brute(docs, items, k=10):
    """[(item, rank, doc, score)] of lists of (id, text)."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        wanted = Counter(terms(text))
        scores = []
        for d, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w, n in wanted.items() if c[w])
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:2], r[3], str(r[2])))


def test_small_blocks_and_other_sizes(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    for k, block in ((3, 300), (10, 1 << 20), (100, 2000)):
        assert ordered(ranked(documents, items, k=k, block_bytes=block).collect()) == ordered(brute(docs, asked, k))


def test_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, PROSE, 0), (2, None, 0), (3, " .,! ", 0), (4, "word", 0), (4, "WORD word the", 0), (None, "same café", 0), (5, "nowhere else", 0)], "item_id bigint, text string, rank int")
    docs, asked = [r[:2] for r in odd_rows()], [r[:2] for r in items.collect()]
    found = ranked(odd.withColumn("rank", F.lit(1)), items).collect()
    expected = [r for row in asked for r in brute(docs, [row])]
    assert ordered(found) == ordered(expected) and {r["item_id"] for r in found} == {1, 4, None}
    assert [r["doc_id"] for r in sorted((r for r in found if r["item_id"] == 1), key=lambda r: r["rank"])][:3] == [None, 5, 5]
    assert ranked(empty, items).count() == 0 and ranked(odd, items.where("false")).count() == 0


def test_ties_of_many_copies(spark):
    docs = [(i, "one two three") for i in range(500)] + [(1000, "one two three four")] + [(2000 + i, "other words") for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    items = spark.createDataFrame([(1, "two four"), (2, "three")], "item_id bigint, text string")
    assert ordered(ranked(frame, items).collect()) == ordered(brute(docs, [(1, "two four"), (2, "three")]))
