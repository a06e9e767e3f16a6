"""Operators against plain versions, an exact round trip, or held-out labels."""

import random
import re

import numpy as np
import pytest
import sentencepiece as sp
from pyspark.sql import functions as F

from argotlog.llm.catalog import QUERIES, RANKS, RANKS_PATTERN, SENTENCEPIECE_MODEL
from argotlog.llm.decontaminate import contamination
from argotlog.llm.jaccard import linked_texts
from argotlog.llm.licenses import TEMPLATES, scan_licenses
from argotlog.llm.linededup import dedup_lines
from argotlog.llm.passages import compact_windows, near_passages
from argotlog.llm.perplexity import quality
from argotlog.llm.sentencepiece import Encoder, _encode_texts, decoded, load
from argotlog.llm.tokencount import Counted, Counter
from argotlog.llm.toxicity import held_out, scored
from tests.llm import brute

VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "rt", "sk")]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + rng.choice((0, 1))] = [rng.choice(VOCABULARY)]
    return out


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of near copies around a base and chains of them, exact copies, and texts that share only a passage."""
    rng = random.Random(7)
    passage, texts = prose(rng, 60), []
    for size, edits in ((40, 3), (40, 12), (8, 1)):
        base = prose(rng, rng.choice((60, 150)))
        texts += [base, *(edited(rng, base, rng.randrange(1, edits + 1)) for _ in range(size))]
    chain = prose(rng, 120)
    for _ in range(12):
        chain = edited(rng, chain, 2)
        texts.append(chain)
    texts += [texts[3]] * 5 + [prose(rng, rng.randrange(0, 90)) + passage + prose(rng, rng.randrange(0, 90)) for _ in range(40)]
    texts += [prose(rng, rng.randrange(0, 12)) for _ in range(20)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def test_jaccard_equals_all_pairs(spark, copies):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in linked_texts(frame(spark, copies)).collect()}
    assert got == brute.components(copies)


def test_exact_repeats_are_within_spans(spark, copies, texts, documents):
    for docs, rows in ((frame(spark, copies), copies), (documents, list(texts.items()))):
        got = {r["doc_id"]: r for r in near_passages(docs).collect()}
        for key, starts in brute.repeated(rows).items():
            spans = [(s["start"], s["end"]) for s in got[key]["spans"]]
            assert all(any(a <= i and i + 50 <= b for a, b in spans) for i in starts), key
            assert got[key]["n_dup_words"] == sum(b - a for a, b in spans) and all(b - a >= 50 for a, b in spans)
    rng = random.Random(3)
    unlike = [(i, " ".join(prose(rng, 200))) for i in range(50)]
    assert near_passages(frame(spark, unlike)).where("n_passages > 0").count() == 0


def test_compact_windows_equal_their_definition():
    rng = np.random.default_rng(5)
    for _ in range(200):
        texts = [rng.integers(1, 2**63, rng.choice([0, 1, 3, 8, 30]), dtype=np.uint64) for _ in range(rng.integers(0, 5))]
        texts = [np.where(rng.random(len(x)) < 0.3, x[:1] if len(x) else x, x) if len(x) else x for x in texts]
        width, expected = int(rng.choice([1, 2, 5, 8])), set()
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        for t, x in enumerate(texts):
            for c in range(len(x)):
                left, right = c, c
                while left > 0 and x[left - 1] > x[c]:
                    left -= 1
                while right + 1 < len(x) and x[right + 1] >= x[c]:
                    right += 1
                if right - left + 1 >= width:
                    expected.add((t, left, c, right))
        values = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        assert set(zip(*(a.tolist() for a in compact_windows(values, at, width)), strict=True)) == expected


def test_line_dedup_survives_shifts(spark, texts, documents):
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(documents).collect()}
    assert got == {k: tuple(rest) for k, *rest in brute.line_dedup(sorted(texts.items()))}
    passage = [f"line {i} of a passage" for i in range(30)]
    rows = [(i, "\n".join([*(f"head {i} {j}" for j in range(i + 1)), *passage, f"tail {i}"])) for i in range(6)]
    removed = {r["doc_id"]: r["n_removed"] for r in dedup_lines(frame(spark, rows)).collect()}
    assert removed[0] == 0 and all(removed[i] >= 20 for i in range(1, 6))


def test_decontamination_equals_all_windows(spark):
    rng = random.Random(11)
    few = ["a", "b", "the", "of", "zz"]
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.randrange(0, 15)))) for i in range(12)]
    rows = [(i, " ".join(rng.choice(few) for _ in range(rng.randrange(0, 400)))) for i in range(60)]
    rows += [(100 + i, f"x {text.upper()}, y") for i, text in items]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for window in (10, 4):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in contamination(frame(spark, rows), bench, window=window).collect()}
        assert got == brute.contamination(rows, items, window)


def test_quality_counts_and_bands(spark, texts, documents):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality(documents).collect()}
    assert got == {k: brute.quality_counts(t) for k, t in texts.items()}
    folder = "/root/testdata/sf0.01"
    kept = quality(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed")
    shares = {r["quality"]: r["share"] for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] > 0.95 and shares[0] < 0.3


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scored(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where(held_out(F.col("doc_id")))
    found = {r["toxic"]: r for r in rows.groupBy("toxic").agg(F.avg("predicted").alias("share"), F.avg("score").alias("score")).collect()}
    assert found[0]["share"] < 0.005 and found[1]["share"] > 0.6 and found[1]["score"] > 20 * found[0]["score"]


def test_licenses_equal_containment(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(path).collect()]
    rows += [(10**6 + i, f"// {text.upper()}\n* and code") for i, text in enumerate(TEMPLATES.values())]
    rows += [(2 * 10**6 + i, " ".join(w for j, w in enumerate(text.split()) if j != 30)) for i, text in enumerate(TEMPLATES.values())]

    def shingles(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    templates = {k: shingles(v) for k, v in TEMPLATES.items()}
    expected = {(key, name) for key, text in rows for name, s in templates.items() if len(s & shingles(text)) >= 0.8 * len(s)}
    assert {(r["doc_id"], r["license"]) for r in scan_licenses(frame(spark, rows)).collect()} == expected


def test_sentencepiece_equals_the_library(spark, texts):
    vocabulary, library = load(SENTENCEPIECE_MODEL), sp.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDE 0123456789  .,\n\té中文😀ß   aeiouthn"
    parts = ["the", "ing", "internationalization", "Übergröße", "aaaaaaaa", "((((", "====", "....", "xxxx", " ", "  ", "▁"]
    many = [t or "" for t in texts.values()]
    many += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    many += ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    ids, at = _encode_texts(Encoder(vocabulary), many)
    expected = library.encode(many, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == expected
    some = [e for e in expected if e][:2000] + [[5, 200, 300], [99999, -1], []]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(some)], "i int, ids array<int>")
    back = {r["i"]: r["t"] for r in df.select("i", decoded(spark, vocabulary, F.col("ids")).alias("t")).collect()}
    assert [back[i] for i in range(2000)] == [library.decode(e) for e in some[:2000]]
    assert back[2001] == "��" and back[2002] == ""


def test_token_counts_follow_edits():
    with open(RANKS, encoding="ascii") as file:
        counter = Counter(file.read(), RANKS_PATTERN)
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "'", "'s", "'re", "9", "12", ".", "!!", "é", "中", "😀", " x", "\t", "ll", "v"]

    def text(n):
        return "".join(rng.choice(parts) for _ in range(n))

    for i in range(3000):
        now = text(rng.randrange(300 if i % 10 == 0 else 30))
        cut = counter.pattern.findall(now)
        doc = Counted(np.array([len(p) for p in cut], np.uint32), np.array(counter.counts(cut), np.uint32))
        for _ in range(3):
            start = rng.randint(0, len(now))
            stop = rng.randint(start, min(len(now), start + rng.choice((0, 1, 5, 50))))
            new = text(rng.choice((0, 1, 3, 40)))
            expected = now[:start] + new + now[stop:]
            doc = Counted.unpacked(*doc.packed()[1:])
            now, _ = doc.edit(counter, now, start, stop, new)
            assert now == expected and doc.length.tolist() == [len(p) for p in counter.pattern.findall(now)]
            assert doc.tokens == len(counter.encoding.encode_ordinary(now)) and doc.characters == len(now)


def test_token_count_query(spark, texts):
    with open(RANKS, encoding="ascii") as file:
        counter = Counter(file.read(), RANKS_PATTERN)
    for r in QUERIES["op8_token_counts"](spark, "/root/testdata/sf0.001").collect():
        old = texts[r["doc_id"]]
        middle = len(old) // 2
        new = f"Title: {old[:middle]}{old[middle + 20 :]} The end."
        assert (r["n_before"], r["n_after"], r["n_pretokens"]) == (len(counter.encoding.encode_ordinary(old)), len(counter.encoding.encode_ordinary(new)), len(counter.pattern.findall(new)))
        assert r["n_encoded"] < 30
