"""Operators on small hand-made tables: edge cases that the big comparisons may not reach."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from argotlog.functions.text import words
from argotlog.operators import coherence, labels, quality, report, risk, sampling, terms, topics


def test_risk_figures(spark):
    rows = [(0, "certutil.exe -f x"), (0, "mshta.exe a & mshta.exe b"), (1, "MSHTA.EXE a"), (1, "dir"), (2, None)]
    df = spark.createDataFrame(rows, "topic int, command_line string")
    keywords = ["certutil", "certutil.exe", "mshta.exe"]
    got = [tuple(r) for r in risk.score_topics(df, keywords).collect()]
    assert got == [
        (0, 2, 2, 100.0, 2, 1.5, 75.0),
        (1, 2, 0, 0.0, 0, 0.0, 0.0),
        (2, 1, 0, 0.0, 0, 0.0, 0.0),
    ]
    any_case = {r.topic: r.lolbas_count for r in risk.score_topics(df, keywords, case_sensitive=False).collect()}
    assert any_case == {0: 2, 1: 1, 2: 0}
    none = risk.score_topics(df, []).collect()
    assert all(r.lolbas_density == 0 for r in none)
    flags = [(r.contains_lolbas, r.lolbas_count) for r in risk.flag_keywords(df, keywords).collect()]
    assert flags == [(True, 1), (True, 2), (False, 0), (False, 0), (False, 0)]


def test_rare_terms(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a c"), (4, "  "), (5, None)], "row_id bigint, t string")
    normal, anomalies = terms.split_rare(df, "t", "row_id", 2)
    assert sorted(r.row_id for r in normal.collect()) == [1, 2, 4, 5]
    assert [r.row_id for r in anomalies.collect()] == [3]
    flags = {r.row_id: (r.min_df, r.is_anomaly) for r in terms.flag_rare(df, "t", "row_id", 2).collect()}
    assert flags == {1: (2, False), 2: (2, False), 3: (1, True), 4: (None, False), 5: (None, False)}
    assert terms.split_rare(df, "t", "row_id", 1)[1].count() == 0


@pytest.mark.parametrize("common", [1, 7, 65_536])
def test_rare_terms_do_not_depend_on_the_broadcast_bound(spark, monkeypatch, common):
    """Also with one term in most of the rows, and with common terms too long for the broadcast."""
    monkeypatch.setattr(terms, "COMMON_TERMS", common)
    monkeypatch.setattr(terms, "COMMON_TERM_CHARS", 3)
    rng = random.Random(common)
    pool = ["hot", "longhot", *[f"t{i}" for i in range(40)]]
    rows = [(i, " ".join(["hot", "longhot"] * (i % 3 > 0) + rng.choices(pool, k=rng.randint(0, 4)))) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id bigint, t string")
    df_of = Counter(w for _, t in rows for w in set(t.split()))
    expected = {i: min((df_of[w] for w in t.split()), default=None) for i, t in rows}
    flagged = terms.flag_rare(df, "t", "row_id", 30)
    assert {r.row_id: r.min_df for r in flagged.collect()} == expected
    rare = {r.row_id for r in terms.rows_with_rare_terms(df, "t", "row_id", 30).collect()}
    assert rare == {i for i, m in expected.items() if m is not None and m < 30}


def test_histogram_inside_the_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["x"])], "row_id int, tokens array<string>")
    got = sorted(tuple(r) for r in terms.bag_of_words(df).collect())
    assert got == [(1, "a", 1), (1, "b", 2), (3, "x", 1)]
    assert sorted(tuple(r) for r in terms.vocabulary(df).collect()) == [("a", 1, 1), ("b", 1, 2), ("x", 1, 1)]


def test_quality(spark):
    df = spark.createDataFrame([("x",)] * 30 + [(None,)] * 2, "command_line string")
    row = quality.corpus_quality(df).first()
    assert (row.n_rows, row.n_valid, row.n_distinct, row.is_valid, row.mostly_duplicates) == (32, 30, 2, True, False)
    assert quality.require_usable(df).n_valid == 30
    with pytest.raises(ValueError, match="too few"):
        quality.require_usable(df.limit(3))
    with pytest.raises(ValueError, match="empty"):
        quality.require_usable(df.limit(0))
    with pytest.raises(KeyError, match="Available columns"):
        quality.corpus_quality(df.withColumnRenamed("command_line", "c"))
    kept, seen = quality.drop_missing_observed(df)
    assert kept.count() == 30 and seen.get["dropped"] == 2


def test_sample_is_exact_and_independent_of_layout(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    for n in (1, 100, 4999, 5000, 9000):
        first = sorted(r.row_id for r in sampling.sample_exact(df, n).collect())
        assert len(first) == min(n, 5000)
        assert first == sorted(r.row_id for r in sampling.sample_exact(df.repartition(3), n).collect())
    assert sampling.sample_exact(df, 100, seed=1).collect() != sampling.sample_exact(df, 100, seed=2).collect()


def test_argmax(spark):
    rows = [([0.2, 0.5, 0.5],), ([0.0, 0.0],), ([],), (None,)]
    df = spark.createDataFrame(rows, "w array<double>")
    assert [r.t for r in df.select(topics.argmax(F.col("w")).alias("t")).collect()] == [1, -1, -1, -1]


def test_topic_names(spark):
    rows = [
        (0, "certutil.exe", ["certutil.exe", "-decode", "zzz"]),
        (1, "wmic", ["wmic", "qfe", "<guid>"]),
        (2, "", ["http"]),
        (3, None, ["<guid>", "qq"]),
        (4, "x.exe", ["x.exe", "<guid>", "ab"]),
    ]
    df = spark.createDataFrame(rows, "topic int, root_command string, tokens array<string>")
    topic_words = spark.createDataFrame([(3, 1, "<x>"), (3, 2, "Some"), (3, 3, "more")], "topic int, rank int, term string")
    names = {r.topic: r.topic_summary for r in labels.topic_names(df, topic_words, 6).collect()}
    assert names == {
        0: "Certutil Encoding Operations",
        1: "Wmic Qfe Activity",
        2: "Network Operations",
        3: "Topic 3: Some, more",
        4: "X Commands",
        5: "Topic 5: Empty",
    }


def test_tfidf_labels(spark):
    rows = [(0, ["a.exe", "deep", "all"]), (0, ["a.exe", "deep", "all"]), (1, ["tool", "all"]), (2, ["c:\\w\\reg.exe", "reg", "all"])]
    df = spark.createDataFrame(rows, "topic int, tokens array<string>")
    weights = [(0, 1, "all", 0.6), (0, 2, "deep", 0.4), (1, 1, "tool", 0.9), (1, 2, "all", 0.1), (2, 1, "reg", 1.0)]
    topic_words = spark.createDataFrame(weights, "topic int, rank int, term string, weight double")
    got = {r.topic: r.topic_summary for r in labels.tfidf_labels(df, topic_words).collect()}
    assert got == {0: "A (Deep)", 1: "Topic: Tool", 2: "Reg Activity"}


def test_report_tables(spark):
    leaves = spark.createDataFrame([("A", "certutil x", 3), ("A", "Topic CERTUTIL", 1), ("B", "dir", 2)], "topic_summary string, command_group string, n bigint")
    tree = sorted(tuple(r) for r in report.treemap(leaves).fillna("-").collect())
    assert tree[0] == (0, "All Topics", "-", 6) and (1, "A", "-", 4) in tree and len(tree) == 6
    shown = {r.command_group for r in report.hide_keyword_groups(leaves, ["certutil"]).collect()}
    assert shown == {"Topic CERTUTIL", "dir"}
    assert report.hide_keyword_groups(leaves, []).count() == 3
    df = spark.createDataFrame([(0, "a.exe"), (0, "a.exe"), (1, "b")], "topic int, root_command string")
    topic_words = spark.createDataFrame([(0, 1, "w", 0.5), (1, 1, "v", 0.5)], "topic int, rank int, term string, weight double")
    text = report.markdown_report(df, topic_words, 7, 2)
    assert "| rows | 3 |" in text and "| 0 | 2 | 66.7 | w" in text and "| a.exe | 2 |" in text


def test_windows_of_long_documents(spark):
    tokens = ["a"] + ["x"] * 8 + ["b"] + ["x"] * 3
    df = spark.createDataFrame([(tokens,), (["b", "a"],)], "tokens array<string>")
    counts = coherence.co_occurrences(coherence.window_contents(df, ["a", "b"], 10))
    got = {(r.a, r.b): r.n for r in counts.collect()}
    # windows of the long document start at 0..3: the first holds a and b, all hold b; the short document is one window
    assert got == {(None, None): 5, ("a", "a"): 2, ("a", "b"): 2, ("b", "b"): 5}


def test_exact_quartiles(spark):
    df = spark.createDataFrame([(0, ["t"] * n) for n in (1, 2, 3, 4, 10)], "topic int, tokens array<string>")
    row = topics.length_distribution(df).first()
    assert (row.min_length, row.q1, row.median, row.q3, row.max_length, row.mean_length) == (1, 2.0, 3.0, 4.0, 10, 4.0)
    assert abs(row.sd_length - 10**0.5) < 1e-12
    assert topics.length_distribution(df, exact=False).first().median == 3.0
    assert spark.range(1).select(words(F.lit("a\u00a0b")).alias("w")).first().w == ["a", "b"]


def test_box_statistics_of_very_many_rows(spark):
    """One topic with 4 * 10^8 rows of 30 and 31 tokens: the products of its sums do not fit 64 bits."""
    counts = spark.createDataFrame([(0, 30, 200_000_000), (0, 31, 200_000_000), (1, 5, 4)], "topic int, length int, n bigint")
    rows = topics._box(counts, "topic", F.percentile("length", [0.25, 0.5, 0.75], F.col("n"))).collect()
    assert [(r.n_docs, r.mean_length, r.sd_length, r.q1, r.q3) for r in rows] == [(400_000_000, 30.5, 0.5, 30.0, 31.0), (4, 5.0, 0.0, 5.0, 5.0)]
