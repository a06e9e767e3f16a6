"""Null, empty, long, repeated and clashing input for every operator and stage; each has a defined result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from argotlog.llm.catalog import RANKS, RANKS_PATTERN, SENTENCEPIECE_MODEL
from argotlog.llm.decontaminate import build_index, contamination, matches
from argotlog.llm.graph import components
from argotlog.llm.jaccard import linked_texts
from argotlog.llm.licenses import scan_licenses
from argotlog.llm.linededup import dedup_lines
from argotlog.llm.lmscore import backoff_scores
from argotlog.llm.passages import near_passages
from argotlog.llm.perplexity import quality
from argotlog.llm.sentencepiece import load, tokenized
from argotlog.llm.tokencount import counted, recounted
from argotlog.llm.toxicity import scored
from tests.llm.conftest import LONG, PROSE, odd_rows

EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def labels(spark, rows=((5, 1), (5, None), (None, 1), (6, 0), (7, 0), (8, 0), (99, 1))):
    return spark.createDataFrame(list(rows), "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, encoding="ascii") as file:
        return file.read()


def by_text(rows, column):
    """Values by (doc_id, length of text), which tells the rows of `odd` apart but for exact repeats."""
    return {r["doc_id"]: r[column] for r in rows}


def test_toxicity(spark, odd, empty):
    rows = scored(odd, labels(spark)).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    plain = {r["score"] for r in rows if not (r["text"] or "").strip()}
    assert len(plain) == 1  # null, empty and blank texts have no feature
    assert len({r["score"] for r in rows if r["text"] == PROSE}) == 1
    unlabelled = scored(odd, labels(spark, ())).collect()
    assert {r["score"] for r in unlabelled} == {0.5} and {r["predicted"] for r in unlabelled} == {0}
    assert scored(empty, labels(spark)).count() == 0


def test_lm_scoring(odd, empty):
    rows = backoff_scores(odd).collect()
    assert len(rows) == len(odd_rows())
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["log_score"] is None and got[2]["n_words"] == 0 and got[7]["n_words"] == len(LONG.split())
    assert got[4]["n_words"] == got[4]["n_order1"] == 1 and got[10]["n_order3"] == 298
    assert backoff_scores(empty).count() == 0


def test_line_dedup(odd, empty):
    rows = dedup_lines(odd).collect()
    assert len(rows) == len(odd_rows())
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["text"] is None and got[1]["n_lines"] == 0 and got[2]["n_lines"] == 1 and got[3]["n_removed"] == 0
    assert all(r["n_removed"] == 0 for r in rows)  # single lines repeat, chunks of lines do not
    assert dedup_lines(empty).count() == 0


def test_licenses(spark, odd, empty):
    assert scan_licenses(odd).count() == 0 and scan_licenses(empty).count() == 0
    more = odd.select("doc_id", F.lit("Foo. RELEASED under the   MIT license!").alias("text"))
    rows = scan_licenses(more).collect()
    assert {r["license"] for r in rows} == {"MIT notice"} and len(rows) == len({r[0] for r in odd_rows()})


def test_decontamination(spark, odd, empty):
    words = PROSE.split()
    bench = spark.createDataFrame([(1, " ".join(words[3:20])), (2, "nothing of this kind occurs"), (3, None), (None, ""), (4, " .,! "), (5, "word"), (5, "word")], "item_id bigint, text string")
    got = {}
    for r in contamination(odd, bench).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [r["n_hit"] for r in got[5]] == [17, 17] and all(r["contaminated"] for r in got[5])
    assert got[4][0]["n_hit"] == 1 and got[4][0]["n_items"] == 1
    assert got[1][0]["n_words"] == 0 and got[1][0]["items_sha256"] == EMPTY_SHA and not got[1][0]["contaminated"]
    assert sum(map(len, got.values())) == len(odd_rows())
    assert contamination(empty, bench).count() == 0
    assert contamination(odd, bench.where("false")).where("contaminated").count() == 0


def test_quality(odd, empty):
    rows = quality(odd).collect()
    assert len(rows) == len(odd_rows())
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"] and got[3]["base_failed"]
    assert got[10]["base_failed"] and got[10]["n_repeat_words"] == 300 and not got[5]["base_failed"]
    assert all(not (r["kept"] and r["base_failed"]) for r in rows)
    assert quality(empty).count() == 0


def test_sentencepiece(odd, empty):
    model = load(SENTENCEPIECE_MODEL)
    rows = tokenized(odd, model).collect()
    assert len(rows) == len(odd_rows())
    assert all(r["same"] for r in rows if r["doc_id"] != 8)
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["ids"] is None and got[1]["n_tokens"] == 0 and got[2]["ids"] == [] and got[7]["n_tokens"] > 100_000
    assert tokenized(empty, model).count() == 0


def test_token_counts(odd, empty, ranks):
    states = counted(odd, ranks, RANKS_PATTERN)
    edits = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(c).alias("new")) for a, b, c in ((2, 5, "XX"), (4, 9, "Y"), (None, 0, "Z"), (10**6 * 5, None, None))))
    rows = recounted(states, edits, ranks, RANKS_PATTERN).collect()
    assert len(rows) == len(odd_rows())
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["text"] is None and got[1]["state"] is None and got[1]["n_encoded"] == 0
    assert got[2]["text"] == "XXYZ" and got[4]["text"] == "ZwoXXY" and got[5]["text"] == "Z" + PROSE[:2] + "XXY" + PROSE[9:]
    none = recounted(states, F.lit(None).cast("array<struct<start:int,stop:int,new:string>>"), ranks, RANKS_PATTERN)
    assert none.where("n_encoded <> 0").count() == 0 and none.count() == len(odd_rows())
    assert recounted(counted(empty, ranks, RANKS_PATTERN), edits, ranks, RANKS_PATTERN).count() == 0


def test_jaccard(odd, empty):
    rows = linked_texts(odd).collect()
    assert len(rows) == len(odd_rows())
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert got[1] == {(0, 1)} and got[2] == {(0, 2)} and got[3] == {(0, 3)} and got[4] == {(1, 4)}
    assert len(got[5]) == 1 and {c for _, c in got[5]} == {5} and 5 in {c for _, c in got[6]} and (0, None) in got[None]
    assert {c for n, c in got[None] if n} == {5}
    assert linked_texts(empty).count() == 0


def test_passages(odd, empty):
    rows = near_passages(odd).collect()
    assert len(rows) == len(odd_rows())
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    n = len(PROSE.split())
    assert [(r["n_passages"], r["n_dup_words"], r["class_id"]) for r in got[5]] == [(1, n, 5)] * 2
    assert got[1][0]["n_passages"] == 0 and got[1][0]["class_id"] == 1 and got[7][0]["n_passages"] == 0
    assert near_passages(empty).count() == 0


def test_stages(spark, odd, empty, tmp_path):
    folder = str(tmp_path)
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(PROSE.split()[3:20])), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.count() <= docs.count()
        out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert out.count() == docs.count()
    kept = corpus_pipeline.without_near_copies(spark, odd, folder).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    clean = corpus_pipeline.without_benchmark(spark, odd, folder).collect()
    assert PROSE not in {r["text"] for r in clean} and None in {r["text"] for r in clean}


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 6), (6, 5), *((100, i) for i in range(101, 160)), *((i, i + 1) for i in range(200, 260))]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got[3] == 1 and got[7] == got[5] == 4 and got[9] == 9 and got[159] == 100 and got[260] == 200 and len(got) == 3 + 4 + 1 + 60 + 61
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha beta gamma"), (3, "alpha " + "x " * 40 + "beta gamma"), (4, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    index = build_index(docs, "text", ["doc_id"])
    assert matches(index, items, window=3).count() == 1
    assert matches(index, items, window=3, within=4).count() == 2
    assert matches(index, items, window=3, within=100).count() == 3
