"""The pipeline against plain versions of its stages."""

import sentencepiece as sp
from pyspark.sql import functions as F

import corpus_pipeline
from argotlog.llm.toxicity import scored
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    clean = scored(documents, labels).where("score < 0.7").select("doc_id", "text").collect()
    docs = [(key, text) for key, text, n, gone in brute.line_dedup(sorted((r["doc_id"], r["text"]) for r in clean)) if not gone or gone < n]
    own = brute.components(docs)
    docs = [(key, text) for key, text in docs if own[key][1] == key]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = brute.contamination(docs, items)
    docs = [(key, text) for key, text in docs if not dirty[key][1]]
    library = sp.SentencePieceProcessor(model_file=corpus_pipeline.SENTENCEPIECE_MODEL)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {key: library.encode(text) for key, text in docs}
    assert len(got) == len(docs) and all(r["same"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_keep_the_columns_and_follow_the_text(spark, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    out = corpus_pipeline.without_repeated_lines(spark, documents, FOLDER)
    assert out.schema == documents.schema
    changed = out.join(documents.select("doc_id", F.col("text").alias("old"), F.col("n_chars").alias("n_old")), "doc_id")
    assert changed.where("text <> old and n_chars <> length(text)").count() == 0 and changed.where("text = old and n_chars <> n_old").count() == 0
