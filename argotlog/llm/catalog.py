"""Named queries: each operator over the whole of its table, with production parameters, and the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argotlog.llm import sql
from argotlog.llm.decontaminate import contamination
from argotlog.llm.jaccard import linked_texts
from argotlog.llm.licenses import scan_licenses
from argotlog.llm.linededup import dedup_lines
from argotlog.llm.lmscore import backoff_scores
from argotlog.llm.passages import near_passages
from argotlog.llm.perplexity import quality
from argotlog.llm.search import ranked
from argotlog.llm.sentencepiece import load, tokenized
from argotlog.llm.tables import drop, table
from argotlog.llm.tokencount import counted, recounted
from argotlog.llm.tokenfiles import token_files
from argotlog.llm.toxicity import held_out, scored
from argotlog.llm.whitening import whitened


# Public tokenizer files; the driver reads them, the tasks get their contents.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
# Fixed value: the pattern that belongs to the ranks.
RANKS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = scored(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    found = backoff_scores(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_order1", "n_order2", "n_order3", F.round(F.col("log_score") / F.col("n_words"), 6).alias("score"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(_table(spark, folder, "documents").select("doc_id", "text"))


def op4_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(_table(spark, folder, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(_table(spark, folder, "documents"))


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    found = tokenized(_table(spark, folder, "documents").select("doc_id", "text"), load(SENTENCEPIECE_MODEL))
    return found.select("doc_id", "n_tokens", "ids", "same")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Three edits of every document: a title before it, twenty characters out of its middle, an ending behind it."""
    with open(RANKS, encoding="ascii") as file:
        ranks = file.read()
    before = counted(_table(spark, folder, "documents").select("doc_id", "text"), ranks, RANKS_PATTERN)
    size, middle = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edits = F.array(*(F.struct(a.alias("start"), b.alias("stop"), F.lit(new).alias("new")) for a, b, new in ((F.lit(0), F.lit(0), "Title: "), (middle, middle + 20, ""), (size, size, " The end."))))
    after = recounted(before.withColumn("n_before", F.col("state.tokens")), edits, ranks, RANKS_PATTERN)
    pretokens = F.expr("octet_length(state.length) div 4")
    out = table(after.select("doc_id", "n_before", F.col("state.tokens").alias("n_after"), pretokens.alias("n_pretokens"), "n_encoded"), "counts")
    drop(before)
    return out


def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return linked_texts(_table(spark, folder, "documents"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_passages(_table(spark, folder, "documents"))


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    with open(WORD_TOKENIZER, encoding="utf-8") as file:
        definition = file.read()
    _, found = token_files(_table(spark, folder, "documents").select("doc_id", "text"), definition)
    return found


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitened(_table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_line_dedup": op3_line_dedup,
    "op4_license_scans": op4_license_scans,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_token_files": op11_token_files,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_ranked_search": op13_ranked_search,
}

SQL: dict[str, str] = {
    "op2_lm_scoring": sql.LM_SCORING,
    "op3_line_dedup": sql.LINE_DEDUP,
    "op5_benchmark_decontamination": sql.DECONTAMINATION,
    "op9_ngram_jaccard_join": sql.JACCARD,
    "op13_ranked_search": sql.RANKED_SEARCH,
}
