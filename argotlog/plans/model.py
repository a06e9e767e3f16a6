"""Topic model: dictionary, training, assignment, top words, choice of the number of topics, persistence.

A model is a table of topic weights by term (module ``lda``) and a few numbers; neither the vocabulary nor the weights pass through the driver or a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.coherence import model_coherence
from ..operators.sampling import sample_exact
from ..operators.terms import term_counts
from ..operators.topics import UNASSIGNED, argmax
from ..session import discard, materialize
from . import lda

NUM_TOPICS = 11
SEED = 42
PASSES = 10
TUNING_PASSES = 3
TUNING_TOPICS = range(5, 50, 2)
PERPLEXITY_TOPICS = range(5, 51, 5)
COHERENCE_WORDS = 20
# A training step takes this share of the documents, whatever their number.
STEP_SHARE = 0.1
# Training on all documents ends when the bound grows by less than this share of its size.
BOUND_TOLERANCE = 1e-6
FORMAT_VERSION = 1
_ROW, _TOPIC = "_assigned_row", "_assigned_topic"


@dataclass(frozen=True)
class TopicModel:
    """Fitted topics: weights by term, document prior, term prior."""

    weights: lda.Weights
    alpha: tuple[float, ...]
    eta: float

    @property
    def num_topics(self) -> int:
        return len(self.alpha)

    @property
    def vocabulary_size(self) -> int:
        return self.weights.terms

    @property
    def layout(self) -> lda.Layout:
        return lda.Layout((self.num_topics,), (self.alpha,), (self.eta,))

    def save(self, path: str) -> None:
        """``terms`` and ``parameters`` below ``path``, both Parquet; the parameters come last, so a broken save does not load."""
        spark = self.weights.table.sparkSession
        self.weights.table.write.mode("overwrite").parquet(f"{path}/terms")
        row = (FORMAT_VERSION, self.vocabulary_size, list(self.alpha), self.eta, self.weights.totals.tolist())
        spark.createDataFrame([row], "version int, terms bigint, alpha array<double>, eta double, totals array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")

    @classmethod
    def load(cls, path: str) -> TopicModel:
        spark = SparkSession.active()
        row = spark.read.parquet(f"{path}/parameters").first()
        if row["version"] != FORMAT_VERSION:
            raise ValueError(f"topic model of version {row['version']}, not {FORMAT_VERSION}")
        return cls(lda.Weights(spark.read.parquet(f"{path}/terms"), np.array(row["totals"]), row["terms"]), tuple(row["alpha"]), row["eta"])

    def top_words(self, n: int = 10) -> DataFrame:
        """(topic, rank, term, weight); topics x n rows, equal weights by term."""
        found = lda.top_terms(self.weights, self.num_topics, n)
        return found.select(F.col("column").alias("topic"), "rank", "term", "weight")

    def distributions(self, df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
        """(key, theta): expected shares of the topics, for the documents with a known token.  ``key`` tells rows apart."""
        rows = lda.with_tokens(df.select(F.lit(0).alias("slot"), F.col(tokens).alias("tokens"), F.col(key).alias("carried")))
        blocks = lda.blocks_of(rows, self.num_topics)
        found = materialize(lda.distributions(blocks, self.weights, self.layout, df.schema[key].dataType.simpleString()))
        discard(blocks)
        return found.withColumnRenamed("carried", key)

    def assign(self, df: DataFrame, key: str | None = None, tokens: str = "tokens") -> DataFrame:
        """Add ``topic``: the most probable topic, the lowest on ties, -1 for a document without known tokens.

        ``key`` names a column whose values tell the rows apart, of a table that reads the same every time; without one, ``df`` is written with a row number.
        """
        if key is None:
            df = materialize(df.withColumn(_ROW, F.monotonically_increasing_id()))
        found = self.distributions(df, key or _ROW, tokens).select(F.col(key or _ROW).alias(_ROW), argmax("theta").alias(_TOPIC))
        joined = df.join(found if key is None else found.withColumnRenamed(_ROW, key), key or _ROW, "left")
        return joined.withColumn("topic", F.coalesce(_TOPIC, F.lit(UNASSIGNED))).drop(_ROW, _TOPIC)


def asymmetric_prior(num_topics: int) -> list[float]:
    """Document-topic prior that falls off with the topic number and sums to one."""
    raw = [1.0 / (i + math.sqrt(num_topics)) for i in range(num_topics)]
    return [x / sum(raw) for x in raw]


def build_dictionary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, df, cf) of all tokens, as a table; none is left out, however many there are."""
    found = materialize(lda.counted_terms(df, tokens))
    if found.isEmpty():
        raise ValueError("no tokens to build a dictionary from")
    return found


def _layout(topics: Sequence[int], asymmetric: bool, doc_topic_prior: float | None, topic_word_prior: float | None) -> lda.Layout:
    alphas = tuple(tuple(asymmetric_prior(k)) if asymmetric else (doc_topic_prior or 1.0 / k,) * k for k in topics)
    return lda.Layout(tuple(topics), alphas, tuple(topic_word_prior or 1.0 / k for k in topics))


def _online(df: DataFrame, layout: lda.Layout, passes: int, seed: int, dictionary: DataFrame, share: float) -> lda.Weights:
    steps = math.ceil(1 / share)
    blocks = lda.slices(df, steps, layout.width, seed)
    found = lda.online(blocks, lda.initial(dictionary, layout, seed), layout, passes, steps)
    discard(blocks)
    return found


def train(
    df: DataFrame,
    num_topics: int = NUM_TOPICS,
    passes: int = PASSES,
    seed: int = SEED,
    asymmetric: bool = True,
    topic_word_prior: float | None = 1.0,
    dictionary: DataFrame | None = None,
    step_share: float = STEP_SHARE,
) -> TopicModel:
    """Fit a topic model on the ``tokens`` of ``df``; each step takes ``step_share`` of the documents, and every document is in one step a pass."""
    layout = _layout([num_topics], asymmetric, None, topic_word_prior)
    weights = _online(df, layout, passes, seed, build_dictionary(df) if dictionary is None else dictionary, step_share)
    return TopicModel(weights, layout.alphas[0], layout.etas[0])


def train_full_batch(
    df: DataFrame,
    num_topics: int,
    seed: int = SEED,
    max_iter: int = 10,
    doc_topic_prior: float | None = None,
    topic_word_prior: float | None = None,
    dictionary: DataFrame | None = None,
    tolerance: float = BOUND_TOLERANCE,
) -> TopicModel:
    """Fit on the ``tokens`` of ``df`` with all documents in every step, until the bound stands still; priors default to 1 / num_topics."""
    layout = _layout([num_topics], False, doc_topic_prior, topic_word_prior)
    blocks = lda.slices(df, 1, layout.width, seed)
    start = lda.initial(build_dictionary(df) if dictionary is None else dictionary, layout, seed)
    weights = lda.full_batch(blocks, start, layout, max_iter, tolerance)
    discard(blocks)
    return TopicModel(weights, layout.alphas[0], layout.etas[0])


def log_perplexity(model: TopicModel, df: DataFrame) -> float:
    """Minus the variational bound per known token of the documents of ``df``; lower is better."""
    blocks = lda.slices(df, 1, model.num_topics, 0)
    bound = lda.bounds(blocks, model.weights, model.layout)[0]
    known = df.select(F.inline(term_counts(F.col("tokens"))).alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n"))
    total = known.join(model.weights.table.select("term"), "term", "left_semi").agg(F.sum("n")).first()[0]
    discard(blocks)
    return float(-bound / total)


def tune_by_perplexity(
    df: DataFrame, topics: Iterable[int] = PERPLEXITY_TOPICS, seed: int = SEED, max_iter: int = 10, dictionary: DataFrame | None = None
) -> tuple[int, list[tuple[int, float]]]:
    """(best number of topics, [(number of topics, perplexity)]); lower is better, the first of equals wins.

    All candidates are trained side by side on all documents, so the corpus is read once per step, not once per candidate.
    """
    dictionary = build_dictionary(df) if dictionary is None else dictionary
    topics = list(dict.fromkeys(topics))
    layout = _layout(topics, False, None, None)
    blocks = lda.slices(df, 1, layout.width, seed)
    weights = lda.full_batch(blocks, lda.initial(dictionary, layout, seed), layout, max_iter, BOUND_TOLERANCE)
    tokens = dictionary.agg(F.sum("cf")).first()[0]
    scores = [(k, math.exp(-bound / tokens)) for k, bound in zip(topics, lda.bounds(blocks, weights, layout).tolist(), strict=True)]
    discard(blocks, weights.table)
    return min(scores, key=lambda s: s[1])[0], scores


def candidate_words(
    df: DataFrame, topics: Sequence[int], passes: int, seed: int, dictionary: DataFrame, n: int = COHERENCE_WORDS
) -> DataFrame:
    """(model, topic, rank, term) of models with ``topics`` topics each, trained side by side in one go over the corpus; ``model`` is the number of topics."""
    layout = _layout(topics, False, None, None)
    weights = _online(df, layout, passes, seed, dictionary, STEP_SHARE)
    places = F.array(*(F.struct(F.lit(k).alias("model"), F.lit(t).alias("topic")) for k in topics for t in range(k)))
    found = let(F.get(places, F.col("column")), lambda place: place)
    words = lda.top_terms(weights, layout.width, n).select(found.alias("place"), "rank", "term")
    out = materialize(words.select("place.model", "place.topic", "rank", "term"))
    discard(weights.table)
    return out


def tune_by_coherence(
    df: DataFrame,
    topics: Iterable[int] = TUNING_TOPICS,
    measure: str = "c_v",
    passes: int = TUNING_PASSES,
    seed: int = SEED,
    sample_rows: int | None = None,
    key: str = "row_id",
    dictionary: DataFrame | None = None,
) -> tuple[int, list[tuple[int, float]]]:
    """(best number of topics, [(number of topics, coherence)]); higher is better, the first of equals wins.

    All documents count unless ``sample_rows`` asks for an exact sample of them.  All candidates are trained side by side, and their topic words are
    scored together in one pass over the texts.
    """
    dictionary = build_dictionary(df) if dictionary is None else dictionary
    chosen = materialize(sample_exact(df, sample_rows, key, seed).select("tokens")) if sample_rows else df
    words = candidate_words(chosen, list(dict.fromkeys(topics)), passes, seed, dictionary)
    scores = [(r.model, r.coherence) for r in model_coherence(words, chosen, measure).orderBy("model").collect()]
    return max(scores, key=lambda s: (s[1], -s[0]))[0], scores
