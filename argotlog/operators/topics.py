"""Aggregates over rows with an assigned topic (or any other small set of labels).

There is no loop over topics: every result comes from one grouped job over all of them.  Counts are combined inside each
task first, so a topic with most of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import let
from .terms import exploded

UNASSIGNED = -1


def topic_sizes(df: DataFrame, topic: str = "topic") -> DataFrame:
    """(topic, n_docs, percent), sorted by topic."""
    sizes = df.groupBy(topic).agg(F.count(F.lit(1)).alias("n_docs"))
    total = sizes.agg(F.sum("n_docs")).scalar()
    return sizes.select(topic, "n_docs", (F.col("n_docs") * 100.0 / total).alias("percent")).orderBy(topic)


def topic_sizes_with_empty(df: DataFrame, num_topics: int, topic: str = "topic") -> DataFrame:
    """(topic, n_docs) for topics 0 .. num_topics - 1, empty ones included."""
    sizes = df.groupBy(topic).agg(F.count(F.lit(1)).alias("n_docs"))
    all_topics = df.sparkSession.range(0, num_topics, 1, 1).select(F.col("id").cast("int").alias(topic))
    return all_topics.join(sizes, topic, "left").select(topic, F.coalesce("n_docs", F.lit(0).cast("bigint")).alias("n_docs"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(column, n): the k most frequent values, ties by value."""
    return (
        df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last()).limit(k)
    )


def top_per_group(counts: DataFrame, group: str, value: str, k: int, n: str = "n") -> DataFrame:
    """Rank 1 .. k per group by count, ties by value; each task keeps k rows per group before the shuffle."""
    order = W.partitionBy(group).orderBy(F.desc(n), F.asc(value))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def token_counts(df: DataFrame, topic: str = "topic", tokens: str = "tokens") -> DataFrame:
    """(topic, token, n) over all tokens of the documents of a topic."""
    return exploded(df, topic, items=tokens, name="token").groupBy(topic, "token").agg(F.count(F.lit(1)).alias("n"))


def top_tokens(df: DataFrame, k: int = 15, topic: str = "topic", tokens: str = "tokens") -> DataFrame:
    """(topic, rank, token, n): the k most frequent tokens of each topic."""
    return top_per_group(token_counts(df, topic, tokens), topic, "token", k).select(topic, "rank", "token", "n")


def most_frequent(counts: DataFrame, group: str, value: str, n: str = "n") -> DataFrame:
    """(group, value, n): the value with the highest count per group, the smallest one on ties."""
    best = F.min_by(F.struct(value, n), F.struct(-F.col(n), F.col(value)))
    return counts.groupBy(group).agg(best.alias("best")).select(group, "best.*")


def top_executable(df: DataFrame, topic: str = "topic", tokens: str = "tokens") -> DataFrame:
    """(topic, token, n): the most frequent token ending in ``.exe`` per topic."""
    lowered = F.transform(tokens, F.lower)
    programs = exploded(df, topic, items=F.filter(lowered, lambda t: t.endswith(".exe")), name="token")
    return most_frequent(programs.groupBy(topic, "token").agg(F.count(F.lit(1)).alias("n")), topic, "token")


def top_roots(df: DataFrame, topic: str = "topic", root: str = "root_command") -> DataFrame:
    """(topic, root, n): the most frequent root executable per topic."""
    counts = df.filter(F.col(root).isNotNull()).groupBy(topic, root).agg(F.count(F.lit(1)).alias("n"))
    return most_frequent(counts, topic, root)


def category(tokens: Column) -> Column:
    """The first activity category with a keyword inside any of the tokens, null if there is none."""

    def mentions(words: Sequence[str]) -> Column:
        return F.exists(tokens, lambda token: token.rlike("|".join(words)))

    return F.coalesce(*[F.when(mentions(words), F.lit(name)) for name, words in P.ACTIVITY_CATEGORIES])


def length_distribution(df: DataFrame, topic: str = "topic", tokens: str = "tokens", exact: bool = True) -> DataFrame:
    """Box statistics of the token count per topic, sorted by topic.

    The exact quartiles are computed from counts per (topic, length), which are as few as there are lengths, however many
    rows a topic has.
    """
    lengths = df.select(topic, F.size(tokens).alias("length"))
    if not exact:
        quartiles = F.percentile_approx("length", [0.25, 0.5, 0.75])
        return _box(lengths.withColumn("n", F.lit(1)), topic, quartiles)
    counts = lengths.groupBy(topic, "length").agg(F.count(F.lit(1)).alias("n"))
    return _box(counts, topic, F.percentile("length", [0.25, 0.5, 0.75], F.col("n")))


def _box(counts: DataFrame, topic: str, quartiles: Column) -> DataFrame:
    n, x = F.col("n"), F.col("length")
    total, first, second = F.sum(n), F.sum(n * x), F.sum(n * x * x)
    # Whole-number sums: the variance needs no second pass and loses no digits to the order of addition.  Their products do not fit 64 bits.
    wide = [s.cast("decimal(19,0)") for s in (total, first, second)]
    variance = (wide[0] * wide[2] - wide[1] * wide[1]).cast("double") / (wide[0] * wide[0]).cast("double")
    return (
        counts.groupBy(topic)
        .agg(
            total.alias("n_docs"),
            F.min(x).alias("min_length"),
            quartiles.alias("quartiles"),
            F.max(x).alias("max_length"),
            (first / total).alias("mean_length"),
            F.sqrt(variance).alias("sd_length"),
        )
        .select(
            topic,
            "n_docs",
            "min_length",
            F.get("quartiles", F.lit(0)).cast("double").alias("q1"),
            F.get("quartiles", F.lit(1)).cast("double").alias("median"),
            F.get("quartiles", F.lit(2)).cast("double").alias("q3"),
            "max_length",
            "mean_length",
            "sd_length",
        )
        .orderBy(topic)
    )


def argmax(weights: Column) -> Column:
    """Index of the largest weight, the lowest on ties; -1 for null, empty or all-zero weights."""

    def first_best(w: Column) -> Column:
        best = F.array_max(w)
        return F.when(best > 0, (F.array_position(w, best) - 1).cast("int")).otherwise(F.lit(UNASSIGNED))

    return let(weights, first_best)


def with_topic_label(df: DataFrame, labels: DataFrame, topic: str = "topic", label: str = "topic_summary") -> DataFrame:
    """Add the label of each row's topic, ``Unassigned`` for topic -1; ``labels`` has one row per topic."""
    named = df.join(F.broadcast(labels.select(topic, label)), topic, "left")
    return named.withColumn(label, F.when(F.col(topic) == UNASSIGNED, "Unassigned").otherwise(F.col(label)))
