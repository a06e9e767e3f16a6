"""Readable names for topics.  All topics are named in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import capitalize, executable_title, join_words
from .terms import document_frequency
from .topics import category, top_executable

NAME_TOKENS = 15
NAME_WORDS = 3


def _descriptive(words: Column) -> Column:
    """Words that say something: no placeholder, more than two characters."""
    return F.filter(words, lambda w: ~w.startswith("<") & (F.length(w) > 2))


def _ranked_array(df: DataFrame, group: str, rank: str, value: str, name: str) -> DataFrame:
    """One array per group, in rank order; used on top-k tables only."""
    pairs = F.array_sort(F.collect_list(F.struct(rank, value)))
    return df.groupBy(group).agg(pairs.alias(name)).select(group, F.col(name)[value].alias(name))


def _topic_facts(df: DataFrame) -> DataFrame:
    """(topic, top_tokens, root_command): most frequent tokens in order, and most frequent root, from one pass over the rows."""
    root = F.struct(F.lit("root").alias("kind"), F.col("root_command").alias("value"))
    tokens = F.transform("tokens", lambda t: F.struct(F.lit("token").alias("kind"), t.alias("value")))
    items = df.select("topic", F.inline(F.concat(F.array(root), tokens)))
    counts = items.groupBy("topic", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("topic", "kind").orderBy(F.col("value").isNull(), F.desc("n"), "value")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NAME_TOKENS)
    ranked = F.array_sort(F.collect_list(F.when(F.col("kind") == "token", F.struct("rank", "value"))))
    first_root = F.max(F.when((F.col("kind") == "root") & (F.col("rank") == 1), F.col("value")))
    # At most NAME_TOKENS rows per topic and kind are left here.
    facts = best.groupBy("topic").agg(ranked.alias("ranked"), first_root.alias("root_command"))
    return facts.select("topic", F.col("ranked.value").alias("top_tokens"), "root_command")


def topic_names(df: DataFrame, topic_words: DataFrame | None = None, num_topics: int | None = None) -> DataFrame:
    """(topic, topic_summary) from what the topic's rows do.

    ``df`` has topic, root_command and tokens; ``topic_words`` is (topic, rank, term) and serves topics with neither a root nor a
    category.  With ``num_topics`` topics without rows are named too.
    """
    facts = _topic_facts(df).withColumn("has_rows", F.lit(True))
    if num_topics is not None:
        every = df.sparkSession.range(0, num_topics, 1, 1).select(F.col("id").cast("int").alias("topic"))
        facts = every.join(facts, "topic", "full")
    if topic_words is not None:
        arrays = _ranked_array(topic_words.filter("rank <= 10"), "topic", "rank", "term", "words")
        facts = facts.join(F.broadcast(arrays), "topic", "left")
    else:
        facts = facts.withColumn("words", F.array().cast("array<string>"))

    root = F.col("root_command")
    other_tokens = F.filter(
        F.coalesce("top_tokens", F.array().cast("array<string>")),
        lambda t: root.isNull() | ((t != root) & (t != F.lower(root))),
    )
    facts = facts.withColumn("other_tokens", other_tokens)
    facts = facts.withColumn("category", capitalize(category(F.col("other_tokens"))))
    facts = facts.withColumn("descriptor", F.get(_descriptive(F.col("other_tokens")), F.lit(0)))
    program = capitalize(F.replace(root, F.lit(".exe"), F.lit("")))
    has_root = root.isNotNull() & (root != "")
    words = join_words(F.slice(_descriptive(F.coalesce("words", F.array().cast("array<string>"))), 1, NAME_WORDS))
    name = (
        F.when(F.col("has_rows").isNull(), F.concat(F.lit("Topic "), F.col("topic"), F.lit(": Empty")))
        .when(has_root & F.col("category").isNotNull(), F.concat_ws(" ", program, "category", F.lit("Operations")))
        .when(has_root & F.col("descriptor").isNotNull(), F.concat(program, F.lit(" "), capitalize(F.col("descriptor")), F.lit(" Activity")))
        .when(has_root, F.concat(program, F.lit(" Commands")))
        .when(F.col("category").isNotNull(), F.concat("category", F.lit(" Operations")))
        .otherwise(F.concat(F.lit("Topic "), F.col("topic"), F.lit(": "), capitalize(words)))
    )
    return facts.select("topic", name.alias("topic_summary"))


def tfidf_labels(df: DataFrame, topic_words: DataFrame, top_n: int = 10) -> DataFrame:
    """(topic, topic_summary): the top word that is most specific to the topic, with the topic's usual executable.

    ``topic_words`` is (topic, rank, term, weight).  A word's weight in the topic is multiplied by ln(N / (1 + df)), which is negative
    for a word in every document.
    """
    candidates = topic_words.filter(F.col("rank") <= top_n)
    # Topic words are a report-sized table, so the vocabulary is searched for them and not the other way round.
    frequency = document_frequency(df).join(F.broadcast(candidates.select("term").distinct()), "term", "left_semi")
    total = df.agg(F.count(F.lit(1))).scalar()
    scored = candidates.join(F.broadcast(frequency), "term", "left").withColumn(
        "score", F.col("weight") * F.ln(total / (1 + F.coalesce("df", F.lit(0))))
    )
    best = scored.groupBy("topic").agg(F.min_by("term", F.struct(-F.col("score"), F.col("rank"))).alias("term"))
    named = best.join(top_executable(df).select("topic", executable_title(F.col("token")).alias("program")), "topic", "left")
    base = capitalize(F.col("term"))
    has_program = F.coalesce(F.col("program") != "", F.lit(False))
    label = (
        F.when(has_program & F.lower(base).contains(F.lower("program")), F.concat(base, F.lit(" Activity")))
        .when(has_program, F.concat("program", F.lit(" ("), base, F.lit(")")))
        .otherwise(F.concat(F.lit("Topic: "), base))
    )
    return named.select("topic", label.alias("topic_summary"))
