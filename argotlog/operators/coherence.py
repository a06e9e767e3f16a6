"""Topic coherence from word co-occurrence counts (Röder, Both, Hinneburg: Exploring the Space of Topic Coherence Measures, 2015).

Topic words come as a frame (model, topic, rank, term), so that one pass over the texts serves any number of candidate models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12
PIECE = 512
# Width of the sliding window per measure; None counts whole documents.
WINDOWS: dict[str, int | None] = {"c_v": 110, "c_npmi": 10, "c_uci": 10, "u_mass": None}


def window_contents(df: DataFrame, words: Sequence[str], window: int | None, tokens: str = "tokens") -> DataFrame:
    """(content, n): the sets of ``words`` seen in boolean sliding windows, and how many windows have that set.

    A document no longer than the window is one window.  A long one is cut into pieces of ``PIECE`` windows first, which share what a window
    reaches over, so a row in flight never holds more than a piece.  Neighbouring windows and repeated documents mostly have the same
    content, so they collapse inside the task, before the shuffle and before pairs are formed.
    """
    marked = F.transform(tokens, lambda t: F.when(t.isin(*words), t))
    seen = F.sort_array(F.array_distinct(F.filter(tokens, lambda t: t.isin(*words))))
    if window is None:
        contents = df.select(seen.alias("content"))
    else:
        # Windows begin at 1 .. last; a piece holds the tokens of the windows that begin at start .. start + PIECE - 1.
        last = F.greatest(F.size("marked") - window, F.lit(0)) + 1
        pieces = F.transform(F.sequence(F.lit(1), last, F.lit(PIECE)), lambda start: F.slice("marked", start, F.lit(PIECE + window - 1)))
        within = F.sequence(F.lit(1), F.greatest(F.size("piece") - window, F.lit(0)) + 1)
        content = F.transform(within, lambda start: F.array_sort(F.array_compact(F.array_distinct(F.slice("piece", start, F.lit(window))))))
        contents = df.select(F.when(F.size(tokens) <= window, seen).otherwise(marked).alias("marked")).select(F.explode(pieces).alias("piece"))
        # A piece of one window, mostly a short document, is its own content once it is sorted and without nulls.
        whole = F.array(F.sort_array(F.array_distinct(F.array_compact("piece"))))
        contents = contents.select(F.explode(F.when(F.size("piece") <= window, whole).otherwise(content)).alias("content"))
    return contents.groupBy("content").agg(F.count(F.lit(1)).alias("n"))


def co_occurrences(contents: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(a, b, n) for a <= b: windows with both words; a = b counts the windows with the word, nulls count all windows.

    With ``topics`` only pairs of words of one topic are counted: the others leave inside the task, before the shuffle.
    """
    pairs = F.flatten(
        F.transform(
            "content",
            lambda a, i: F.transform(
                F.slice("content", i + 1, F.size("content")), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    everything = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    found = contents.select(F.inline(F.concat(everything, pairs)), "n")
    if topics is not None:
        # A report-sized table: the words of each topic with each other.
        x, y = topics.select("model", "topic", F.col("term").alias("a")), topics.select("model", "topic", F.col("term").alias("b"))
        wanted = x.join(y, ["model", "topic"]).where("a <= b").select("a", "b").distinct()
        nothing = wanted.sparkSession.createDataFrame([(None, None)], "a string, b string")
        wanted = wanted.unionByName(nothing).select(F.col("a").alias("wa"), F.col("b").alias("wb"))
        found = found.join(wanted, F.col("a").eqNullSafe(F.col("wa")) & F.col("b").eqNullSafe(F.col("wb")), "left_semi")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _pairs(topics: DataFrame, counts: DataFrame) -> DataFrame:
    """Ordered word pairs of each topic with p(a), p(b), p(a, b) and raw counts; a topic has a handful of words."""
    total = counts.filter("a IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    single = F.broadcast(counts.filter("a = b").select(F.col("a").alias("word"), F.col("n").alias("n_word")))
    both = counts.filter("a IS NOT NULL")
    left = topics.select("model", "topic", F.col("rank").alias("i"), F.col("term").alias("x"))
    right = topics.select("model", "topic", F.col("rank").alias("j"), F.col("term").alias("y"))
    pair = left.join(right, ["model", "topic"]).withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y"))
    return (
        pair.join(both, ["a", "b"], "left")
        .join(single.select(F.col("word").alias("x"), F.col("n_word").alias("n_x")), "x", "left")
        .join(single.select(F.col("word").alias("y"), F.col("n_word").alias("n_y")), "y", "left")
        .select(
            "model", "topic", "i", "j",
            F.coalesce("n", F.lit(0)).alias("n_xy"),
            F.coalesce("n_x", F.lit(0)).alias("n_x"),
            F.coalesce("n_y", F.lit(0)).alias("n_y"),
            total.alias("total"),
        )
    )


def _log_ratio() -> Column:
    p_xy, p_x, p_y = (F.col(c) / F.col("total") for c in ("n_xy", "n_x", "n_y"))
    # A word that never occurs has no association with anything.
    return F.when((F.col("n_x") > 0) & (F.col("n_y") > 0), F.ln((p_xy + EPSILON) / (p_x * p_y))).otherwise(F.lit(0.0))


def _npmi() -> Column:
    return _log_ratio() / -F.ln(F.col("n_xy") / F.col("total") + EPSILON)


def topic_coherence(topics: DataFrame, counts: DataFrame, measure: str = "c_v") -> DataFrame:
    """(model, topic, coherence) for ``c_v``, ``c_npmi``, ``c_uci`` or ``u_mass``."""
    pairs = _pairs(topics, counts)
    if measure == "u_mass":
        scored = pairs.filter("j < i AND n_y > 0").withColumn("score", F.ln((F.col("n_xy") + 1) / F.col("n_y")))
    elif measure in ("c_npmi", "c_uci"):
        scored = pairs.filter("i <> j").withColumn("score", _npmi() if measure == "c_npmi" else _log_ratio())
    elif measure == "c_v":
        scored = _indirect_cosine(pairs.withColumn("npmi", _npmi()))
    else:
        raise ValueError(f"unknown coherence measure {measure!r}; known: {', '.join(WINDOWS)}")
    return scored.groupBy("model", "topic").agg(F.avg("score").alias("coherence"))


def _indirect_cosine(pairs: DataFrame) -> DataFrame:
    """Cosine between each word's NPMI vector and the sum of the vectors of its topic."""
    sums = pairs.groupBy("model", "topic", "j").agg(F.sum("npmi").alias("total_npmi"))
    joined = pairs.select("model", "topic", "i", "j", "npmi").join(sums, ["model", "topic", "j"])
    dot, own, whole = (
        F.sum(F.col("npmi") * F.col("total_npmi")),
        F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))),
        F.sqrt(F.sum(F.col("total_npmi") * F.col("total_npmi"))),
    )
    cosine = F.when((own > 0) & (whole > 0), dot / (own * whole)).otherwise(F.lit(0.0))
    return joined.groupBy("model", "topic", "i").agg(cosine.alias("score"))


def model_coherence(topics: DataFrame, df: DataFrame, measure: str = "c_v", tokens: str = "tokens") -> DataFrame:
    """(model, coherence): the mean over the topics of each model, from one pass over the texts."""
    if measure not in WINDOWS:
        raise ValueError(f"unknown coherence measure {measure!r}; known: {', '.join(WINDOWS)}")
    # Topic words are a report-sized table: models x topics x words per topic.
    words = [row.term for row in topics.select("term").distinct().collect()]
    counts = co_occurrences(window_contents(df, words, WINDOWS[measure], tokens), topics)
    return topic_coherence(topics, counts, measure).groupBy("model").agg(F.avg("coherence").alias("coherence"))
