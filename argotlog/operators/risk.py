"""Risk of a topic: how much dual-use software its command lines mention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import keyword_matches
from ..sources.tables import COMMAND_COLUMN
from .keyword_table import matches_of_table
from .topics import top_per_group

# --- Fixed values: the weights of the three parts of the score. ---
WEIGHT_PERCENTAGE = 0.5
WEIGHT_DISTINCT = 5.0
WEIGHT_PER_DOCUMENT = 10.0


def with_matches(
    df: DataFrame, keywords: Sequence[str] | DataFrame, text: str, case_sensitive: bool, key: str, name: str = "matches"
) -> DataFrame:
    """Add the matches of a list of keywords, or of a table (keyword) of any size, for which ``key`` has to tell the rows apart."""
    if isinstance(keywords, DataFrame):
        return matches_of_table(df, keywords, key, text, case_sensitive, name)
    return df.withColumn(name, keyword_matches(F.col(text), keywords, case_sensitive))


def flag_keywords(
    df: DataFrame, keywords: Sequence[str] | DataFrame, text: str = COMMAND_COLUMN, case_sensitive: bool = True, key: str = "row_id"
) -> DataFrame:
    """Add ``contains_lolbas`` and ``lolbas_count``, from one search of each text."""
    found = with_matches(df, keywords, text, case_sensitive, key, "_matches")
    return found.withColumn("lolbas_count", F.size("_matches")).drop("_matches").withColumn("contains_lolbas", F.col("lolbas_count") > 0)


def keyword_counts(
    df: DataFrame,
    keywords: Sequence[str] | DataFrame,
    topic: str = "topic",
    text: str = COMMAND_COLUMN,
    case_sensitive: bool = True,
    key: str = "row_id",
) -> DataFrame:
    """(topic, keyword, n_docs, n_keyword_docs, n_matches), the base of all risk figures.

    Every row gives one record without keyword that counts the document, and one record per match.  Combined inside each task
    there are at most topics x keywords records, so the shuffle is tiny whatever the size of a topic.
    """
    matches = with_matches(df, keywords, text, case_sensitive, key).select(topic, "matches")
    document = F.struct(
        F.lit(None).cast("string").alias("keyword"),
        F.lit(1).alias("docs"),
        (F.size("matches") > 0).cast("int").alias("hits"),
        F.lit(0).alias("uses"),
    )
    per_match = F.transform(
        "matches",
        lambda m: F.struct(m.alias("keyword"), F.lit(0).alias("docs"), F.lit(0).alias("hits"), F.lit(1).alias("uses")),
    )
    records = matches.select(topic, F.inline(F.concat(F.array(document), per_match)))
    return records.groupBy(topic, "keyword").agg(
        F.sum("docs").alias("n_docs"), F.sum("hits").alias("n_keyword_docs"), F.sum("uses").alias("n_matches")
    )


def topic_risk(counts: DataFrame, topic: str = "topic") -> DataFrame:
    """Risk figures per topic from :func:`keyword_counts`, riskiest first."""
    total, hits = F.sum("n_docs"), F.sum("n_keyword_docs")
    figures = counts.groupBy(topic).agg(
        total.alias("total_count"),
        hits.alias("lolbas_count"),
        (hits * 100.0 / total).alias("lolbas_percentage"),
        F.count("keyword").alias("unique_lolbas"),
        (F.sum("n_matches") / total).alias("avg_lolbas_per_doc"),
    )
    density = (
        F.col("lolbas_percentage") * WEIGHT_PERCENTAGE
        + F.col("unique_lolbas") * WEIGHT_DISTINCT
        + F.col("avg_lolbas_per_doc") * WEIGHT_PER_DOCUMENT
    )
    return figures.withColumn("lolbas_density", density).orderBy(F.desc("lolbas_density"), topic)


def score_topics(
    df: DataFrame,
    keywords: Sequence[str] | DataFrame,
    topic: str = "topic",
    text: str = COMMAND_COLUMN,
    case_sensitive: bool = True,
    key: str = "row_id",
) -> DataFrame:
    """Risk figures per topic, riskiest first.

    ``lolbas_count`` is the number of documents with a keyword; ``unique_lolbas`` counts the keywords found in them.
    """
    return topic_risk(keyword_counts(df, keywords, topic, text, case_sensitive, key), topic)


def top_keywords(counts: DataFrame, k: int = 5, topic: str = "topic") -> DataFrame:
    """(topic, rank, keyword, n): the k most used keywords per topic, from :func:`keyword_counts`."""
    used = counts.filter("keyword IS NOT NULL").select(topic, "keyword", F.col("n_matches").alias("n"))
    return top_per_group(used, topic, "keyword", k).select(topic, "rank", "keyword", "n")
