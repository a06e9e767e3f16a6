"""Whole-word search for any number of keywords, which are a table and not a pattern.

A text is cut into pieces: runs of word characters and runs of others, in turn.  A keyword stands as a whole word exactly where its own pieces are consecutive pieces of
the text: one that begins or ends with punctuation needs a word on its other side, which a run that ends there has.  So the first piece of a keyword is an index: places of texts
are joined with it, the few candidates are compared piece by piece, and in each row the matches are taken from left to right, the shortest first, as a search with one pattern of all
keywords would find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import WORD
from ..session import materialize

# A table of keywords up to this size goes to all tasks; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
_PIECES = rf"{WORD}++|(?:(?!{WORD})[\s\S])++"


def pieces(text: Column) -> Column:
    """Runs of word characters and of others, in their order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECES), F.lit(0))


def _index(keywords: DataFrame, case_sensitive: bool) -> tuple[DataFrame, int]:
    """(table of piece, keyword, parts, ends_open: whether a word must follow; pieces of the longest keyword)."""
    word = F.col("keyword") if case_sensitive else F.lower("keyword")
    distinct = keywords.where("keyword IS NOT NULL AND keyword <> ''").select(word.alias("keyword")).distinct()
    parts = distinct.withColumn("parts", pieces(F.col("keyword")))
    found = materialize(
        parts.select(F.get("parts", F.lit(0)).alias("piece"), "keyword", "parts", (~F.element_at("parts", -1).rlike(WORD)).alias("ends_open"), (~F.get("parts", F.lit(0)).rlike(WORD)).alias("begins_open"))
    )
    size = found.agg(F.coalesce(F.sum(3 * F.octet_length("keyword") + 64), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.size("parts")), F.lit(1)).alias("most")).first()
    return (F.broadcast(found) if size["bytes"] <= BROADCAST_BYTES else found), size["most"]


def _leftmost(found: Column) -> Column:
    """Of (start, n, keyword) in order, those that do not begin inside one taken before."""
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("taken"))
    last = F.aggregate(
        found,
        start,
        lambda a, m: F.when(m["at"] >= a["upto"], F.struct((m["at"] + m["n"]).alias("upto"), F.concat(a["taken"], F.array(m["keyword"])).alias("taken"))).otherwise(a),
    )
    return last["taken"]


def matches_of_table(df: DataFrame, keywords: DataFrame, key: str, text: str, case_sensitive: bool = True, name: str = "matches") -> DataFrame:
    """Add ``name``: all occurrences in ``text`` of the ``keyword`` column of ``keywords`` from left to right, as `keyword_matches` gives them for a list.

    ``key`` tells the rows of ``df`` apart.  Null texts and an empty table of keywords give empty arrays.
    """
    index, most = _index(keywords, case_sensitive)
    body = F.col(text) if case_sensitive else F.lower(text)
    cut = df.select(key, pieces(body).alias("_pieces"))
    # One place more than the longest keyword has, to see whether a word follows.
    places = cut.select(key, "_pieces", F.posexplode("_pieces").alias("at", "piece")).select(key, "at", "piece", F.slice("_pieces", F.col("at") + 1, most + 1).alias("ahead"))
    n = F.size("parts")
    same = (F.slice("ahead", 1, n) == F.col("parts")) & (~F.col("ends_open") | (F.size("ahead") > n)) & (~F.col("begins_open") | (F.col("at") > 0))
    found = places.join(index, "piece").where(same).select(key, F.struct("at", n.alias("n"), "keyword").alias("match"))
    by_row = found.groupBy(key).agg(_leftmost(F.array_sort(F.collect_list("match"))).alias(name))
    return df.join(by_row, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
