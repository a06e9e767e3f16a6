"""Term statistics: bags of words, vocabulary, document frequencies, and the split-off of rows with rare terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, words
from ..session import materialize

# Bounds on what is broadcast when rare terms are looked up: at most this many terms of at most this many characters.
COMMON_TERMS = 65_536
COMMON_TERM_CHARS = 128


def term_counts(tokens: Column) -> Column:
    """Histogram of a token array as an array of (term, n), built inside the row.

    The array is sorted and cut where the term changes, so the cost follows n log n even for very long documents
    and no shuffle is needed to count within a document.
    """

    def cut(ordered: Column) -> Column:
        positions = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        starts = F.filter(positions, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, k: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(s, k + 1), F.size(ordered)) - start).cast("bigint").alias("n"),
                ),
            ),
        )

    return let(F.array_sort(tokens), cut)


def exploded(df: DataFrame, *keep: str, items: str | Column = "tokens", name: str = "term") -> DataFrame:
    """One row per item.  An outer explode with a filter on the item: for a plain explode of a computed column Catalyst adds a filter on
    the array's size, moves it below the projection, and so computes the array twice."""
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def bag_of_words(df: DataFrame, key: str = "row_id", tokens: str = "tokens") -> DataFrame:
    """(key, term, n): how often each term occurs in each document, without a shuffle."""
    return df.select(key, F.inline(term_counts(F.col(tokens))).alias("term", "n"))


def document_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, df): in how many documents a term occurs; counts are combined before the shuffle."""
    terms = exploded(df, items=F.array_distinct(tokens))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, df, cf): distinct terms with document and collection frequency, in one shuffle."""
    counted = df.select(F.inline(term_counts(F.col(tokens))).alias("term", "n"))
    return counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


def _occurrences(df: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, term) pairs, (term, df), and the common terms that are safe to broadcast.

    A term is common if it has at least 1 / COMMON_TERMS of all occurrences.  There can be no more than COMMON_TERMS of those,
    and their length is limited too, so the broadcast has a fixed bound for any input.  In return no other term
    has more than that share of the occurrences, so a shuffle join on the remaining terms has no heavy key
    (an over-long term aside, which the adaptive skew join splits).
    """
    # Read twice by every caller, for the frequencies and for the look-up: a table, so that no text is split twice.
    occurrences = materialize(exploded(df, key, items=F.array_distinct(words(F.col(text)))))
    frequency = occurrences.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = frequency.agg(F.sum("df")).scalar()
    # One comparison with the count in it: a separate test of the length would be pushed below the aggregation, and the shuffle of the
    # frequencies could no longer be shared.
    common = frequency.filter(F.col("df") * COMMON_TERMS >= F.when(F.length("term") <= COMMON_TERM_CHARS, total))
    return occurrences, frequency, common


def rarest_term(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, min_df): the document frequency of the rarest term of every row that has a term.

    The frequency of a term has to get back to every row with that term.  The common terms, where most occurrences are, are
    answered from a broadcast; only the others are joined by shuffle.
    """
    occurrences, frequency, common = _occurrences(df, text, key)
    looked_up = occurrences.join(F.broadcast(common.withColumnRenamed("df", "common_df")), "term", "left")
    answered = looked_up.filter("common_df IS NOT NULL").select(key, F.col("common_df").alias("df"))
    open_terms = looked_up.filter("common_df IS NULL").select(key, "term")
    found = answered.union(open_terms.join(frequency, "term").select(key, "df"))
    return found.groupBy(key).agg(F.min("df").alias("min_df"))


def flag_rare(df: DataFrame, text: str, key: str, min_df: int = 5) -> DataFrame:
    """Add ``min_df`` (null for a blank text) and ``is_anomaly``: some term occurs in fewer than ``min_df`` rows."""
    return df.join(rarest_term(df, text, key), key, "left").withColumn(
        "is_anomaly", F.coalesce(F.col("min_df") < min_df, F.lit(False))
    )


def rows_with_rare_terms(df: DataFrame, text: str, key: str, min_df: int = 5) -> DataFrame:
    """Keys of the rows with a term that occurs in fewer than ``min_df`` rows.

    Common terms leave before the shuffle; a rare term has fewer than ``min_df`` rows by definition.
    """
    occurrences, frequency, common = _occurrences(df, text, key)
    not_rare = common.filter(F.col("df") >= min_df).select("term")
    rest = occurrences.join(F.broadcast(not_rare), "term", "left_anti")
    rare = frequency.filter(F.col("df") < min_df).select("term")
    return rest.join(rare, "term", "left_semi").select(key).distinct()


def split_rare(df: DataFrame, text: str, key: str, min_df: int = 5) -> tuple[DataFrame, DataFrame]:
    """(normal, anomalies): anomalies are the rows with a term that occurs in fewer than ``min_df`` rows.

    The keys of the anomalies are computed here and now, once for both results.
    """
    rare = materialize(rows_with_rare_terms(df, text, key, min_df))
    return df.join(rare, key, "left_anti"), df.join(rare, key, "left_semi")
