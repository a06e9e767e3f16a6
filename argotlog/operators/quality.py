"""Checks and filters on a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.tables import COMMAND_COLUMN, drop_missing, require_column

MIN_ROWS = 10
MAX_DUPLICATE_RATIO = 0.95


def drop_missing_observed(df: DataFrame, column: str = COMMAND_COLUMN) -> tuple[DataFrame, Observation]:
    """Rows with a value, and an observation that counts the dropped ones while an action runs (``dropped``)."""
    seen = Observation()
    dropped = F.count_if(F.col(column).isNull()).alias("dropped")
    return drop_missing(df.observe(seen, dropped), column), seen


def keep_long_enough(df: DataFrame, tokens: str = "tokens", min_tokens: int = 2) -> DataFrame:
    return df.filter(F.size(tokens) >= min_tokens)


def text_key(text: Column) -> Column:
    """32-byte SHA-256 key that stands for a text in shuffles, where the text itself could be of any size."""
    return F.unhex(F.sha2(text, 256))


def corpus_quality(df: DataFrame, column: str = COMMAND_COLUMN, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one per value of ``by``: size, filled and distinct values, share of duplicates, and the verdict on them.

    Copies are combined before the shuffle, and the shuffle carries fixed-size keys and not texts.  Nulls count as one
    distinct value.
    """
    require_column(df, column)
    counts = df.select(*by, text_key(F.col(column)).alias("key")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("key").alias("n_valid"),
        F.countDistinct("key").alias("n_keys"),
    )
    distinct = F.col("n_keys") + F.when(F.col("n_rows") > F.col("n_valid"), 1).otherwise(0)
    ratio = F.when(F.col("n_rows") > 0, (F.col("n_rows") - F.col("n_distinct")) / F.col("n_rows")).otherwise(0.0)
    return (
        counts.withColumn("n_distinct", distinct)
        .withColumn("duplicate_ratio", ratio)
        .select(
            *by,
            "n_rows",
            "n_valid",
            "n_distinct",
            "duplicate_ratio",
            (F.col("n_valid") >= MIN_ROWS).alias("is_valid"),
            (F.col("duplicate_ratio") > MAX_DUPLICATE_RATIO).alias("mostly_duplicates"),
        )
    )


def require_usable(df: DataFrame, column: str = COMMAND_COLUMN):
    """Raise ``ValueError`` for a corpus too small to analyse, else return its quality row."""
    row = corpus_quality(df, column).first()
    check_usable(row.n_rows, row.n_valid)
    return row


def check_usable(rows: int, valid: int, name: str = "the corpus") -> None:
    if rows == 0:
        raise ValueError(f"{name} is empty")
    if valid < MIN_ROWS:
        raise ValueError(f"too few valid command lines in {name}: {valid} (at least {MIN_ROWS} needed)")
