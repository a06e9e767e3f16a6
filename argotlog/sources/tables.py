"""Readers and writers for command-line tables.

A corpus is any frame with a text column, by convention ``command_line``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import command_line_fields
from .records import read_column

COMMAND_COLUMN = "command_line"

# --- Fixed values: cell texts that stand for a missing value. ---
MISSING_VALUES: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def require_column(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise KeyError(f"Column '{column}' not found. Available columns: {', '.join(df.columns)}")


def keep_column(df: DataFrame, column: str = COMMAND_COLUMN) -> DataFrame:
    """Keep one column, under the standard name."""
    require_column(df, column)
    return df.select(F.col(f"`{column}`").alias(COMMAND_COLUMN))


def drop_missing(df: DataFrame, column: str = COMMAND_COLUMN) -> DataFrame:
    return df.na.drop(subset=[column])


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    column: str = COMMAND_COLUMN,
    missing_values: Sequence[str] = MISSING_VALUES,
    with_file: bool = False,
) -> DataFrame:
    """Command lines of one or many CSV files with a header, rows without a value dropped.

    Every file is read by its own header, so the column may be at another place in each; a file without it is an error.
    Quotes inside a quoted cell are doubled and a backslash is an ordinary character, as Windows paths need; quoted cells may hold line ends, and big files are
    read by many tasks all the same.  ``with_file`` adds the file each row came from as ``source_file``.
    """
    found = read_column(spark, [paths] if isinstance(paths, str) else list(paths), column)
    value = F.col("value")
    kept = [F.when(~value.isin(*missing_values), value).alias(COMMAND_COLUMN)]
    if with_file:
        kept.append(F.col("file").alias("source_file"))
    return drop_missing(found.select(*kept))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write CSV that :func:`read_csv` reads back unchanged; ``single_file`` is for small result tables."""
    out = df.coalesce(1) if single_file else df
    # Without the two white-space options Spark would trim every value.
    out.write.mode("overwrite").csv(
        path,
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def from_messages(df: DataFrame, column: str = "message") -> DataFrame:
    """Command lines found in event message texts; messages without one are dropped, other columns are kept."""
    require_column(df, column)
    # Exploding the first field drops the other messages; a filter on the field would search every message twice.
    first = F.explode(F.slice(command_line_fields(F.col(column)), 1, 1)).alias(COMMAND_COLUMN)
    return df.select(*[c for c in df.columns if c not in (column, COMMAND_COLUMN)], first)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add a unique key.  It depends on the physical layout, so write or checkpoint the result before reusing it."""
    return df.withColumn(name, F.monotonically_increasing_id())
