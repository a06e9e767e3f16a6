"""Raw command lines to analysed documents: one narrow projection, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import Rule
from ..operators.quality import keep_long_enough
from ..sources.tables import COMMAND_COLUMN, require_column

MIN_TOKENS = 2


def analyse(df: DataFrame, rules: Sequence[Rule] = (), text: str = COMMAND_COLUMN) -> DataFrame:
    """Add ``normalized_command``, ``tokens`` (of the normalised text) and ``root_command`` (of the raw text)."""
    require_column(df, text)
    return (
        df.withColumn("normalized_command", T.normalize(F.col(text), rules))
        .withColumn("tokens", T.tokenize(F.col("normalized_command")))
        .withColumn("root_command", T.root_executable(F.col(text)))
    )


def preprocess(
    df: DataFrame, rules: Sequence[Rule] = (), min_tokens: int = MIN_TOKENS, text: str = COMMAND_COLUMN
) -> DataFrame:
    """The columns of :func:`analyse` for the documents of at least ``min_tokens`` tokens.  Works on streams too.

    The tokens come out of a one-row generator.  A filter on an ordinary computed column is moved below the computation, which then
    runs twice, once for the filter and once for the result.
    """
    require_column(df, text)
    normalized = df.withColumn("normalized_command", T.normalize(F.col(text), rules))
    tokens = F.struct(T.tokenize(F.col("normalized_command")).alias("tokens"))
    tokenized = normalized.select("*", F.inline(F.array(tokens)))
    kept = keep_long_enough(tokenized, "tokens", min_tokens)
    return kept.withColumn("root_command", T.root_executable(F.col(text)))


def enrich(df: DataFrame, examples: DataFrame) -> DataFrame:
    """Append example command lines; ``origin`` tells them from the corpus."""
    corpus = df.withColumn("origin", F.lit("corpus"))
    return corpus.unionByName(examples.withColumn("origin", F.lit("knowledge base")), allowMissingColumns=True)
