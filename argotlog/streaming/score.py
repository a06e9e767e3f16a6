"""Score a stream of command lines with a fitted model.

Preprocessing and keyword flags are projections, so they need no state and no watermark.  Topics come from the model's table: each
micro-batch joins its distinct terms with it, as a batch of documents does, so its size is no concern of the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.patterns import Rule
from ..operators.risk import flag_keywords
from ..plans.model import TopicModel
from ..plans.preprocess import MIN_TOKENS, preprocess
from ..session import spread, temporary_tables

_BATCH = "batch_id"


def score(
    df: DataFrame,
    model: TopicModel,
    keywords: Sequence[str] | None = None,
    rules: Sequence[Rule] = (),
    min_tokens: int = MIN_TOKENS,
) -> DataFrame:
    """Add the preprocessing columns, ``topic`` and, with keywords, the keyword flags."""
    scored = model.assign(preprocess(df, rules, min_tokens))
    return scored if keywords is None else flag_keywords(scored, keywords)


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to Parquet; ``available_now`` stops after what is there already."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start()


def score_stream(stream: DataFrame, scoring: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write ``scoring`` of each micro-batch, such as ``score`` with a model, as Parquet below ``path``.

    Every batch has a folder of its own, so a batch that is repeated after a failure replaces itself.  A batch of few files is dealt out over all
    cores before its texts are looked at; tables that scoring makes on the way are deleted with the batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        with temporary_tables(batch.sparkSession):
            scoring(spread(batch)).write.mode("overwrite").parquet(f"{path}/{_BATCH}={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def scored_rows(spark: SparkSession, path: str) -> DataFrame:
    """What ``score_stream`` has written so far."""
    return spark.read.parquet(path).drop(_BATCH)
