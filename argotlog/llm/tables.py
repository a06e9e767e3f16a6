"""Tables between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argotlog.session import scratch_path

# For the writing of a table: its shuffle files go when it is written, and rows with long texts reach Python in small batches.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def table(df: DataFrame, label: str = "table", compression: str = "lz4_raw") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage: lost executors cost no more than their
    running tasks.  The shuffle files that went into it are dropped as soon as it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _settings(spark, _WRITING):
        df.write.option("compression", compression).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def drop(*frames: DataFrame) -> None:
    """Delete tables that `table` has written and that no frame in use reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame._scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many leading underscores as keep it apart from ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` as a table with a number for each row, so that repeated rows and null ids stay apart."""
    return table(docs.withColumn(key, F.monotonically_increasing_id()), "keyed", "zstd")


def packed(docs: DataFrame, text: str, carry: list[str], size: int) -> DataFrame:
    """A table of blocks of whole texts, one row each: ``block``, ``c0``, ``c1``, ... (arrays of the ``carry`` columns), ``texts``.

    A block holds about ``size`` bytes of text, or one longer text; null texts are null in it.  Since a block is one row, no task ever
    sees a part of it, and its number stays with it.
    """
    names = [f"c{i}" for i in range(len(carry))]
    fields = docs.select(*(F.col(f"`{c}`") for c in carry)).schema
    schema = ", ".join(["block bigint", *(f"{n} array<{f.dataType.simpleString()}>" for n, f in zip(names, fields, strict=True)), "texts array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, used = TaskContext.get().partitionId() << 33, [], 0

        def row() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            one = pa.array([0, whole.num_rows], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.ListArray.from_arrays(one, c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)) for c in whole.columns)], names=["block", *names, "texts"])

        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy())
            start = 0
            while start < b.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = min(int(np.searchsorted(ends, before + size - used)) + 1, b.num_rows)
                held.append(b.slice(start, stop - start))
                used += int(ends[stop - 1]) - before
                start = stop
                if used >= size:
                    yield row()
                    block, held, used = block + 1, [], 0
        if held:
            yield row()

    chosen = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)), F.col(f"`{text}`").cast("string").alias("texts"))
    return table(chosen.mapInArrow(run, schema), "blocks", "zstd")
