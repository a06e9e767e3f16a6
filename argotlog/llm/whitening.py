"""Whitening of embeddings: distributed centred covariance, leading components, projection by a broadcast of bounded size.

Entries become whole numbers, ``floor(64 * c) + 1000000``, so counts, sums and squared distances are exact.  The covariance is centred before
multiplying: one pass for the sums, one for the products.  A task adds up one matrix for all its rows; what is sent on does not depend on their number.
Only the matrix of one row per dimension meets the driver, which finds the eigenpairs (module ``eigen``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argotlog.llm.eigen import leading
from argotlog.llm.words import give_back

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
# A component with less than this share of the largest variance is rounding only, and cannot be scaled to one.
LEAST_SHARE = 1e-11
# Entries of larger size are taken as this size: beyond it, a float has no whole numbers, and sums would not fit 64 bits.
LARGEST = float(1 << 36)
# The broadcast holds the components: at most so many numbers, else the dimension is refused.
BROADCAST_NUMBERS = 1 << 24
_TYPES = "n bigint, deviation decimal(38,0), component int, whitened double"


def _whole(vectors: pa.Array) -> np.ndarray:
    """Matrix of whole numbers, one vector a row; all have the same length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(np.clip(SCALE * flat, -LARGEST, LARGEST)).astype(np.int64) + SHIFT).reshape(len(vectors), -1)


def _pieces(batches: Iterator[pa.RecordBatch], at: int, cells: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        width = len(b.column(at)[0]) if b.num_rows else 1
        step = max(1, cells // max(1, width))
        for begin in range(0, b.num_rows, step):
            part = b.slice(begin, step)
            yield part, _whole(part.column(at))


def _matrix(rows: DataFrame, centred, size: int) -> np.ndarray:
    """Sum over all rows of y y' for the vectors y that ``centred`` makes of a matrix of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in _pieces(batches, 0):
            y = centred(x)
            total += y.T @ y
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])
        give_back()

    summed = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((size, size))
    out[summed["i"], summed["j"]] = summed["v"]
    out[summed["j"], summed["i"]] = summed["v"]
    return out


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``key``, component, n, deviation (decimal), whitened, explained, identity_error.

    Vectors that are null, or hold null, NaN or infinite entries, are left out.  The vectors that are left and have the most common length (the
    longer of equally common ones) are the fit list and get rows; others cannot be compared with them and have one row of nulls besides their key.
    Components without variance are not given, so a table of equal vectors has no component and no row, as has an empty one.  Repeated rows and null keys
    count and are answered each for itself.  Entries above 2^30 in size count as 2^30.  The sign of a component makes its largest entry positive.
    """
    spark = vectors.sparkSession
    # Arrays without null or non-finite entries: a test inside the row.
    x = F.col("v")
    usable = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(usable)
    lengths = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = lengths["size"] if lengths else 0
    if size * size > BROADCAST_NUMBERS:
        raise ValueError(f"vectors of {size} entries need a covariance of more than {BROADCAST_NUMBERS} numbers")
    fit = rows.where(F.size("v") == size)
    single = fit.select("v")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, np.int64)
        for _, whole in _pieces(batches, 0):
            n, total = n + len(whole), total + whole.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size), pa.int32()), pa.array(np.append(n, total), pa.int64())], names=["i", "s"])

    schema = f"key {fit.schema['key'].dataType.simpleString()}, {_TYPES}"
    values, axes, trace, n, total = np.zeros(0), np.zeros((0, size)), 0.0, 0, np.zeros(size, object)
    if size:
        # Sums of tasks are added as decimals: beyond 64 bits they are still exact.
        found = dict(single.mapInArrow(sums, "i int, s bigint").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
        n, total = int(found[-1]), np.array([int(found[i]) for i in range(size)], dtype=object)
        mean = np.array([float(s // n) + float(s % n) / n for s in total])
        covariance = _matrix(single, lambda whole: whole - mean, size) / n
        trace = float(np.trace(covariance))
        values, axes = leading(covariance, components)
        kept = values > LEAST_SHARE * max(values[0], 0)
        values, axes = values[kept], axes[kept]
    k = len(values)
    if not k:
        nothing = spark.createDataFrame([], schema)
        out = nothing.unionByName(rows.where(F.size("v") != size).select("key").withColumns({c: F.lit(None).cast(nothing.schema[c].dataType) for c in nothing.columns[1:]}))
        return out.select(F.col("key").alias(key), "component", "n", "deviation", "whitened", F.lit(None).cast("double").alias("explained"), F.lit(None).cast("double").alias("identity_error"))
    axis = axes / np.sqrt(values)[:, None]
    sent = spark.sparkContext.broadcast((mean, axis, n, [int(s) for s in total]))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axis, n, total = sent.value
        base = np.array([s // n for s in total], np.int64)
        rest = np.array([s % n for s in total], np.int64)
        for part, whole in _pieces(batches, 1, 1 << 18):
            near = whole - base
            # n x - S is n (x - base) - rest: in 64 bits where its squares are sure to fit, else in numbers of any size.
            if (n * (float(np.abs(near).max(initial=0)) + 1)) ** 2 * near.shape[1] < 2.0**62:
                deviation = ((n * near - rest) ** 2).sum(axis=1).tolist()
            else:
                deviation = [int(d) for d in ((n * near.astype(object) - rest.astype(object)) ** 2).sum(axis=1)]
            shape = len(whole), len(axis)
            number = np.broadcast_to(np.arange(shape[0])[:, None], shape).ravel()
            scores = ((whole - mean) @ axis.T).ravel()
            exact = pa.array(deviation, pa.int64()).cast(pa.decimal128(38, 0)) if not deviation or max(deviation) < 2**63 else _decimals(deviation)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(number)), pa.array(np.full(len(number), n), pa.int64()), exact.take(pa.array(number)), pa.array(np.broadcast_to(np.arange(1, shape[1] + 1), shape).ravel(), pa.int32()), pa.array(scores)],
                names=["key", "n", "deviation", "component", "whitened"],
            )
        give_back()

    # Checked on the projected values themselves: their covariance should be the identity.
    check = _matrix(single, lambda whole: (whole - mean) @ axis.T, k) / n
    error = float(np.abs(check - np.eye(k)).max())
    shares = F.get(F.array(*(F.lit(float(v / trace)) for v in values)), F.col("component") - 1)
    answered = fit.select("key", "v").mapInArrow(project, schema)
    odd = rows.where(F.size("v") != size).select("key").withColumns({c: F.lit(None).cast(answered.schema[c].dataType) for c in answered.columns[1:]})
    every = answered.unionByName(odd)
    return every.select(F.col("key").alias(key), "component", "n", "deviation", "whitened", shares.alias("explained"), F.when(F.col("component").isNotNull(), F.lit(error)).alias("identity_error"))


def _decimals(values: list[int]) -> pa.Array:
    from decimal import Context, Decimal

    exact = Context(prec=80)
    return pa.array([exact.create_decimal(Decimal(v)) for v in values], pa.decimal128(38, 0))
