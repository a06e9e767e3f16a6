"""Exact-size random samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PREFIX_DIGITS = 4


def draw(key: Column, seed: int) -> Column:
    """Pseudo-random text that depends on the key and the seed only."""
    return F.md5(F.concat_ws(":", F.lit(seed), key))


def sample_exact(df: DataFrame, rows: int, key: str = "row_id", seed: int = 42) -> DataFrame:
    """``rows`` rows without replacement, all of them if there are no more than that.

    The keys with the smallest draws win, so the sample is the same for every layout of the data.  A histogram over the first
    digits of the draws (at most 65,536 counts) tells up to which prefix the winners reach, so that only the
    keys of one prefix are ranked, however big the table or the sample is.  The payload comes from a semi join on the sampled keys.
    """
    drawn = df.select(key).withColumn("draw", draw(F.col(key), seed))
    prefix = F.substring("draw", 1, PREFIX_DIGITS)
    histogram = drawn.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    reached = histogram.withColumn("reached", F.sum("n").over(W.orderBy("prefix")))
    last = reached.filter(F.col("reached") >= rows).orderBy("prefix").select("prefix", (F.col("reached") - F.col("n")).alias("before")).first()
    if last is None:
        return df
    # All keys below the last prefix win; only those that share it are ranked.
    below = drawn.filter(prefix < last.prefix)
    ranked = drawn.filter(prefix == last.prefix).orderBy("draw", key).limit(rows - last.before)
    return df.join(below.select(key).union(ranked.select(key)), key, "left_semi")
