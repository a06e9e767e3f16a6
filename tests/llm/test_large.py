"""Sizes beyond 32 bits, without the data."""

from pyspark.sql import functions as F

from argotlog.llm.jaccard import _possible


def test_sets_of_many_millions_of_shingles(spark):
    sizes = spark.createDataFrame([(13_000_000, 0, 13_000_000, 0), (2_000_000_000, 5, 1_000_000, 0), (2_000_000_000, 0, 1_999_999_999, 0)], "sa int, pa int, sb int, pb int")
    found = sizes.select(_possible(85, F.col("sa"), F.col("pa"), F.col("sb"), F.col("pb")).alias("p")).collect()
    assert [r.p for r in found] == [True, False, True]
