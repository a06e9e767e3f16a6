"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argotlog.llm.tables import drop, table


def components(links: DataFrame) -> DataFrame:
    """(``id``, ``component``: smallest id reachable) of all ids in ``links`` (``a``, ``b``: bigint).

    Alternates the large-star and small-star steps: every node points its greater (then its lesser) neighbours to the smallest
    one.  A step is a grouping with map-side combining and a join that adaptive execution can split, so that a node with very many
    links needs no task of its own; each step's links are a table in the shared folder.
    """

    def point(edges: DataFrame, large: bool) -> DataFrame:
        # (u, v): v is a neighbour of u; in the small step only neighbours below u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
        joined = both.join(least, "u")
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    state = None
    while True:
        before = edges
        edges = table(point(point(before, True), False), "links")
        drop(before)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == state:
            break
        state = now
    # every node now points straight at the smallest of its component
    return ends.join(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
