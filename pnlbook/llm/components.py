"""Connected components of a graph held as a table of edges.

Alternating large-star and small-star steps: each vertex hands its larger
neighbours to its smallest one, until every component is a star around its
smallest vertex. Every step is a grouped minimum and a join; no vertex's
neighbours are ever collected, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import stored


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of ``edges`` (a, b); the component is its smallest vertex."""
    e = stored(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "edges")
    before = _sum(e)
    while before[0]:
        both = e.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(e.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = stored(both.where("y > x").join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct(), "large-star", 2 * before[0])
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
                 .unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())
        e = stored(small, "small-star", before[0])
        after = _sum(e)
        if after == before:
            break
        before = after
    return (e.select(F.col("hi").alias("vertex"), F.col("lo").alias("component"))
            .unionByName(e.select(F.col("lo").alias("vertex"), F.col("lo").alias("component")).distinct()))
