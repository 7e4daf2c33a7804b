"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import written
from tagloom.operators.joins import lookup


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of an edge with the smallest node it reaches.

    Alternating large and small stars: each round hangs neighbours below the
    smallest one, which about halves distances; minima are combined before
    exchanges and edges are written each round.  The hub of a large component is split
    like any hot key.  Ends when a round changes nothing.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    links = edges.filter(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct()
    links, seen = written(links, "links"), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = lookup(both.filter("v > u"), least, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            lookup(large, least, "u", "inner").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct()
        )
        links = written(small, "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        seen = state
