"""Joining a large side to a side with unique keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_by(df: DataFrame, key: str, *values: str) -> DataFrame:
    """One deterministic row per key, so joining on it never multiplies rows.

    A plain aggregate: copies of a key are combined before the exchange.
    """
    picked = F.max(F.struct(*[F.col(v) for v in values])).alias("_picked")
    return df.groupBy(key).agg(picked).select(key, *[f"_picked.{v}" for v in values])


def lookup(left: DataFrame, unique: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join rows to a side with unique keys, safe for hot keys on the left.

    Small unique sides are broadcast by the planner's own size check.  Beyond
    it both sides are shuffled, and AQE splits a hot key only where each input
    is a bare shuffle.  The unique side usually ends in an aggregate on the very
    key, whose partitioning the join would reuse; joining on the key and its
    hash makes the planner exchange that (already reduced) side once more.
    """
    tag = F.xxhash64(key).alias("_tag")
    right = unique.select(key, tag, *[c for c in unique.columns if c != key])
    return left.select("*", tag).join(right, [key, "_tag"], how).drop("_tag")
