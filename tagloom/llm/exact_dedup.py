"""Exact deduplication by content-defined chunk recipes.

Each normalised text is cut where its content says so, every chunk is named by
a 64-bit key, and a document becomes the ordered list of its chunk keys (its
recipe).  Keys are verified: all distinct (key, SHA-256, length) triples are
compared, and recipes that hold a key with more than one content are compared
by their full digests.  Texts leave the scan only as recipes, so a long
document is read once and never shuffled.

Defined results: a null text is an empty one; empty texts are equal to each
other; rows that share doc_id and text are one document and get one decision; a
null doc_id stays only if its whole group has none.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import arrow_rows, narrow, written
from tagloom.operators.joins import lookup

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_MULTIPLIER = np.uint32(2654435761)


def cut_points(data: bytes, low: int, average_bits: int, high: int) -> list[int]:
    """Ends of the chunks: after a 4-byte window whose hash has ``average_bits`` zero bits.

    Chunks hold ``low`` to ``high`` bytes, but for the last one.
    """
    n = len(data)
    if n <= low:
        return [n]
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    window = raw[3:] | raw[2:-1] << 8 | raw[1:-2] << 16 | raw[:-3] << 24
    marks = np.flatnonzero((window * _MULTIPLIER) >> np.uint32(32 - average_bits) == 0) + 4
    ends, start = [], 0
    for mark in marks.tolist():
        while mark - start > high:
            start += high
            ends.append(start)
        if mark - start >= low:
            ends.append(mark)
            start = mark
    while n - start > high:
        start += high
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def recipes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    low: int = 1024, average_bits: int = 12, high: int = 32768,
) -> DataFrame:
    """(doc_id, n_chars, text_sha256, keys, digests) of every document."""

    def make(ids: list, texts: list) -> list[list]:
        sizes, whole, keys, digests = [], [], [], []
        for text in texts:
            text = text or ""
            data = text.encode("utf-8", "surrogatepass").translate(None, _SPACE)
            sizes.append(len(text))
            whole.append(hashlib.sha256(data).hexdigest())
            parts, start = [], 0
            for end in cut_points(data, low, average_bits, high):
                parts.append(hashlib.sha256(data[start:end]).digest() + (end - start).to_bytes(4, "big"))
                start = end
            keys.append([int.from_bytes(p[:8], "big", signed=True) for p in parts])
            digests.append(parts)
        return [ids, sizes, whole, keys, digests]

    schema = "doc_id long, n_chars long, text_sha256 string, keys array<long>, digests array<binary>"
    source = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return arrow_rows(source, make, schema, "doc_id", "text")


def verified(table: DataFrame) -> DataFrame:
    """Recipes with ``check``: empty, or all digests where a key has more than one content."""
    distinct = table.groupBy("keys", "digests").agg(F.lit(1).alias("one"))
    chunks = (
        distinct.select(F.explode(F.arrays_zip("keys", "digests")).alias("c"))
        .groupBy(F.col("c.keys").alias("key"), F.col("c.digests").alias("digest")).agg(F.lit(1).alias("one"))
    )
    clashes = chunks.groupBy("key").count().filter("count > 1").select("key")
    none = F.array().cast("array<binary>").alias("check")
    # Nearly always no key has two contents, and then no recipe has to be looked up.
    clashes = written(clashes, "clashes")
    if clashes.isEmpty():
        return table.select("doc_id", "n_chars", "text_sha256", "keys", none)
    touched = (
        distinct.select("keys", F.explode("keys").alias("key")).join(clashes, "key", "left_semi")
        .groupBy("keys").agg(F.lit(True).alias("touched"))
    )
    return lookup(table, touched, "keys").select(
        "doc_id", "n_chars", "text_sha256", "keys", F.when(F.col("touched"), F.col("digests")).otherwise(none).alias("check"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points stays, then the smallest
    doc_id.  Counts and choices are combined before the exchange, so a group
    with a third of all rows costs one row per task.
    """
    table = verified(written(recipes(docs, id_col, text_col), "recipes"))
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("id")))
    groups = table.groupBy("keys", "check").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("keys", "check", F.col("best.id").alias("keep_id"), "group_size", F.xxhash64("keys").alias("tag"))
    # The tag makes the planner exchange both sides for this join, so that AQE can split a hot recipe.
    return (
        table.withColumn("tag", F.xxhash64("keys")).join(groups, ["keys", "check", "tag"])
        .select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")
    )
