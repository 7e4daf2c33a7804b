"""Mix sources to target weights by entropy balancing.

Every document of x words starts with rate 1.  The rates closest to that in
relative entropy, at most ``most`` each, whose words add up to each source's
target are ``min(most, exp(lambda_s * x / scale_s))``.  The multipliers solve a
convex dual, one token constraint per source; Newton steps, kept inside a
shrinking bracket, run on Spark over the counts of equal sizes.  Rates become
whole copies: sizes are rounded from the largest down, each carrying the words
its forerunners left over, so a source misses its target by a fraction of its
smaller documents only.

Defined results: a null text has size 0 and is taken 0 words; null sources are
one source, last in order; repeated rows are separate documents, those with
equal doc_id in an order that does not change what a source takes; a source
without words has target 0.  Reruns on the same rows agree.  Extra columns are
ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import WORD, narrow, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
# Rows of equal source and size are ranked in pieces of about this many.
_PIECE = 4096


def sizes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", order_col: str | None = None
) -> DataFrame:
    rows = narrow(docs, doc_id=id_col, text=text_col, source=source_col, **({"hash": order_col} if order_col else {}))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    hash_ = F.col("hash") if order_col else F.xxhash64("doc_id")
    return rows.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), hash_.alias("hash"))


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of the sources in (source, source_size): water-filling below ``most`` times their size.

    A source is full once weight * level reaches its cap; with the sources in
    order of cap / weight, the level is what is left over the weight that is
    left.  The table has one row per source; windows over it are small.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    number = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number + 1).cast("int"))
    cap = F.col("source_size").cast("double") * most
    rows = totals.withColumn("weight", weight).withColumn("cap", cap)
    everything = Window.partitionBy(F.lit(0))
    filled = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    # The level of the first source that is not full holds for all after it.
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return rows.select(
        "source", "source_size",
        F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level)).alias("target"),
    )


def _same(left, right):
    return left.eqNullSafe(right)


def tilts(cells: DataFrame, goals: DataFrame, most: int, rounds: int, tolerance: float) -> DataFrame:
    """(source, …, tilt): the dual optimum per source; infinite where the target needs every rate at ``most``."""
    scale = F.greatest(F.col("source_size") / F.greatest(F.col("filled"), F.lit(1)), F.lit(1.0))
    state = goals.withColumn("scale", scale).select(
        "source", "source_size", "target", "scale",
        F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
        (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("done"),
    ).withColumn("tilt", F.when(F.col("done"), F.lit(float("inf"))).otherwise(F.col("tilt")))
    state = written(state, "tilts")
    # Decimals add up to the same in any order, so reruns take the same steps.
    whole = lambda x: F.sum(x.cast("decimal(30,6)")).cast("double")
    for _ in range(rounds):
        x = F.col("size") / F.col("scale")
        power = F.least(F.col("tilt") * x, F.lit(700.0))
        rate = F.least(F.exp(power), F.lit(float(most)))
        active = F.exp(power) < most
        live = state.filter(~F.col("done")).withColumnRenamed("source", "s")
        sums = (
            cells.filter("size > 0").join(live, _same(F.col("source"), F.col("s")))
            .groupBy("source").agg(
                whole(F.col("n") * F.col("size") * rate).alias("got"),
                whole(F.when(active, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
            ).withColumnRenamed("source", "s")
        )
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.when(F.col("slope") > 0, gap / F.col("slope"))
        inside = (step > F.col("new_low")) & (step < F.col("new_high"))
        middle = (
            F.when(F.col("new_low") == float("-inf"), F.least(F.col("tilt") * 2, F.lit(-1.0)))
            .when(F.col("new_high") == float("inf"), F.greatest(F.col("tilt") * 2, F.lit(1.0)))
            .otherwise((F.col("new_low") + F.col("new_high")) / 2)
        )
        now_done = F.col("done") | F.col("got").isNull() | (F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0)))
        state = written(
            state.join(sums, _same(F.col("source"), F.col("s")), "left")
            .withColumn("new_low", low).withColumn("new_high", high)
            .withColumn("now_done", F.coalesce(now_done, F.lit(True)))
            .select(
                "source", "source_size", "target", "scale",
                F.when(F.col("now_done"), F.col("tilt")).when(inside, step).otherwise(middle).alias("tilt"),
                F.col("new_low").alias("low"), F.col("new_high").alias("high"), F.col("now_done").alias("done"),
            ),
            "tilts",
        )
        if state.filter(~F.col("done")).isEmpty():
            break
    return state


def _round_cells(batches):
    """Whole copies per (source, size), sizes descending: constant memory, sources follow one another.

    What a source still misses after its smallest document is at most half of it,
    unless all its documents already have the most copies or none.
    """
    current, wanted, taken = object(), 0.0, 0.0
    for frame in batches:
        copies = []
        for source, size, n, rate, most in zip(frame["key"], frame["size"], frame["n"], frame["rate"], frame["most"]):
            if source != current:
                current, wanted, taken = source, 0.0, 0.0
            wanted += n * rate * size
            count = int(min(max(round((wanted - taken) / size), 0), most * n))
            taken += count * size
            copies.append(count)
        yield pd.DataFrame({"key": frame["key"], "size": frame["size"], "copies": copies})


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: int = MOST, rounds: int = 40, tolerance: float = 1e-9,
    order_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Rows of a hot source are counted by size before any exchange.  Copies of one
    (source, size) go to documents by the hash of their id or by a given column; ranks are taken in
    pieces of bounded size, each with its own quota.
    """
    rows = written(sizes(docs, id_col, text_col, source_col, order_col), "sizes")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = rows.withColumn("key", key)
    cells = written(rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    totals = cells.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("filled"),
    )
    goals = targets(totals, weights, share, most).withColumnRenamed("source", "s")
    goals = goals.join(totals.drop("source_size"), _same(F.col("source"), F.col("s"))).drop("s")
    state = tilts(cells, goals, most, rounds, tolerance).withColumn("key", key)

    power = F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(700.0))
    rated = (
        cells.filter("size > 0").select("key", "size", "n")
        .join(state.select("key", "tilt", "scale"), "key")
        .select("key", "size", "n", F.least(F.exp(power), F.lit(float(most))).alias("rate"), F.lit(most).alias("most"))
    )
    # One source's sizes pass one task in order: at most one row per distinct size.
    rounded = (
        rated.repartition("key").sortWithinPartitions("key", F.desc("size"))
        .mapInPandas(_round_cells, "key string, size long, copies long")
    )
    quota = written(
        cells.select("key", "size", "n").join(rounded, ["key", "size"], "left").fillna(0, ["copies"])
        .withColumn("pieces", F.ceil(F.col("n") / _PIECE)),
        "quota",
    )
    spread = (
        rows.join(quota, ["key", "size"])
        .withColumn("piece", F.pmod(F.shiftrightunsigned("hash", 3), F.col("pieces")))
    )
    # Pieces of a cell share its copies by running totals of their rows.
    part = spread.groupBy("key", "size", "piece", "n", "copies").agg(F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy("key", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    share_of = lambda total: F.floor(F.col("copies").cast("decimal(38,0)") * total / F.col("n"))
    part = (
        part.withColumn("sum", F.sum("m").over(upto))
        .select(
            "key", "size", "piece", "m",
            (share_of(F.col("sum")) - share_of(F.col("sum") - F.col("m"))).cast("long").alias("own"),
        )
    )
    rank = Window.partitionBy("key", "size", "piece").orderBy("hash", "doc_id")
    copies = F.floor(F.col("own") / F.col("m")) + (F.col("rank") <= F.col("own") % F.col("m")).cast("long")
    return (
        spread.select("doc_id", "source", "key", "size", "piece", "hash").join(part, ["key", "size", "piece"])
        .withColumn("rank", F.row_number().over(rank))
        .withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
        .join(state.select("key", "source_size", "target"), "key")
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
