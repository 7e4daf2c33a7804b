"""Fixed-window rate limit anchored on the first request of each window.

A window starts with a request, not on the clock, so the next start depends on
the previous one and neither ``window()`` nor a window frame can express it.
Only the *seconds* in which a key was active matter for that chain, which keeps
it small: requests are first counted per (key, second) with map-side combine,
the chain runs over those counts, and every request then finds its place by an
equi-join on (key, second).  A key with a third of all requests is thereby
spread over its seconds; the sequential part sees at most one row per second.
Inside a second requests are ranked per range partition and shifted by what the
partitions before hold, so a second with a third of all requests is spread too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.config import DEFAULTS
from tagloom.functions.text import to_col
from tagloom.session import materialize

_CHAIN_SCHEMA = "rl_key string, rl_sec bigint, window_start bigint, rl_before bigint"


def _chain(window_seconds: int):
    """Fold over (key, second, count) rows sorted by key and second.

    Constant memory: one Arrow batch plus the open window of the last key.
    Rows with ``rl_open`` set carry a window over from earlier input.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, start, used = None, 0, 0
        for batch in batches:
            if batch.empty:
                continue
            keys = batch["rl_key"].to_numpy(dtype=object)
            secs = batch["rl_sec"].to_numpy(dtype=np.int64)
            counts = batch["rl_n"].to_numpy(dtype=np.int64)
            size = len(keys)
            group = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1])))
            # The window left open by the previous batch takes the rows it covers.
            first = 0
            if keys[0] == last_key:
                same = int(np.searchsorted(group, 0, side="right"))
                first = int(np.searchsorted(secs[:same], start + window_seconds, side="right"))
            # Next window start of every row, were it a start itself.  Groups lie
            # further apart than any window, so a chain leaves a group only at
            # the first row of the next one, which opens a window anyway.
            low = secs.min()
            span = int(secs.max() - low) + window_seconds + 1
            line = group * span + (secs - low)
            following = np.searchsorted(line, line + window_seconds, side="right").tolist()
            opening, at = [], first
            while at < size:
                opening.append(at)
                at = following[at]
            opened_by = np.zeros(size, dtype=np.int64)
            opened_by[opening] = opening
            opened_by = np.maximum.accumulate(opened_by)
            running = np.concatenate(([0], np.cumsum(counts)))
            starts, before = secs[opened_by], running[:-1] - running[opened_by]
            starts[:first], before[:first] = start, used + running[:first]
            last_key, start, used = keys[-1], int(starts[-1]), int(before[-1] + counts[-1])
            out = pd.DataFrame(
                {"rl_key": keys, "rl_sec": secs, "window_start": starts, "rl_before": before}
            )
            yield out[~batch["rl_open"].to_numpy(dtype=bool)]

    return run


def window_chain(
    per_second: DataFrame, window_seconds: int, state: DataFrame | None = None
) -> DataFrame:
    """Window of every ``(rl_key, rl_sec, rl_n)`` row and the count before it."""
    rows = per_second.select("rl_key", "rl_sec", "rl_n", F.lit(False).alias("rl_open"))
    if state is not None:
        # A carried window acts as its own first second holding all it used.
        opened = state.select(
            F.col("key").alias("rl_key"),
            F.col("window_start").alias("rl_sec"),
            F.col("used").alias("rl_n"),
            F.lit(True).alias("rl_open"),
        )
        active = rows.select("rl_key").distinct()
        rows = rows.unionByName(opened.join(active, "rl_key", "left_semi"))
    ordered = rows.repartition("rl_key").sortWithinPartitions(
        "rl_key", "rl_sec", F.col("rl_open").desc()
    )
    return ordered.mapInPandas(_chain(window_seconds), _CHAIN_SCHEMA)


def place_requests(
    requests: DataFrame,
    chain: Callable[[DataFrame], DataFrame],
    key: Column | str,
    ts: Column | str,
    id: Column | str,
    max_requests: int,
) -> DataFrame:
    """Decisions of ``requests``: ``chain`` turns counts per (key, second) into their windows.

    A (key, second) without a window gives NULL decisions, as a request without a time does.
    """
    stamped = requests.withColumns(
        {
            # Requests without a key share one, so none drops out of the join.
            "rl_key": F.coalesce(to_col(key).cast("string"), F.lit("0")),
            "rl_sec": F.unix_seconds(to_col(ts).cast("timestamp")),
            "rl_ts": to_col(ts),
            "rl_id": to_col(id),
        }
    )
    order = ["rl_key", "rl_sec", "rl_ts", "rl_id"]
    # Written once: the numbers of the range partitions must not change between its uses.
    timed = materialize(
        stamped.filter(F.col("rl_sec").isNotNull()).repartitionByRange(*order).withColumn("rl_part", F.spark_partition_id()),
        "requests",
    )
    parts = timed.groupBy("rl_key", "rl_sec", "rl_part").agg(F.count(F.lit(1)).alias("rl_m"))
    earlier = Window.partitionBy("rl_key", "rl_sec").orderBy("rl_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("rl_shift", F.coalesce(F.sum("rl_m").over(earlier), F.lit(0)))
    per_second = parts.groupBy("rl_key", "rl_sec").agg(F.sum("rl_m").alias("rl_n"))
    places = parts.join(chain(per_second), ["rl_key", "rl_sec"], "left")
    in_part = F.row_number().over(Window.partitionBy("rl_key", "rl_sec", "rl_part").orderBy("rl_ts", "rl_id"))
    placed = (
        timed.withColumn("rl_rank", in_part)
        .join(places, ["rl_key", "rl_sec", "rl_part"])
        .withColumn("request_count", F.col("rl_before") + F.col("rl_shift") + F.col("rl_rank"))
        .withColumn("allowed", F.col("request_count") <= max_requests)
    )
    added = ["window_start", "request_count", "allowed"]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(added, ("bigint", "bigint", "boolean"))]
    untimed = stamped.filter(F.col("rl_sec").isNull()).select(*requests.columns, *nothing)
    return placed.select(*requests.columns, *added).unionByName(untimed)


def rate_limit(
    requests: DataFrame,
    key: Column | str = "key",
    ts: Column | str = "ts",
    id: Column | str = "id",
    max_requests: int = DEFAULTS.rate_limit_requests,
    window_seconds: int = DEFAULTS.rate_limit_window,
    state: DataFrame | None = None,
) -> DataFrame:
    """Add ``window_start``, ``request_count`` and ``allowed`` to every request.

    Times count in whole seconds; requests of a key are ordered by (ts, id).
    Rejected requests count too.  A request without a time is returned with NULL
    decisions and counts for nobody.  ``state(key, window_start, used)``
    continues the windows of earlier input.
    """
    return place_requests(
        requests, lambda per_second: window_chain(per_second, window_seconds, state), key, ts, id, max_requests
    )


def open_windows(decided: DataFrame, key: str = "key") -> DataFrame:
    """Last window per key, ``(key, window_start, used)``, of decided requests.

    The request that came last carries the count its window has reached.
    """
    last = F.max(F.struct("window_start", F.col("request_count").alias("used"))).alias("_w")
    name = F.coalesce(F.col(key).cast("string"), F.lit("0")).alias("key")
    decided = decided.filter(F.col("window_start").isNotNull())
    return decided.groupBy(name).agg(last).select("key", "_w.*")
