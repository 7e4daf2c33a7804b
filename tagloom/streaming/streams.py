"""Structured Streaming forms of the batch operators.

Pages are stateless, so a stream runs the very functions a batch runs.  Sinks
written from ``foreachBatch`` overwrite their own batch folder, so replaying a
batch after a failure leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tagloom.config import DEFAULTS, Options
from tagloom.operators.events import done_event, numbered_frontier, url_events, urls_found
from tagloom.operators.jobs import page_results, wanted_fetches
from tagloom.operators.ratelimit import place_requests
from tagloom.session import materialize
from tagloom.sources.feed import FEED, register_feed


def _writer(df: DataFrame, checkpoint: str, mode: str, available_now: bool):
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer


@contextmanager
def _start_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for a query being started; it keeps them, the session does not."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stream_results(
    fetches: DataFrame,
    path: str,
    checkpoint: str,
    keep: tuple[str, ...] = (),
    options: Options = DEFAULTS,
    available_now: bool = True,
) -> StreamingQuery:
    """Append one result row per fetched page as the pages arrive."""
    rows = page_results(fetches, keep=keep, options=options)
    return _writer(rows, checkpoint, "append", available_now).format("parquet").start(path)


# After so many micro-batches what they changed is merged into one table of latest rows.
COMPACT_EVERY = 16


def _saved(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest merged table and the changes since, with their ``batch``; older folders are not read."""
    rows = spark.read.schema(f"{schema}, kind string, batch bigint").parquet(path)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    merged = rows.filter("kind = 'merged'").agg(F.max("batch")).first()[0]
    if merged is None:
        return rows.filter("kind = 'changes'")
    return rows.filter(f"(kind = 'merged' AND batch = {merged}) OR (kind = 'changes' AND batch > {merged})")


def _saver(path: str, schema: str, latest: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Writes each batch to its own folder, so a replayed batch leaves the same table."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/kind=changes/batch={batch_id}")
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            # What came before, and this batch itself: also in a replay, which has its merged table already.
            earlier = _saved(batch.sparkSession, path, schema, before=batch_id)
            own = batch.sparkSession.read.schema(schema).parquet(f"{path}/kind=changes/batch={batch_id}")
            rows = earlier.drop("kind").unionByName(own.withColumn("batch", F.lit(batch_id).cast("bigint")))
            latest(rows).write.mode("overwrite").parquet(f"{path}/kind=merged/batch={batch_id}")

    return save


COUNTER_SCHEMA = "job_id string, done bigint, errors bigint"


def _latest_counters(saved: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("done", "errors"), "batch").alias("_c")
    return saved.groupBy("job_id").agg(latest).select("job_id", "_c.done", "_c.errors")


def stream_counters(
    rows: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Running counters per job; each batch writes the jobs it changed."""
    failed = F.col("status") == "error"
    counters = rows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("done"), F.count_if(failed).alias("errors")
    )

    save = _saver(path, COUNTER_SCHEMA, _latest_counters)
    return _writer(counters, checkpoint, "update", available_now).foreachBatch(save).start()


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Latest counters per job from the batches written so far."""
    latest = _latest_counters(_saved(spark, path, COUNTER_SCHEMA))
    return latest.select("*", (F.col("done") - F.col("errors")).alias("success"))


_RESULTS = "job_id string, total bigint, n bigint, errors bigint"
_STEPS = "job_id string, event string, total bigint, errors bigint"


def _count_results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results and errors per job, combined inside a task before the exchange."""
    counts: dict[tuple[str, int], list[int]] = {}
    schema = pa.schema([("job_id", pa.string()), ("total", pa.int64()), ("n", pa.int64()), ("errors", pa.int64())])

    def flush() -> pa.RecordBatch:
        rows = [(*key, *found) for key, found in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for job, total, failed in zip(*[c.to_pylist() for c in batch.columns]):
            found = counts.setdefault((job, total), [0, 0])
            found[0] += 1
            found[1] += failed
        if len(counts) > _HELD_COUNTS:
            yield flush()
    if counts:
        yield flush()


class _JobProgress(StatefulProcessor):
    """Says when a job's first result came and when its last one did."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "done bigint, errors bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        done, errors = self.seen.get() if known else (0, 0)
        before, total = done, 0
        for chunk in rows:
            done, errors = done + int(chunk["n"].sum()), errors + int(chunk["errors"].sum())
            total = int(chunk["total"].max())
        self.seen.update((done, errors))
        steps = ([] if known else ["urls_found"]) + (["done"] if before < total <= done else [])
        if steps:
            yield pd.DataFrame([(key[0], s, total, errors) for s in steps], columns=["job_id", "event", "total", "errors"])

    def close(self) -> None:
        pass


def stream_events(
    frontier: DataFrame,
    fetches: DataFrame,
    path: str,
    checkpoint: str,
    options: Options = DEFAULTS,
    available_now: bool = True,
    by: str = "url",
) -> StreamingQuery:
    """The events of running jobs, appended to a feed as pages arrive; ``read_feed`` reads it.

    ``frontier(job_id, pos, url)`` is a table.  A job's ``urls_found`` comes with its first
    result and its ``done`` with the last of its urls, one fetch per url; the state behind
    both sees counts per job and task, never the results.  Where urls repeat, ``by`` names
    a column of both sides that says which fetch answers which row of the frontier.
    """
    spark = fetches.sparkSession
    named = () if by == "url" else (by,)
    numbered = materialize(numbered_frontier(frontier, keep=named), "feed-frontier")
    results = page_results(wanted_fetches(fetches, numbered), keep=named, options=options)
    rows = results.join(numbered, [*named, "url"])
    failed = (F.col("status") == "error").cast("bigint").alias("failed")
    steps = rows.select("job_id", "total", failed).mapInArrow(_count_results, _RESULTS)
    steps = steps.groupBy("job_id").transformWithStateInPandas(_JobProgress(), _STEPS, "Append", "None")
    done = steps.filter("event = 'done'").select("job_id", done_event(F.col("total"), F.col("errors")).alias("e")).select("job_id", "e.*")
    lists = materialize(urls_found(numbered), "feed-lists")
    found = steps.filter("event = 'urls_found'").select("job_id").join(lists, "job_id")
    register_feed(spark)
    with _start_settings(spark, _STATE_STORE):
        events = url_events(rows, options).unionByName(found.select("job_id", "seq", "event", "data")).unionByName(done)
        return _writer(events, checkpoint, "append", available_now).format(FEED).option("path", path).start()


_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
_COUNTED = "rl_key string, rl_sec bigint, rl_n bigint"
_CHAINED = "rl_key string, rl_sec bigint, window_start bigint, rl_before bigint"
# Rows of counts that a task holds before it passes them on.
_HELD_COUNTS = 200_000


def _count_seconds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests per (key, second), combined inside a task before the exchange."""
    held: list[pa.Table] = []

    def combined() -> pa.Table:
        table = pa.concat_tables(held).group_by(["rl_key", "rl_sec"]).aggregate([("rl_n", "sum")])
        return table.rename_columns({"rl_n_sum": "rl_n"}).select(["rl_key", "rl_sec", "rl_n"])

    rows = 0
    for batch in batches:
        ones = pa.array(np.ones(batch.num_rows, np.int64))
        held.append(pa.Table.from_batches([batch]).append_column("rl_n", ones))
        rows += batch.num_rows
        if rows > _HELD_COUNTS:
            held = [combined()]
            rows = held[0].num_rows
            if 2 * rows > _HELD_COUNTS:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from combined().to_batches()


# Groups of keys that share a place in the state store; a checkpoint is bound to their number.
_BUCKETS = 2048
_WINDOWS = "keys array<string>, starts array<bigint>, used array<bigint>, seen array<bigint>"


def _advance(
    edges: np.ndarray, seconds: np.ndarray, counts: np.ndarray, window_seconds: int, opened: np.ndarray, used: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Window and count before it of each active second of many keys at once.

    The seconds of key g lie from ``edges[g]`` to ``edges[g + 1]``, ascending; ``opened`` and ``used`` are its open
    window, whose start is its first second if it has none.
    """
    size, group = len(seconds), np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    # Keys lie further apart on one line than any window, so a window of a key ends at the next one's first second.
    low, reach = int(seconds.min()), int(seconds.max()) - int(seconds.min())
    span = reach + window_seconds + 1
    line = group * span + (seconds - low)
    following = np.searchsorted(line, line + window_seconds, side="right").tolist()
    # Also what came late, before the open window: it counts by arrival.
    last = np.arange(len(edges) - 1) * span + np.clip(opened + window_seconds - low, -1, reach)
    carried = np.searchsorted(line, last, side="right")
    opening = []
    for at, end in zip(carried.tolist(), edges[1:].tolist()):
        while at < end:
            opening.append(at)
            at = following[at]
    opened_by = np.zeros(size, np.int64)
    opened_by[opening] = opening
    opened_by = np.maximum.accumulate(opened_by)
    running = np.concatenate([[0], np.cumsum(counts)])
    starts, before = seconds[opened_by], running[:-1] - running[opened_by]
    still = np.arange(size) < carried[group]
    starts = np.where(still, opened[group], starts)
    return starts, np.where(still, used[group] + running[:-1] - running[edges[:-1]][group], before)


class _OpenWindows(StatefulProcessor):
    """The open windows of a bucket of keys; a micro-batch brings counts per key and second.

    Every call to the state store is a trip to the JVM, so the keys of a bucket go together.
    """

    def __init__(self, window_seconds: int, forget_after: int | None):
        self.window_seconds, self.forget_after = window_seconds, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.forget_after is None else self.forget_after * 1000
        self.windows = handle.getValueState("windows", _WINDOWS, ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = 0 if self.forget_after is None else timerValues.getCurrentProcessingTimeInMs()
        held = {k: (start, used, seen) for k, start, used, seen in zip(*(self.windows.get() or ((),) * 4))}
        if self.forget_after is not None:
            held = {k: v for k, v in held.items() if now - v[2] < self.forget_after * 1000}
        # One number per key and active second, however many tasks and requests it had.
        counted = pd.concat(list(rows)).groupby(["rl_key", "rl_sec"], as_index=False)["rl_n"].sum()
        keys, seconds, counts = (counted[c].to_numpy() for c in ("rl_key", "rl_sec", "rl_n"))
        edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        own = keys[edges[:-1]].tolist()
        opened = np.array([held[k][0] if k in held else a for k, a in zip(own, seconds[edges[:-1]].tolist())], np.int64)
        used = np.array([held[k][1] if k in held else 0 for k in own], np.int64)
        starts, before = _advance(edges, seconds, counts, self.window_seconds, opened, used)
        last = edges[1:] - 1
        held.update((k, (a, n, now)) for k, a, n in zip(own, starts[last].tolist(), (before[last] + counts[last]).tolist()))
        self.windows.update((list(held), *map(list, zip(*held.values()))))
        yield pd.DataFrame({"rl_key": keys, "rl_sec": seconds, "window_start": starts, "rl_before": before})

    def close(self) -> None:
        pass


def stream_rate_limit(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    max_requests: int = DEFAULTS.rate_limit_requests,
    window_seconds: int = DEFAULTS.rate_limit_window,
    available_now: bool = True,
    forget_after: int | None = None,
) -> StreamingQuery:
    """Rate-limit decisions for a stream of ``(key, ts, id)``, one folder per micro-batch.

    Only counts per (key, second) meet the state, so a key with a third of all requests
    costs its task one number per active second; the requests themselves are ranked and
    placed over all tasks, as in a batch.  Every request gets one row.  Inside a
    micro-batch rows may be in any order; over micro-batches a request that is older than
    its key's open window came late and counts in that window, as requests count when they
    arrive.  Requests without a time pass with NULL decisions.

    An open window is three numbers in Spark's RocksDB state store, where a bucket of keys
    is one row.  ``forget_after`` lets
    keys go that sent nothing for so many seconds of processing time; without it none goes,
    so a stream that is read later than it was written is decided alike.
    """
    keyed = requests.select(
        F.coalesce(F.col("key").cast("string"), F.lit("0")).alias("key"), "ts", F.col("id").cast("bigint").alias("id")
    )
    timed = keyed.filter(F.col("ts").isNotNull()).select(F.col("key").alias("rl_key"), F.unix_seconds("ts").alias("rl_sec"))
    bucket = F.pmod(F.xxhash64("rl_key"), F.lit(_BUCKETS))
    counted = timed.mapInArrow(_count_seconds, _COUNTED).withColumn("rl_bucket", bucket)
    chained = counted.groupBy("rl_bucket").transformWithStateInPandas(
        _OpenWindows(window_seconds, forget_after), _CHAINED, "Append", "None" if forget_after is None else "ProcessingTime"
    )
    windows = [c.split()[0] for c in _CHAINED.split(", ")]
    both = keyed.withColumn("request", F.lit(True)).unionByName(chained, allowMissingColumns=True)

    def save(batch: DataFrame, batch_id: int) -> None:
        # Evaluated once: the state moves with every evaluation.
        rows = materialize(batch, "limit-batch")
        found = rows.filter("request IS NULL").select(*windows)
        own = rows.filter("request").select("key", "ts", "id")
        decided = place_requests(own, lambda _: found, "key", "ts", "id", max_requests)
        decided.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with _start_settings(requests.sparkSession, _STATE_STORE):
        return _writer(both, checkpoint, "append", available_now).foreachBatch(save).start()


STATE_FIELDS = ["updated", "done", "errors", "status"]
_STATE = "updated bigint, done bigint, errors bigint, status string"
LATEST_SCHEMA = f"job_id string, {_STATE}, expired boolean"


def _newest_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest state of each job, combined inside a task before the exchange; nulls are the least."""
    order = [("job_id", "ascending"), *[(f, "descending") for f in STATE_FIELDS]]

    def combined(held: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(held).sort_by(order)
        places = pa.table({"job_id": table["job_id"], "place": np.arange(table.num_rows)})
        return table.take(places.group_by("job_id").aggregate([("place", "min")])["place_min"])

    held, rows = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows > _HELD_COUNTS:
            held = [combined(held)]
            rows = held[0].num_rows
            if 2 * rows > _HELD_COUNTS:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from combined(held).to_batches()


class _LatestState(StatefulProcessor):
    """Newest state of a job; a timer on its ``updated`` returns it once more, as expired, and lets it go.

    A maximum needs no order: a busy job costs its tasks one pass, and the state one row per task.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.state.get()
        old = best = None if old is None else tuple(old)
        for row in rows:
            if row.updated is not None:
                found = (row.updated, row.done, row.errors, str(row.status))
                best = found if best is None else max(best, found)
        if best is None:
            return
        if old != best:
            self.state.update(best)
        if old is None or old[0] != best[0]:
            if old is not None:
                self.handle.deleteTimer(old[0] * 1000)
            self.handle.registerTimer(best[0] * 1000)
        yield self._row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.state.get()
        if last is not None:
            self.state.clear()
            yield self._row(key, tuple(last), True)

    @staticmethod
    def _row(key, state: tuple, expired: bool) -> Row:
        return Row(job_id=key[0], **dict(zip(STATE_FIELDS, state)), expired=expired)

    def close(self) -> None:
        pass


def stream_latest_state(
    states: DataFrame,
    path: str,
    checkpoint: str,
    options: Options = DEFAULTS,
    available_now: bool = True,
) -> StreamingQuery:
    """Newest state per job as states arrive; idle jobs expire by ``updated``.

    Now is the newest ``updated`` of all jobs.  A job whose state is older than its time
    to live is returned once more with ``expired`` set, then forgotten: the watermark
    trails now by the time to live, and a timer at ``updated`` fires once it is behind.
    States that are behind it when they arrive are expired already: they come out once
    and start nothing.  A later state of the job starts afresh.
    """
    ttl = options.job_ttl_seconds
    combined = f"job_id string, {_STATE}"
    fields = states.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in combined.split(", ")])
    fields = fields.mapInArrow(_newest_of_task, combined)
    latest = (
        fields.withColumn("at", F.timestamp_seconds("updated"))
        # One millisecond more: what is exactly as old as its time to live still counts.
        .withWatermark("at", f"{1000 * ttl + 1} milliseconds")
        .groupBy("job_id")
        .transformWithState(_LatestState(), LATEST_SCHEMA, "Update", "EventTime")
    )
    keep = _saver(path, LATEST_SCHEMA, _newest_states)
    arrived = fields.withColumn("expired", F.lit(None).cast("boolean"))

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch, "state-batch")
        held = rows.filter("expired IS NOT NULL")
        # Jobs of this batch that the state never saw: all their rows were behind the watermark.
        late = rows.filter("expired IS NULL").join(held.select("job_id").distinct(), "job_id", "left_anti")
        late = late.groupBy("job_id").agg(F.max(F.struct(*STATE_FIELDS)).alias("_s"))
        late = late.select("job_id", "_s.*", F.lit(True).alias("expired"))
        keep(held.unionByName(late), batch_id)

    with _start_settings(states.sparkSession, _STATE_STORE):
        both = latest.unionByName(arrived)
        return _writer(both, checkpoint, "update", available_now).foreachBatch(save).start()


def _newest_states(saved: DataFrame) -> DataFrame:
    # A batch may hold a job's new state and the end of an older one.
    newest = F.max(F.struct(*STATE_FIELDS, "expired")).alias("_s")
    return saved.groupBy("job_id").agg(newest).select("job_id", "_s.*")


def read_latest_state(spark: SparkSession, path: str) -> DataFrame:
    """Newest state per job of the batches written so far, and whether it has expired since."""
    return _newest_states(_saved(spark, path, LATEST_SCHEMA))
