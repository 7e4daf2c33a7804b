import random
import time
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F
from tests_support import model_limit

from tagloom import page_results
from tagloom.operators.ratelimit import rate_limit
from tagloom.sources import tables as T
from tagloom.streaming import streams as S

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_pages_stream_equals_batch(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    fetches = T.fetches_of_pages(pages).select("url", "http_status", "fetch_error", "html")
    fetches.repartition(4).write.parquet(source)
    stream = T.read_stream(spark, source, T.FETCH_SCHEMA, maxFilesPerTrigger="1")
    out = str(tmp_path / "out")
    S.stream_results(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    want = {tuple(r) for r in page_results(T.read_fetches(spark, source)).collect()}
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want


def test_counters_over_batches(spark, tmp_path):
    source = tmp_path / "in"
    for part in range(3):
        rows = [("a", "ok"), ("a", "error"), (f"only{part}", "ok")]
        spark.createDataFrame(rows, "job_id string, status string").coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema("job_id string, status string").option("maxFilesPerTrigger", 1).json(str(source))
    out = str(tmp_path / "out")
    S.stream_counters(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    got = {r.job_id: (r.done, r.errors, r.success) for r in S.read_counters(spark, out).collect()}
    assert got == {"a": (6, 3, 3), "only0": (1, 0, 1), "only1": (1, 0, 1), "only2": (1, 0, 1)}


def test_merged_tables_stand_for_the_batches_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "COMPACT_EVERY", 2)
    out, schema = str(tmp_path / "out"), S.COUNTER_SCHEMA
    save = S._saver(out, schema, S._latest_counters)
    batches = [[("a", 1, 0), ("b", 1, 1)], [("a", 2, 0)], [("c", 1, 0)], [("a", 3, 1)], [("b", 2, 1)]]
    for number, rows in enumerate(batches):
        save(spark.createDataFrame(rows, schema), number)
    # A replay of a batch that was merged already.
    save(spark.createDataFrame(batches[3], schema), 3)
    want = {"a": (3, 1, 2), "b": (2, 1, 1), "c": (1, 0, 1)}
    assert {r.job_id: (r.done, r.errors, r.success) for r in S.read_counters(spark, out).collect()} == want
    read = S._saved(spark, out, schema)
    assert {(r.kind, r.batch) for r in read.select("kind", "batch").collect()} == {("merged", 3), ("changes", 4)}


def test_rate_limit_over_batches(spark, tmp_path):
    rows = [("ab"[i % 3 == 0], START + timedelta(seconds=7 * i), i) for i in range(60)]
    rows += [("late", START + timedelta(seconds=500 + i), 100 + i) for i in range(5)]
    rows.sort(key=lambda r: (r[1], r[2]))
    schema = "key string, ts timestamp, id bigint"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    checkpoint = str(tmp_path / "cp")
    for part in (rows[:20] + [("a", None, 999)], rows[20:35], rows[35:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        # A new query per part: it resumes from the checkpoint with its state.
        stream = T.read_stream(spark, source, schema)
        S.stream_rate_limit(stream, out, checkpoint, 2, 60).awaitTermination(120)
    got = {r.id: (r.window_start, r.request_count, r.allowed) for r in spark.read.parquet(out).collect()}
    assert got.pop(999) == (None, None, None)
    assert got == model_limit(rows, 2, 60)


def test_latest_state_over_batches(spark, tmp_path):
    schema = "job_id string, updated bigint, status string, done bigint, errors bigint"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [
        [("a", 1, "running", 1, 0), ("b", 9, "done", 4, 1)],
        [("a", 5, "done", 3, 0), ("a", 5, "done", 2, 0), ("b", 2, "queued", 0, 0)],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = T.read_stream(spark, source, schema)
        S.stream_latest_state(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    got = {r.job_id: (r.updated, r.status, r.done, r.errors) for r in S.read_latest_state(spark, out).collect()}
    assert got == {"a": (5, "done", 3, 0), "b": (9, "done", 4, 1)}
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")


STATES = "job_id string, updated bigint, status string, done bigint, errors bigint"


def states_after(spark, tmp_path, rows, **options):
    """What the batches so far hold after ``rows`` arrived; every call starts a new query from the checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(job, at, status, 0, 0) for job, at, status in rows], STATES)
    df.coalesce(1).write.mode("append").parquet(source)
    stream = T.read_stream(spark, source, STATES)
    S.stream_latest_state(stream, out, str(tmp_path / "cp"), **options).awaitTermination(120)
    saved = spark.read.schema(f"{S.LATEST_SCHEMA}, batch bigint").parquet(out).collect()
    latest = {r.job_id: (r.updated, r.status, r.expired) for r in S.read_latest_state(spark, out).collect()}
    return latest, sorted((r.job_id, r.updated) for r in saved if r.expired)


def test_idle_jobs_expire_once_by_updated(spark, tmp_path):
    """Now is the newest ``updated``; strictly more than the time to live later a state is returned once more."""
    latest, gone = states_after(spark, tmp_path, [("a", 10_000, "running"), ("b", 12_000, "running")])
    assert latest == {"a": (10_000, "running", False), "b": (12_000, "running", False)} and gone == []
    # Exactly one time to live later nothing is over yet.
    latest, gone = states_after(spark, tmp_path, [("c", 13_600, "queued")])
    assert latest["a"] == (10_000, "running", False) and gone == []
    latest, gone = states_after(spark, tmp_path, [("c", 13_601, "running")])
    assert latest["a"] == (10_000, "running", True) and not latest["b"][2] and gone == [("a", 10_000)]
    # A newer state moves the end of b; the one that came before it does not fire.
    latest, gone = states_after(spark, tmp_path, [("b", 15_000, "running"), ("c", 17_000, "done")])
    assert latest["b"] == (15_000, "running", False) and gone == [("a", 10_000)]
    # Expired on arrival: out once, nothing starts, and a's later state is a fresh one.
    latest, gone = states_after(spark, tmp_path, [("d", 9_000, "running"), ("a", 17_100, "queued"), ("b", 9_000, "old")])
    assert latest["d"] == (9_000, "running", True) and latest["a"] == (17_100, "queued", False)
    assert latest["b"] == (15_000, "running", False)
    latest, gone = states_after(spark, tmp_path, [("e", 30_000, "running")])
    assert {j for j, v in latest.items() if v[2]} == set("abcd")
    assert gone.count(("a", 10_000)) == 1 and ("a", 17_100) in gone and ("b", 15_000) in gone and ("c", 17_000) in gone


def test_late_requests_count_where_they_arrive(spark, tmp_path):
    """No request is lost: one older than the open window counts in it."""
    schema, source, out = "key string, ts timestamp, id bigint", str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda s: START + timedelta(seconds=s)
    parts = [
        [("a", at(1000), 1), ("a", at(1010), 2), ("b", at(5000), 3)],
        [("a", at(0), 4), ("a", at(1020), 5), ("a", at(500), 6), (None, at(3), 7)],
        [("a", at(1061), 8), ("a", at(1060), 9), ("b", None, 10)],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        S.stream_rate_limit(T.read_stream(spark, source, schema), out, str(tmp_path / "cp"), 4, 60).awaitTermination(120)
    base = int(START.timestamp())
    got = {r.id: (r.key, r.window_start and r.window_start - base, r.request_count, r.allowed) for r in spark.read.parquet(out).collect()}
    assert got == {
        1: ("a", 1000, 1, True), 2: ("a", 1000, 2, True), 3: ("b", 5000, 1, True),
        4: ("a", 1000, 3, True), 6: ("a", 1000, 4, True), 5: ("a", 1000, 5, False), 7: ("0", 3, 1, True),
        9: ("a", 1000, 6, False), 8: ("a", 1061, 1, True), 10: ("b", None, None, None),
    }


def test_a_hot_key_meets_the_state_as_counts(spark, tmp_path):
    """A third of many requests on one key, in three micro-batches: the batch operator's decisions."""
    schema, source, out = "key string, ts timestamp, id bigint", str(tmp_path / "in"), str(tmp_path / "out")
    n, slices = 300_000, 3
    ids = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"),
        (F.lit(START) + F.make_dt_interval(secs=F.floor(F.col("id") * 3600 / n).cast("decimal(18,6)"))).alias("ts"), "id",
    )
    for part in range(slices):
        slice_ = ids.filter((F.col("id") >= part * n / slices) & (F.col("id") < (part + 1) * n / slices))
        slice_.repartition(3).write.mode("append").parquet(source)
        stream = T.read_stream(spark, source, schema)
        query = S.stream_rate_limit(stream, out, str(tmp_path / "cp"), 20, 60)
        query.awaitTermination(120)
        seen = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        assert max(s["numRowsTotal"] for s in seen) <= 501
    want = rate_limit(ids, max_requests=20, window_seconds=60)
    got = spark.read.parquet(out).select(want.columns)
    assert got.count() == n and got.exceptAll(want).isEmpty()


def test_a_busy_job_meets_the_state_as_a_row_per_task(spark, tmp_path):
    """Many states of few jobs in two files: the state gets the newest of each job and task."""
    schema, source, out = STATES, str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(40_000).selectExpr(
        "concat('j', id % 7) as job_id", "id % 1000 as updated", "if(id % 2 = 0, 'a', 'b') as status", "id as done", "id % 3 as errors"
    )
    rows.repartition(2).write.parquet(source)
    query = S.stream_latest_state(T.read_stream(spark, source, schema), out, str(tmp_path / "cp"))
    query.awaitTermination(120)
    want = rows.groupBy("job_id").agg(F.max(F.struct(*S.STATE_FIELDS)).alias("s")).select("job_id", "s.*")
    got = S.read_latest_state(spark, out)
    assert {tuple(r) for r in got.drop("expired").collect()} == {tuple(r) for r in want.collect()}
    # Two inputs of the plan see the combined rows: the state and what is held against it.
    batches = list(S._newest_of_task(iter(rows.select("job_id", *S.STATE_FIELDS).toArrow().to_batches(max_chunksize=1000))))
    assert sum(b.num_rows for b in batches) == 7


def test_many_keys_share_places_in_the_state(spark, tmp_path):
    """Every place costs trips to the state store: they stay bounded while keys grow, and no key gets another's window."""
    schema, source, out = "key string, ts timestamp, id bigint", str(tmp_path / "in"), str(tmp_path / "out")
    n = 24_000
    ids = spark.range(n).select(
        F.concat(F.lit("k"), F.col("id") * 7919 % 6000).alias("key"),
        (F.lit(START) + F.make_dt_interval(secs=(F.col("id") / 100).cast("decimal(18,6)"))).alias("ts"), "id",
    )
    for part in range(2):
        ids.filter(F.floor(F.col("id") * 2 / n) == part).repartition(2).write.mode("append").parquet(source)
        query = S.stream_rate_limit(T.read_stream(spark, source, schema), out, str(tmp_path / "cp"), 1, 90)
        query.awaitTermination(240)
        seen = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        assert max(s["numRowsTotal"] for s in seen) <= 2048
    want = rate_limit(ids, max_requests=1, window_seconds=90)
    got = spark.read.parquet(out).select(want.columns)
    assert got.count() == n and got.exceptAll(want).isEmpty()


def test_windows_of_many_keys_advance_together():
    """Window by window and key by key it took a state call longer than all the rest; 20,000 keys are one pass now."""
    rng, window = random.Random(3), 50
    edges, seconds, counts, opened, used, want = [0], [], [], [], [], []
    for key in range(20_000):
        own = sorted(rng.sample(range(-300, 300), rng.randint(1, 20)))
        start, n = (own[0], 0) if key % 3 == 0 else (rng.randint(-600, 600), rng.randint(0, 5))
        opened.append(start), used.append(n)
        for second in own:
            count = rng.randint(1, 3)
            if second > start + window:
                start, n = second, 0
            want.append((start, n))
            seconds.append(second), counts.append(count)
            n += count
        edges.append(len(seconds))
    began = time.process_time()
    got = S._advance(*[np.array(x) for x in (edges, seconds, counts)], window, np.array(opened), np.array(used))
    assert list(zip(*[x.tolist() for x in got])) == want
    assert time.process_time() - began < 2
