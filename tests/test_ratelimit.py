import random
from datetime import datetime, timedelta, timezone

import pytest
from tests_support import model_limit as model

from tagloom.operators.ratelimit import open_windows, rate_limit

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "key string, ts timestamp, id bigint"


def decisions(df):
    return {r.id: (r.window_start, r.request_count, r.allowed) for r in df.collect()}


def rows_at(seconds, key="a"):
    return [(key, START + timedelta(seconds=s), i) for i, s in enumerate(seconds)]


def test_golden(spark):
    df = spark.createDataFrame(rows_at([0, 10, 30, 60, 61, 62, 121, 122]), SCHEMA)
    got = decisions(rate_limit(df, max_requests=2, window_seconds=60))
    base = int(START.timestamp())
    assert [got[i][0] - base for i in range(8)] == [0, 0, 0, 0, 61, 61, 61, 122]
    assert [got[i][1] for i in range(8)] == [1, 2, 3, 4, 1, 2, 3, 1]
    assert [got[i][2] for i in range(8)] == [True, True, False, False, True, True, False, True]


@pytest.mark.parametrize("batch_size", [7, 10_000])
def test_against_model(spark, batch_size):
    rng = random.Random(batch_size)
    # One key holds about a third of all requests, some keys are nearly idle.
    keys = ["hot"] * 10 + [f"k{i}" for i in range(20)]
    rows = [
        (rng.choice(keys), START + timedelta(milliseconds=rng.randrange(900_000)), i)
        for i in range(4_000)
    ]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_size))
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        assert decisions(rate_limit(df, max_requests=3, window_seconds=60)) == model(rows, 3, 60)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_state_continues_open_windows(spark):
    rng = random.Random(5)
    times = sorted(rng.randrange(600_000) for _ in range(900))
    rows = [
        (rng.choice("abc"), START + timedelta(milliseconds=t), i) for i, t in enumerate(times)
    ]
    got, state = {}, None
    for part in (rows[:300], rows[300:301], rows[301:]):
        df = spark.createDataFrame(part, SCHEMA)
        decided = rate_limit(df, max_requests=4, window_seconds=60, state=state)
        opened = open_windows(decided)
        got |= decisions(decided)
        fresh = {r.key: (r.key, r.window_start, r.used) for r in opened.collect()}
        old = {} if state is None else {r.key: tuple(r) for r in state.collect()}
        state = spark.createDataFrame(
            list({**old, **fresh}.values()), "key string, window_start bigint, used bigint"
        )
    assert got == model(rows, 4, 60)


def test_requests_without_key_share_one(spark):
    rows = [(None, START, 1), (None, START, 2)]
    got = decisions(rate_limit(spark.createDataFrame(rows, SCHEMA), max_requests=1))
    assert sorted(v[2] for v in got.values()) == [False, True]


def test_requests_without_a_time_stay(spark):
    rows = [("a", None, 1), ("a", START, 2), ("a", START, 3), (None, None, 4)]
    got = decisions(rate_limit(spark.createDataFrame(rows, SCHEMA), max_requests=1, window_seconds=60))
    base = int(START.timestamp())
    assert got == {1: (None, None, None), 4: (None, None, None), 2: (base, 1, True), 3: (base, 2, False)}


def test_one_second_over_many_partitions(spark):
    rows = [("a", START + timedelta(microseconds=i % 50), i) for i in range(3000)]
    rows += [("b", START + timedelta(seconds=i), 5000 + i) for i in range(200)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = decisions(rate_limit(spark.createDataFrame(rows, SCHEMA), max_requests=5, window_seconds=60))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == model(rows, 5, 60)
