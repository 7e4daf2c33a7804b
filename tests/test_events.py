import json

from pyspark.sql import functions as F

import pyarrow as pa

from tagloom import run_job
from tagloom.operators.events import EVENT_SCHEMA, job_events
from tagloom.sources import tables as T
from tagloom.sources.feed import FeedWriter, read_feed
from tagloom.streaming import streams as S

HTML = "<title>t</title><body><h1>A heading of sufficient length here</h1><p>" + "Words. " * 20 + "</p></body>"
FRONTIER = [("a", 0, "https://a.com/1"), ("a", 1, "https://a.com/2"), ("b", 0, "https://a.com/2"), ("b", 1, "https://a.com/3"), ("b", 2, "https://a.com/1")]
FETCHES = [("https://a.com/1", 200, None, HTML), ("https://a.com/2", 503, None, None), ("https://a.com/3", 200, None, HTML), ("https://a.com/4", 200, None, HTML)]


def tables(spark):
    frontier = spark.createDataFrame(FRONTIER, "job_id string, pos int, url string")
    return frontier, spark.createDataFrame(FETCHES, T.FETCH_SCHEMA)


def listed(df):
    return sorted((r.job_id, r.seq, r.event, r.data) for r in df.collect())


def test_events_of_a_job_in_order(spark):
    frontier, fetches = tables(spark)
    attempts = [("https://a.com/1", 1, False, "API error 503"), ("https://a.com/1", 2, False, "HTTP 429"), ("https://a.com/1", 3, True, None), ("https://a.com/3", 1, False, "HTTP 404")]
    log = spark.createDataFrame(attempts, T.ATTEMPT_SCHEMA)
    events = [(e, json.loads(d)) for job, _, e, d in listed(job_events(frontier, run_job(frontier, fetches), log)) if job == "a"]
    assert [e for e, _ in events] == ["urls_found", "progress", "progress", "progress", "progress", "result", "progress", "result", "done"]
    assert events[0][1] == {"count": 2, "urls": ["https://a.com/1", "https://a.com/2"]}
    assert [d["phase"] for e, d in events if e == "progress"] == ["crawling", "generating", "retry", "retry", "crawling"]
    assert [d["attempt"] for _, d in events if d.get("phase") == "retry"] == [1, 2]
    ok, failed = [d for e, d in events if e == "result"]
    assert ok["current"] == 1 and ok["total"] == 2 and ok["row"]["status"] == "ok" and ok["row"]["ai_powered"] is False
    assert failed["row"] == {"url": "https://a.com/2", "status": "error", "error": "HTTP 503 on fetch", "errorCode": "503"}
    assert events[-1][1] == {"total": 2, "success": 1, "errors": 1}


def test_feed_over_batches_equals_the_batch(spark, tmp_path):
    """Three micro-batches, each by a new query that goes on from the checkpoint."""
    frontier, fetches = tables(spark)
    source, path = str(tmp_path / "in"), str(tmp_path / "feed")
    for url in (FETCHES[1][0], FETCHES[0][0], FETCHES[2][0]):
        fetches.filter(F.col("url") == url).coalesce(1).write.mode("append").parquet(source)
        stream = T.read_stream(spark, source, T.FETCH_SCHEMA)
        S.stream_events(frontier, stream, path, str(tmp_path / "cp")).awaitTermination(120)
    feed = read_feed(spark, path)
    assert listed(feed) == listed(job_events(frontier, run_job(frontier, fetches)))
    when = {(r.job_id, r.event): r.batch for r in feed.filter("event IN ('urls_found', 'done')").collect()}
    assert when["a", "urls_found"] < when["a", "done"] < when["b", "done"] and when["b", "urls_found"] == when["a", "urls_found"]


def test_a_replayed_batch_leaves_the_same_feed(spark, tmp_path):
    writer, path = FeedWriter(str(tmp_path)), str(tmp_path)
    schema = pa.schema([("job_id", pa.string()), ("seq", pa.int64()), ("event", pa.string()), ("data", pa.string())])

    def batch(*rows):
        return iter([pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)])

    first = writer.write(batch(("a", 0, "urls_found", "{}"), ("a", 16, "progress", '{"url":"ü"}')))
    writer.commit([first, writer.write(iter([])), None], 0)
    # Written but never committed: the batch is tried again and then committed twice.
    writer.abort([writer.write(batch(("a", 31, "result", "lost")))], 1)
    for _ in range(2):
        writer.commit([writer.write(batch(("a", 31, "result", "{}"), ("a", 32, "done", None)))], 1)
    got = sorted(tuple(r) for r in read_feed(spark, path).collect())
    assert got == [(0, "a", 0, "urls_found", "{}"), (0, "a", 16, "progress", '{"url":"ü"}'), (1, "a", 31, "result", "{}"), (1, "a", 32, "done", None)]
    assert read_feed(spark, path).columns == ["batch", *[c.split()[0] for c in EVENT_SCHEMA.split(", ")]]


def test_an_empty_feed_can_be_read(spark, tmp_path):
    writer = FeedWriter(str(tmp_path))
    writer.commit([writer.write(iter([]))], 0)
    assert read_feed(spark, str(tmp_path)).collect() == []
