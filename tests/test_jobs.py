import json
import random

import pytest
from pyspark.sql import functions as F

from tagloom import (
    generate_rules,
    job_frontier,
    job_summary,
    latest_state,
    live_states,
    merge_retry,
    resolve_attempts,
    retry_set,
    run_job,
    url_lists,
)
from tagloom.operators.jobs import NOT_FETCHED, wanted_fetches
from tagloom.sources import tables as T

HTML = "<title>t</title><body><h1>A heading of sufficient length here</h1><p>" + "Words. " * 20 + "</p></body>"
FETCHES = [
    ("https://a.com/ok", 200, None, HTML),
    ("https://a.com/404", 404, "", HTML),
    ("https://a.com/refused", None, "port 443: refused", None),
    ("https://a.com/empty", 200, None, "0"),
    ("ftp://a.com/x", 200, None, HTML),
    ("nonsense", 500, "timeout", None),
    ("https://a.com/copies", 503, None, None),
    ("https://a.com/copies", 200, None, HTML),
    ("https://a.com/copies", 200, None, HTML),
]


def job(spark, urls, fetches=FETCHES):
    frontier = spark.createDataFrame([("j", i, u) for i, u in enumerate(urls)], "job_id string, pos int, url string")
    return run_job(frontier, spark.createDataFrame(fetches, T.FETCH_SCHEMA))


def test_every_url_gets_one_row(spark):
    urls = [f[0] for f in FETCHES[:7]] + ["https://a.com/ok", "https://a.com/unknown", "ftp://a.com/y"]
    rows = {r.pos: r for r in job(spark, urls).collect()}
    assert len(rows) == len(urls)
    ok = rows[0]
    assert (ok.status, ok.title, ok.og_title) == ("ok", "A heading of sufficient length here", ok.title)
    assert ok.robots.startswith("index, follow, max-snippet") and ok.ai_powered is False
    assert len(ok.description) <= 155 and ok.og_desc == ok.description and ok.error is None
    errors = {i: (rows[i].error, rows[i].error_code) for i in rows if rows[i].status == "error"}
    assert errors == {
        1: ("HTTP 404 on fetch", "404"),
        2: ("fetch failed: port 443: refused", "443"),
        3: ("empty response", "error"),
        4: ("only http and https are supported", "error"),
        5: ("invalid URL", "error"),
        8: (NOT_FETCHED, "error"),
        9: ("only http and https are supported", "error"),
    }
    assert rows[6].status == "ok" and rows[7].title == ok.title
    assert rows[1].title is None


def test_summary_retry_and_merge(spark):
    base = job(spark, ["https://a.com/ok", "https://a.com/404", "https://a.com/refused"]).drop("pos").cache()
    assert job_summary(base).collect()[0].asDict() == {
        "job_id": "j", "total": 3, "done": 3, "errors": 2, "success": 1,
    }
    assert {r.url for r in retry_set(base).collect()} == {"https://a.com/404", "https://a.com/refused"}
    again = job(
        spark,
        ["https://a.com/404", "https://a.com/404", "https://a.com/refused", "https://a.com/ok"],
        [("https://a.com/404", 200, None, HTML), ("https://a.com/refused", 503, None, None), ("https://a.com/ok", 500, None, None)],
    )
    merged = {r.url: r for r in merge_retry(base, again, keep=("job_id",)).collect()}
    before = {r.url: r for r in base.collect()}
    assert len(merged) == 3
    assert merged["https://a.com/ok"] == before["https://a.com/ok"]
    assert merged["https://a.com/404"].status == "ok"
    assert merged["https://a.com/refused"].error_code == "503"


def test_attempts(spark):
    rng = random.Random(3)
    messages = ["HTTP 404", "API error 429", "busy 503", "reset"]
    log, want = [], {}
    for u in range(200):
        tries = [(n, rng.random() < 0.25, rng.choice(messages)) for n in range(1, rng.randint(2, 6))]
        log += [(f"u{u}", n, ok, None if ok else m) for n, ok, m in tries]
        for n, ok, m in tries[:3]:
            want[f"u{u}"] = (n, ok, None if ok else m)
            if ok or not ("503" in m or "429" in m):
                break
    rng.shuffle(log)
    df = spark.createDataFrame(log, T.ATTEMPT_SCHEMA)
    assert {r.url: (r.attempts, r.ok, r.error) for r in resolve_attempts(df).collect()} == want


def test_states(spark):
    df = spark.createDataFrame(
        [("a", 10, "running", 1), ("a", 30, "done", 2), ("b", 5, "queued", 0), ("a", 30, "done", 3)],
        "job_id string, updated bigint, status string, done bigint",
    )
    latest = latest_state(df, tie="done")
    assert {tuple(r) for r in latest.collect()} == {("a", 30, "done", 3), ("b", 5, "queued", 0)}
    assert {r.job_id for r in live_states(latest, F.lit(3_605)).collect()} == {"a", "b"}
    assert {r.job_id for r in live_states(latest, F.lit(3_606)).collect()} == {"a"}


def test_url_lists(spark):
    df = spark.createDataFrame(
        [("j 1", ' ["u1","u2"]'), ("j2", "https://a.com"), ("j3", "[broken"), ("j4", '["u"] x')],
        "job_id string, arg string",
    )
    assert {tuple(r) for r in url_lists(df).collect()} == {
        ("j1", 0, "u1", None), ("j1", 1, "u2", None), ("j2", 0, None, "https://a.com"),
        ("j3", 0, None, "[broken"), ("j4", 0, None, '["u"] x'),
    }


def test_stored_records_and_sinks(spark, tmp_path):
    page = {
        "url": "https://a.com/x", "existing": {"title": "Old"}, "h1": "", "h2s": ["One"], "paragraphs": [],
        "jsonld": [], "page_type": "website", "body_text": "Body text.", "domain": "a.com",
    }
    (tmp_path / "in").mkdir()
    lines = [{"page": page, "overrides": {"description": "0", "keywords": "k"}}, {"overrides": {}}]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    pages, failures = T.read_records(spark, str(tmp_path / "in"))
    meta = generate_rules(pages).collect()
    assert [(m.title, m.description, m.keywords) for m in meta] == [(" – A", "Body text.", "k")]
    assert meta[0].llms_txt == "#  – A\n\nBody text.\n\n## Themen\n- One\n\n## Seiten\n- [ – A](https://a.com/x)"
    assert [f.error for f in failures.collect()] == [T.RECORD_MISSING]

    rows = spark.createDataFrame([(' a "quoted"\nline ', None), ("", "é")], "x string, y string")
    T.export_csv(rows, str(tmp_path / "csv"))
    back = T.read_csv(spark, str(tmp_path / "csv"), "x string, y string")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    T.write_rows(rows, str(tmp_path / "orc"), "orc")
    assert T.read_table(spark, str(tmp_path / "orc"), "x string, y string", "orc").count() == 2


def test_job_document_is_evaluated_once_and_marked_last(spark, tmp_path, sf_dir):
    path, evaluated = str(tmp_path / "job"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            evaluated.add(batch.num_rows)
            yield batch

    schema = "job_id string, url string, status string"
    values = [("a", "u1", "ok"), ("a", "u2", "error"), ("b", "ü", "ok")]
    rows = spark.createDataFrame(values, schema).mapInArrow(counted, schema)
    T.write_job(rows, path)
    assert evaluated.value == 3
    stored, counters = T.read_job(spark, path, schema)
    assert sorted(map(tuple, stored.collect())) == sorted(values)
    assert sorted(map(tuple, counters.collect())) == [("a", 2, 2, 1, 1), ("b", 1, 1, 0, 1)]

    def broken(batches):
        yield next(batches)
        raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        T.write_job(spark.createDataFrame(values, schema).mapInArrow(broken, schema), path, mode="overwrite")
    # The older mark no longer vouches for what is there now.
    with pytest.raises(OSError, match="no whole job"):
        T.read_job(spark, path, schema)
    T.write_job(spark.createDataFrame([], schema), path, mode="overwrite")
    assert T.read_job(spark, path, schema)[1].collect() == []


def test_job_arguments_become_urls(spark):
    docs = [
        ("https://a.com/sitemap.xml", 200, "<urlset><url><loc>https://a.com/1</loc></url><url><loc>https://a.com/2</loc></url></urlset>"),
    ]
    site_docs = spark.createDataFrame(docs, "doc_url string, http_status int, body string")
    jobs = spark.createDataFrame(
        [("j1", "https://a.com/"), ("j/2", ' ["u", "v", "u"] '), ("j3", "https://gone.com"), ("j4", "[]"), ("j5", "https://a.com/")],
        "job_id string, arg string",
    )
    frontier, failures = job_frontier(jobs, site_docs)
    assert sorted((r.job_id, r.pos, r.url) for r in frontier.collect()) == [
        ("j1", 0, "https://a.com/1"), ("j1", 1, "https://a.com/2"), ("j2", 0, "u"), ("j2", 1, "v"), ("j2", 2, "u"),
        ("j5", 0, "https://a.com/1"), ("j5", 1, "https://a.com/2"),
    ]
    assert sorted(r.job_id for r in failures.collect()) == ["j3", "j4"]


def test_only_wanted_fetches_are_extracted(spark):
    fetches = spark.range(20_000).select(F.concat(F.lit("https://a.com/"), "id").alias("url"), F.lit("x").alias("html"))
    frontier = fetches.filter(F.xxhash64("url") % 100 == 0).select("url")
    n = frontier.count()
    kept = wanted_fetches(fetches, frontier)
    assert n <= kept.count() <= n + 20 and kept.join(frontier, "url", "left_semi").count() == n
    # Too small a filter lets more through and loses nothing.
    small = wanted_fetches(fetches, frontier, bits=256)
    assert n < small.count() and small.join(frontier, "url", "left_semi").count() == n
    assert wanted_fetches(fetches, frontier.limit(0)).count() == 0
