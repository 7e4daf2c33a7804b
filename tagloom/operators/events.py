"""The events of a job, in order: which urls it found, how it gets on, every result, its end.

An event is ``(job_id, seq, event, data)`` with ``data`` as JSON.  ``seq`` orders the events
of a job without gaps having to be filled: a url's events share its place in the frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.config import DEFAULTS, Options
from tagloom.functions.errors import is_transient
from tagloom.operators.joins import lookup

EVENT_SCHEMA = "job_id string, seq bigint, event string, data string"
# Places of a url's events behind ``_STEP * current``; retries follow ``generating``.
_STEP, _GENERATING, _RESULT = 16, 1, 15
ROW_FIELDS = ["url", "title", "description", "keywords", "og_title", "og_desc", "robots", "ai_powered", "status", "error"]


def numbered_frontier(frontier: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(job_id, url, current, total)`` of ``frontier(job_id, pos, url)``; ``pos`` counts from 0 without gaps."""
    totals = frontier.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    return lookup(frontier.select(*keep, "job_id", "url", _current()), totals, "job_id", "inner")


def _current() -> Column:
    return (F.col("pos") + 1).cast("bigint").alias("current")


def _event(name: str, seq: Column, **data: Column) -> Column:
    fields = F.struct(*[c.alias(k) for k, c in data.items()])
    return F.struct(seq.cast("bigint").alias("seq"), F.lit(name).alias("event"), F.to_json(fields).alias("data"))


def _progress(phase: str, place: Column | int, **more: Column) -> Column:
    at = _STEP * F.col("current") + place
    return _event("progress", at, current=F.col("current"), total=F.col("total"), url=F.col("url"), phase=F.lit(phase), **more)


def url_events(rows: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Events of ``rows(job_id, current, total, …result fields)``, several per row.

    An optional column ``retries`` lists the attempts that failed for a passing reason.
    A page that could not be fetched is not generated from.
    """
    row = F.struct(*[F.col(f) for f in ROW_FIELDS], F.col("error_code").alias("errorCode"))
    # An address that was tried against a model has been fetched, whatever came of it.
    tried = F.col("status") == "ok"
    retries = F.array().cast("array<int>")
    if "retries" in rows.columns:
        tried, retries = tried | F.col("retries").isNotNull(), F.coalesce("retries", retries)
    crawling, generating = _progress("crawling", 0), _progress("generating", _GENERATING)
    again = F.transform(
        F.slice(retries, 1, options.max_attempts), lambda n: _progress("retry", n + _GENERATING, attempt=n)
    )
    result = _event("result", _STEP * F.col("current") + _RESULT, current=F.col("current"), total=F.col("total"), row=row)
    events = F.concat(
        F.array(crawling), F.when(tried, F.concat(F.array(generating), again)).otherwise(F.array().cast(_events())), F.array(result)
    )
    return rows.select("job_id", F.explode(events).alias("e")).select("job_id", "e.*")


def _events() -> str:
    return "array<struct<seq: bigint, event: string, data: string>>"


def urls_found(numbered: DataFrame) -> DataFrame:
    """One event per job with its urls in order; they fit a row, as a job's argument or cap does."""
    urls = F.transform(F.array_sort(F.collect_list(F.struct("current", "url"))), lambda u: u["url"])
    jobs = numbered.groupBy("job_id").agg(F.max("total").alias("total"), urls.alias("urls"))
    return jobs.select("job_id", _event("urls_found", F.lit(0), count=F.col("total"), urls=F.col("urls")).alias("e")).select("job_id", "e.*")


def done_event(total: Column, errors: Column) -> Column:
    return _event("done", _STEP * (total + 1), total=total, success=total - errors, errors=errors)


def retried(attempts: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """``(url, retries)`` of an attempt log: the numbers of failures that were tried again."""
    again = ~F.col("ok") & is_transient("error") & (F.col("n") < options.max_attempts)
    return attempts.groupBy("url").agg(F.array_sort(F.collect_set(F.when(again, F.col("n").cast("int")))).alias("retries"))


def job_events(
    frontier: DataFrame, rows: DataFrame, attempts: DataFrame | None = None, options: Options = DEFAULTS
) -> DataFrame:
    """All events of finished jobs: ``frontier(job_id, pos, url)`` and its result ``rows``, those of ``run_job``.

    ``rows`` carry ``job_id`` and ``pos``; ``attempts(url, n, ok, error)`` adds the retries.
    """
    counted = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "error").alias("errors"))
    placed = lookup(rows.withColumn("current", _current()), counted.select("job_id", "total"), "job_id", "inner")
    if attempts is not None:
        placed = lookup(placed, retried(attempts, options), "url")
    ends = counted.select("job_id", done_event(F.col("total"), F.col("errors")).alias("e")).select("job_id", "e.*")
    return reduce(DataFrame.unionByName, [urls_found(numbered_frontier(frontier)), url_events(placed, options), ends])
