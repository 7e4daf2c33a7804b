"""Sources and sinks: schemas, batch and streaming readers, result writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.jobs import job_summary
from tagloom.operators.pages import EXISTING_FIELDS
from tagloom.operators.rules import OVERRIDE_COUNT, OVERRIDE_FIELDS

FETCH_SCHEMA = "url string, http_status int, fetch_error string, html string"
SITE_DOC_SCHEMA = "doc_url string, http_status int, body string"
OVERRIDE_SCHEMA = "url string, title string, keywords string, description string"
RESPONSE_SCHEMA = "url string, provider string, http_status int, raw string"
ATTEMPT_SCHEMA = "url string, n int, ok boolean, error string"
_EXISTING = ", ".join(f"{f}: string" for f in EXISTING_FIELDS)
RECORD_SCHEMA = f"""
    page struct<url: string, existing: struct<{_EXISTING}>, h1: string, h2s: array<string>,
        paragraphs: array<string>, jsonld: array<string>, page_type: string,
        body_text: string, domain: string>,
    overrides struct<title: string, keywords: string, description: string>
"""
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
RECORD_MISSING = "page data missing"
_MARK = "total bigint, errors bigint"


def read_table(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """Batch scan with a declared schema (no inference pass over the data)."""
    return spark.read.schema(schema).format(format).load(path)


def read_fetches(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_table(spark, path, FETCH_SCHEMA, format)


def read_site_docs(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_table(spark, path, SITE_DOC_SCHEMA, format)


def read_stream(
    spark: SparkSession, path: str, schema: str, format: str = "parquet", **options: str
) -> DataFrame:
    """Directory stream; ``maxFilesPerTrigger`` and friends go to ``options``."""
    return spark.readStream.schema(schema).format(format).options(**options).load(path)


def fetches_of_pages(pages: DataFrame) -> DataFrame:
    """Pages that were all fetched fine, as fetch results."""
    return pages.withColumns(
        {"http_status": F.lit(200), "fetch_error": F.lit(None).cast("string")}
    )


def read_records(spark: SparkSession, path: str, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored ``{page, overrides}`` documents: records and failures.

    Overrides belong to their own document: they become ``o_*`` columns of its
    record, also where several documents share a url.  A document without a page
    becomes a row of ``failures(url, error)``.  ``counted`` reads ``n`` too, the number
    of overrides that the document's page has.
    """
    documents = spark.read.schema(RECORD_SCHEMA + (", n bigint" if counted else "")).json(path)
    own = [F.col(f"overrides.{f}").alias(f"o_{f}") for f in OVERRIDE_FIELDS]
    own += [F.col("n").alias(OVERRIDE_COUNT)] if counted else []
    pages = documents.filter(F.col("page").isNotNull()).select("page.*", *own)
    failures = documents.filter(F.col("page").isNull()).select(
        F.lit(None).cast("string").alias("url"), F.lit(RECORD_MISSING).alias("error")
    )
    return pages, failures


def write_rows(rows: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    rows.write.format(format).mode(mode).save(path)


def write_job(rows: DataFrame, path: str, by: str = "job_id", mode: str = "error") -> None:
    """A job's result document: its rows, then its counters, then a mark that both are whole.

    The rows are evaluated once; counters come from what was written and are held against
    the rows that were seen going in.  Without ``done``, which is written last, the
    document is not there for ``read_job``.
    """
    spark, seen = rows.sparkSession, Observation()
    failed = F.count_if(F.col("status") == "error")
    if mode == "overwrite":
        # An older mark must not vouch for half a document.
        spark.createDataFrame([], _MARK).write.mode(mode).json(f"{path}/done")
    observed = rows.observe(seen, F.count(F.lit(1)).alias("total"), failed.alias("errors"))
    observed.write.mode(mode).json(f"{path}/rows")
    stored = spark.read.schema(rows.schema).json(f"{path}/rows")
    job_summary(stored.select(by, "status"), by).write.mode(mode).json(f"{path}/summary")
    written = spark.read.schema("total bigint, errors bigint").json(f"{path}/summary")
    total, errors = written.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("errors"), F.lit(0))).first()
    if (total, errors) != (seen.get["total"], seen.get["errors"]):
        raise OSError(f"{path}: {total} rows and {errors} errors were stored of {seen.get}")
    spark.createDataFrame([(total, errors)], _MARK).coalesce(1).write.mode(mode).json(f"{path}/done")


def read_job(spark: SparkSession, path: str, schema: str, by: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """Rows and counters of a whole job document."""
    if spark.read.schema(_MARK).json(f"{path}/done").isEmpty():
        raise OSError(f"{path} holds no whole job document")
    counters = f"{by} string, total bigint, done bigint, errors bigint, success bigint"
    return spark.read.schema(schema).json(f"{path}/rows"), spark.read.schema(counters).json(f"{path}/summary")


def export_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Result table for spreadsheets; quotes, line breaks and outer spaces survive."""
    rows.write.mode(mode).options(**CSV_OPTIONS, quoteAll=True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=True).csv(path)
