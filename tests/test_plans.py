"""Plan shapes that matter at scale."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tagloom import extract_pages, generate_rules, run_job
from tagloom.operators.joins import lookup, unique_by
from tagloom.plans import inputs as I
from tagloom.sources import tables as T


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def test_extraction_and_rules_never_shuffle(spark, sf_dir):
    df = generate_rules(extract_pages(pages(spark, sf_dir), keep=("page_id",)), keep=("page_id",))
    assert "Exchange" not in plan(df) and "Python" not in plan(df)


def test_unused_work_is_pruned(spark, sf_dir):
    records = extract_pages(pages(spark, sf_dir))
    narrow = plan(records.select("url", "domain"))
    assert "html" not in re.search(r"ReadSchema: (\S+)", narrow).group(1)
    title = plan(records.select("existing.title"))
    assert "<meta" not in title and "<h2" not in title and "nav|footer" not in title


def test_documents_are_not_exchanged_by_a_job(spark, sf_dir):
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        rows = run_job(I.frontier(spark, sf_dir), T.fetches_of_pages(pages(spark, sf_dir)))
        # Below each exchange of the result side only narrow columns may remain.
        text = plan(rows)
    above = text.split("Exchange hashpartitioning")
    assert len(above) > 2
    for part in above[1:]:
        head = part.split("\n")[1]
        assert "html" not in head and "body_text" not in head


def test_a_job_extracts_what_its_frontier_wants(spark, sf_dir):
    """With broadcasts off: the filter stands below the extraction, and its fixed size is broadcast all the same."""
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        fetches = T.fetches_of_pages(pages(spark, sf_dir))
        frontier = I.frontier(spark, sf_dir).limit(1)
        rows = run_job(frontier, fetches)
        text = plan(rows)
        assert text.index("regexp_extract") < text.index("BroadcastNestedLoopJoin")
        assert rows.collect()[0].status == "ok"


@pytest.mark.parametrize(
    "name", "meta_rules overrides_apply prompt_build model_generate response_apply job_rows link_frontier page_links".split()
)
def test_no_registered_query_exchanges_documents(spark, sf_dir, name):
    from tagloom.plans.queries import queries

    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        df = queries()[name](spark, sf_dir)
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    for columns in re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\n", text):
        names = {c.rsplit("#", 1)[0].strip() for c in columns.split(",")}
        assert not names & {"html", "body", "body_text", "paragraphs", "_markup", "_body", "_text"}, columns


def test_hot_keys_are_split(spark):
    """A third of the left rows share a key and both sides are shuffled."""
    left = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"),
        F.sha2(F.col("id").cast("string"), 512).alias("payload"),
    )
    right = unique_by(
        left.select("url", F.length("url").alias("n")).filter(F.col("n") < 6), "url", "n"
    )
    with settings(
        spark,
        **{
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        },
    ):
        joined = lookup(left.repartition(8), right, "url")
        assert joined.count() == 300_000
        rows = joined.filter(F.col("n").isNotNull())
        assert rows.filter(F.col("url") == "hot").count() == 100_000
        written = lookup(left.repartition(8), right, "url")
        written.write.format("noop").mode("overwrite").save()
        written.collect()
        assert "SortMergeJoin(skew=true)" in plan(written)


@pytest.mark.parametrize("operator", ["job_summary", "attempts_resolved", "job_latest"])
def test_aggregates_combine_before_the_exchange(spark, sf_dir, operator):
    from tagloom.plans.queries import queries

    text = plan(queries()[operator](spark, sf_dir))
    assert re.search(r"partial_(max|count|min)", text)


def test_frontier_cap_limits_before_the_exchange(spark, sf_dir):
    from tagloom.plans.queries import queries

    assert "WindowGroupLimit" in plan(queries()["link_frontier"](spark, sf_dir))
