from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm.common import written


def test_stages(spark, odd, none, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixture", "tokens"]
    for start in (odd, none):
        docs, columns = start, start.columns
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = written(stage(spark, docs, sf_dir), "test")
            assert number == 4 or docs.columns == columns
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_decisions_take_effect(spark, documents, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    assert got.agg(F.max("n")).first()[0] <= 2
    exact = corpus_pipeline.exact(spark, documents, sf_dir)
    squeezed = exact.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "").alias("t"))
    assert squeezed.distinct().count() == squeezed.count()


def test_decisions_hold_for_rows_without_an_own_id(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, f"{text} a"), (None, f"{text} a"), (4, f"{text} a"), (4, f"{text} a"), (4, "another text"), (9, f"{text} b")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    left = written(corpus_pipeline.exact(spark, docs, ""), "test")
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(4, "another text"), (4, f"{text} a"), (9, f"{text} b")]
    left = corpus_pipeline.near(spark, left, "")
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(4, "another text"), (4, f"{text} a")]
    none = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", "source")
    assert corpus_pipeline.exact(spark, none, "").count() == 3
    empty = spark.createDataFrame([(None, "", "x"), (None, "one two", "x")], docs.schema)
    assert corpus_pipeline.mixture(spark, empty, "").filter("text = ''").count() == 0
