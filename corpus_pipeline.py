"""A corpus from raw documents to token ids, one operator per stage.

Every stage works on all rows that the stage before kept, and all but the last
return the columns of ``documents``.  Inside a stage every row has a unique key,
its file and place in it, which operators get as id: a decision holds for its row,
also if the row's doc_id is null or carried by others, and of a group one row stays,
by doc_id and then by the key.  Filters remove the keys that an operator decided
against, by an anti-join whose small side Spark may broadcast under its own size limit.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.bpe import bpe_round_trip
from tagloom.llm.common import written
from tagloom.llm.exact_dedup import exact_dedup
from tagloom.llm.language import determined, learn
from tagloom.llm.mixing import mix
from tagloom.llm.near_dedup import near_duplicates


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique key per row, ``row_``: from its file and its place there.  Other inputs are written first."""
    at = ["_metadata.file_path", "_metadata.row_index"]
    try:
        placed = docs.select("*", F.col(at[0]).alias("path_"), F.col(at[1]).alias("index_"))
        placed.schema
    except AnalysisException:
        docs = written(docs, "rows")
        placed = docs.select("*", F.col(at[0]).alias("path_"), F.col(at[1]).alias("index_"))
    # The key is the hash of the file's path above the place in it.  Hashes of so many bits
    # that no two files share one: one row per file tells, and another seed is tried if not.
    files = written(placed.groupBy("path_").agg(F.max("index_").alias("top_")), "files")
    n, top = files.agg(F.count(F.lit(1)), F.coalesce(F.max("top_"), F.lit(0))).first()
    bits = max(int(top).bit_length(), 1)
    name = lambda seed: F.shiftrightunsigned(F.xxhash64("path_", F.lit(seed)), bits + 1)
    seed = next(s for s in range(1000) if files.select(name(s)).distinct().count() == n)
    key = F.shiftleft(name(seed), bits) + F.col("index_")
    return placed.withColumn("row_", key).select(*[docs[c] for c in docs.columns], "row_")


def _without(docs: DataFrame, rows: DataFrame, groups: DataFrame, *order: Column) -> DataFrame:
    """Of each group of ``groups(row, group)`` the first of ``rows`` by ``order``, doc_id and key; rows without a group stay."""
    ranked = rows.select(F.col("row_").alias("row"), F.struct(*order, F.col("doc_id").isNull(), "doc_id", "row_").alias("rank"))
    named = written(groups.join(ranked, "row"), "groups")
    first = named.groupBy("group").agg(F.min("rank").alias("first"))
    # The tag makes the planner exchange both sides, so that AQE can split a hot group.
    tag = F.xxhash64("group")
    gone = named.withColumn("tag", tag).join(first.withColumn("tag", tag), ["group", "tag"]).filter("row <> first.row_")
    return rows.join(gone.select("row"), F.col("row_") == F.col("row"), "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without any letter go."""
    return determined(docs, learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts: the longest, then the smallest id."""
    rows = _keyed(docs)
    groups = exact_dedup(rows, "row_").filter("group_size > 1").select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group"))
    return _without(docs, rows, groups, -F.coalesce(F.length("text"), F.lit(0)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    rows = _keyed(docs)
    groups = near_duplicates(rows, "row_").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    return _without(docs, rows, groups)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: none, once or twice."""
    rows = _keyed(docs)
    # The order of rows is that of their ids and texts, whatever file they lie in.
    mixed = mix(rows.withColumn("order_", F.xxhash64("doc_id", "text")), "row_", order_col="order_")
    copies = mixed.select(F.col("doc_id").alias("id_"), F.col("copies").alias("copies_"))
    joined = rows.join(copies, F.col("row_") == F.col("id_"))
    return joined.withColumn("copy_", F.explode(F.array_repeat(F.lit(1), F.col("copies_").cast("int")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every copy."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe_round_trip(docs, vocabulary_path)
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs


# Fitted models and rounding are beyond SQL: tests hold the stages against plain versions.
ORACLE_SQL = None
