"""The registered queries of this subpackage: thin digests of its operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import spans
from tagloom.llm.common import WORD, fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def _digests(df: DataFrame, base: str, found: str, kinds: tuple[str, ...]) -> DataFrame:
    counts = [spans.count_of(F.col(base), k).alias(f"n_{k}") for k in kinds]
    return df.select(
        "doc_id", *counts, spans.digest(F.col(base)).alias("base_sha256"), spans.listed(F.col(found)).alias("spans")
    )


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.pii import KINDS, find_personal_data

    return _digests(find_personal_data(_table(spark, sf_dir, "documents")), "base", "found", KINDS)


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    from tagloom.llm.bpe import bpe_round_trip

    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("word_bpe_49k.json")
    tokens = bpe_round_trip(_table(spark, sf_dir, "documents"), vocabulary_path)
    return tokens.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.language import identify, learn

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.substrings import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.secrets import KINDS, scan_commits

    # The table as two commits: a first one of about half its rows, then all of it, which
    # scans what the ledger lacks and takes the rest from there.
    docs = _table(spark, sf_dir, "documents")
    found, _ = scan_commits([docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), docs])
    return _digests(found.withColumnRenamed("id", "doc_id"), "spans", "spans", KINDS)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.quality import quality, train

    docs = _table(spark, sf_dir, "documents")
    scored = quality(docs, train(docs, _table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def _planted(docs: DataFrame) -> DataFrame:
    """Texts of the ids that the contract names, with a periodic tail; all other rows as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = docs.filter(h % 10 == 0).select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g"))
    n, g = F.greatest(F.size("words"), F.lit(1)), F.col("g")
    shaped = chosen.withColumn("a", (g % n).cast("int")).withColumn("rest", n - F.col("a"))
    shaped = shaped.withColumn("p", (1 + F.floor(F.col("rest") / (3 + g % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil(F.col("rest") / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), F.col("rest"))
    new = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    changed = shaped.select("doc_id", F.when(F.size("words") > 0, new).otherwise(F.col("text")).alias("text"))
    return docs.filter((h % 10 != 0) | h.isNull()).select("doc_id", "text").unionByName(changed)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.periodic import periodic_runs

    found = periodic_runs(_planted(_table(spark, sf_dir, "documents")))
    rank = F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("*", F.array_max(rank).alias("best"), F.array_join(lines, "").alias("lines"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.divergence import divergence

    return divergence(_table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.outliers import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}
