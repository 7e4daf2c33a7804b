import zlib

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm import language, quality
from tagloom.llm.common import fold


def test_fold_is_the_crc_of_the_id(spark):
    got = {r.id: r.f for r in spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}


def brute_pieces(train, text):
    """Longest matches from left to right by searching the training symbols."""
    train, pieces, at = "".join(map(chr, train)), 0, 0
    text = "".join(map(chr, text))
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in train:
            size += 1
        pieces, at = pieces + 1, at + size
    return pieces


def test_automaton_parses_into_longest_matches():
    random = np.random.default_rng(3)
    for _ in range(60):
        size = int(random.integers(2, 6))
        train, text = random.integers(0, size, int(random.integers(1, 80))), random.integers(0, size + 1, int(random.integers(1, 60)))
        automaton = language.Automaton(train, size + 1)
        columns = text.reshape(-1, 1)
        pieces, _ = automaton.parse(columns, [1] * len(columns))
        assert pieces[0] == brute_pieces(train.tolist(), text.tolist())


def test_languages_are_found_on_held_out_documents(documents):
    found = language.identify(documents, language.learn(documents)).join(documents.select("doc_id", "lang"), "doc_id")
    held = found.filter(fold(F.col("doc_id")) == 1)
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()


def test_language_odd_rows(odd, none):
    samples = language.learn(odd)
    got = {r.doc_id: r for r in language.identify(odd, samples).collect()}
    assert {got[i].lang_pred for i in (4, 5, 6, 9)} == {"und"} and got[4].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[7].lang_pred in samples
    assert language.identify(odd, samples).count() == odd.count()
    assert language.identify(none, language.learn(none)).collect() == []
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    kept = language.determined(odd, samples)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5


def test_dual_descent_reaches_the_optimum():
    """Primal and dual objectives meet."""
    random = np.random.default_rng(1)
    rows = [np.unique(random.integers(0, 40, 8)).astype(np.int32) for _ in range(60)]
    labels, ratios = np.array([int(r.sum() % 2) for r in rows]), random.normal(size=40)
    weights, bias = quality.dual_descent(rows, labels, ratios, epochs=3000)
    sign, share = np.where(labels == 1, 1, -1), np.where(labels == 1, labels.mean(), 1 - labels.mean())
    margins = np.array([(ratios[r] / np.sqrt(len(r))) @ weights[r] + bias for r in rows])
    primal = 0.5 * (weights @ weights + bias**2) + (0.5 / share * np.maximum(0, 1 - sign * margins)).sum()
    worse = [
        0.5 * (w @ w + b**2)
        + (0.5 / share * np.maximum(0, 1 - sign * np.array([(ratios[r] / np.sqrt(len(r))) @ w[r] + b for r in rows]))).sum()
        for w, b in ((weights + random.normal(size=40) * 1e-2, bias) for _ in range(20))
    ]
    assert primal <= min(worse) + 1e-6


def test_quality_on_held_out_documents(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    scored = quality.quality(docs, quality.train(docs, labels)).join(labels, "doc_id").filter(fold(F.col("doc_id")) == 1)
    right = scored.filter((F.col("score") >= 0.5).cast("int") == F.col("quality")).count()
    assert right >= 0.9 * scored.count()


def test_quality_odd_rows(odd, none):
    got = quality.quality(odd, quality.train(odd, odd)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.quality(none, quality.train(none, none)).collect() == []
    both = odd.withColumn("quality", F.when(F.col("doc_id") < 4, 0).otherwise(1))
    assert all(0 <= r.score <= 1 for r in quality.quality(odd, quality.train(both, both)).collect())


def test_rows_of_one_id_count_once_in_the_fit(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels, bits: fitted.append(len(rows)))
    ids = [i for i in range(40) if spark.range(1).select(fold(F.lit(i).cast("long"))).first()[0] != 1][:5]
    docs = spark.createDataFrame([(i, f"text {i} {n}") for i in ids for n in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    quality.train(docs, labels)
    assert fitted == [5]
