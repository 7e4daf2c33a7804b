import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import outliers as ol

WORD = "[^\x20\x09-\x0d]+"


def brute_counts(text):
    """The contract's counts, straight from its words."""
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, inside = {}, set()
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    for places in seen.values():
        if len(places) > 1:
            inside |= {p + k for p in places for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(inside)


def brute_estimate(x, share=ol.SHARE):
    """The same estimate on one plain matrix of whole numbers."""
    floors = np.array(list(ol.FLOORS.values())) * ol.UNIT
    n, d = x.shape
    lower = lambda v: np.sort(v, axis=0)[(n - 1) // 2]
    middle = lower(x)
    spread = np.maximum(1.4826 * lower(np.abs(x - middle)), floors)
    o = x - middle
    z = o / spread
    length = np.sqrt((z**2).sum(1, keepdims=True))
    u = np.divide(z, length, out=np.zeros_like(z), where=length > 0)
    starts = [np.diag(spread**2.0), (u.T @ u / n * d) * np.outer(spread, spread) + np.diag(floors**2)]
    best = None
    for cov in starts:
        mean, before = np.zeros(d), math.inf
        for _ in range(ol.STEPS):
            squared = np.einsum("ij,jk,ik->i", o - mean, np.linalg.inv(cov), o - mean)
            classes = np.floor(16 * np.log2(np.clip(squared, 2.0**-10, 2.0**40)))
            last = np.sort(classes)[math.ceil(share * n - 1e-9) - 1]
            used = o[classes <= last]
            mean = used.mean(0)
            cov = np.cov(used.T, bias=True) * ol.consistency(share, d) + np.diag(floors**2)
            logdet = np.linalg.slogdet(cov)[1]
            if abs(logdet - before) <= 1e-9:
                break
            before = logdet
        if best is None or logdet < best[0]:
            best = (logdet, mean, cov)
    _, mean, cov = best
    squared = np.einsum("ij,jk,ik->i", o - mean, np.linalg.inv(cov), o - mean)
    used = o[squared <= ol.chi_square_cut(0.025, d)]
    mean = used.mean(0)
    cov = np.cov(used.T, bias=True) * ol.consistency(0.975, d) + np.diag(floors**2)
    return np.einsum("ij,jk,ik->i", o - mean, np.linalg.inv(cov), o - mean)


def test_base_counts_of_documents(documents):
    got = {r.doc_id: r for r in ol.statistics(documents).collect()}
    for r in documents.collect():
        n, *rest = brute_counts(r.text)
        found = got[r.doc_id]
        assert [found[c] for c in ol.BASE] == [n, *rest]
        assert found.base_failed == (n < 50 or 100 * rest[3] > 50 * n)


@pytest.mark.parametrize(
    "text", ["", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\n\nx\n x\nx \r\nx\r", "a b c d a b c", "# * $ %%&|<>", "é ü  ß​", "😀 \x1c x"]
)
def test_base_counts_of_odd_texts(text):
    text = text.encode("utf-16", "surrogatepass").decode("utf-16")
    assert ol.counts_of(text)[:5] == brute_counts(text)
    assert len(ol.transformed(ol.counts_of(text))) == ol.D


def test_chi_square():
    # Fixed values of the distribution with 8 degrees of freedom.
    assert abs(ol.chi_square_cut(0.05, 8) - 15.507) < 1e-3
    assert abs(ol.chi_square_cut(0.001, 8) - 26.124) < 1e-3
    assert abs(ol.consistency(0.999999, 8) - 1) < 1e-3 and ol.consistency(0.5, 8) > 1.5


def contaminated(seed, n=900, bad=200):
    rng = np.random.default_rng(seed)
    mix = np.eye(ol.D) + 0.4 * rng.normal(size=(ol.D, ol.D))
    clean = rng.normal(size=(n, ol.D)) @ mix
    far = rng.normal(size=(bad, ol.D)) * 0.3 + rng.normal(size=ol.D) * 8
    return np.round(np.vstack([clean, far]) * ol.UNIT).astype(int)


def distances(spark, groups, parts=3):
    rows = [(k, i, x.tolist()) for k, m in groups.items() for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, "key string, i int, x array<int>").repartition(parts)
    met = df.join(ol.fit(df.select("key", "x")), "key")
    squared = ol._squared_distance(F.col("x"), F.col("middle"), F.col("mean"), F.col("factor"))
    return {(r.key, r.i): r.d for r in met.select("key", "i", squared.alias("d")).collect()}


def test_estimates_equal_a_plain_version_and_see_through_contamination(spark):
    groups = {"a": contaminated(1), "b": contaminated(2, 300, 60), "same": np.full((90, ol.D), 7)}
    got = distances(spark, groups)
    for key, x in groups.items():
        mine = np.array([got[key, i] for i in range(len(x))])
        np.testing.assert_allclose(mine, brute_estimate(x), rtol=1e-6, atol=1e-9)
    cut = ol.chi_square_cut(0.001, ol.D)
    a = np.array([got["a", i] for i in range(1100)])
    assert (a[900:] > cut).all() and (a[:900] > cut).mean() < 0.02
    # Without robustness the far rows hide themselves.
    x = groups["a"] - groups["a"].mean(0)
    plain = np.einsum("ij,jk,ik->i", x, np.linalg.inv(np.cov(x.T)), x)
    assert (plain[900:] > cut).mean() < 0.5
    assert distances(spark, groups, parts=1) == got


def test_query_rejects_junk_and_keeps_the_rest(spark, sf_dir):
    from tagloom.llm.queries import op13_quality_rules

    docs = "/root/testdata/sf0.01"
    rows = op13_quality_rules(spark, docs).join(spark.read.parquet(f"{docs}/labels.parquet"), "doc_id").filter("not base_failed")
    kept = {r.quality: r.kept for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] > 0.98 and kept[0] < 0.3


def test_odd_rows(spark, odd, none):
    got = ol.quality_rules(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and dict(got.dtypes)["kept"] == "boolean"
    by = {r.doc_id: r for r in rows}
    for i in (4, 5, 6):
        assert by[i].n_words == 0 and by[i].base_failed and not by[i].kept
    # Too few rows for an estimate: the base rules alone decide.
    assert by[10].kept and by[10].squared_distance is None and not by[7].kept
    assert ol.quality_rules(none).collect() == []
    few = ol.quality_rules(odd.filter("doc_id in (10, 11)").unionByName(odd.filter("doc_id in (10, 11)")), least_rows=2)
    assert few.filter("kept and squared_distance is not null").count() == 4
