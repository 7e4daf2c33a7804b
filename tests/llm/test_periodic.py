import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm.periodic import collapsed, periodic_runs, runs_of
from tagloom.llm.queries import op11_periodic_runs


def brute(words, least=12):
    """Every period by itself, every stretch by itself; smallest periods by trying all smaller ones."""
    found = []
    for p in range(1, len(words) // 2 + 1):
        at = 0
        while at + p < len(words):
            end = at
            while end + p < len(words) and words[end] == words[end + p]:
                end += 1
            size = end + p - at
            if end > at and size >= max(least, 2 * p):
                if not any(all(words[x] == words[x + q] for x in range(at, at + size - q)) for q in range(1, p)):
                    found.append((at, size, p))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def shaped(rng):
    n, k = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 4, 9])
    words = [b"%d" % rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(n)] = b"9"
    return words


def test_runs_equal_all_stretches_for_any_way_of_appending():
    rng = random.Random(5)
    for _ in range(1200):
        words = shaped(rng)
        want = brute(words)
        assert runs_of(words) == want
        assert runs_of(words, chunk=rng.choice([1, 3, 7, 16, 33])) == want
        assert collapsed(words, want).decode() == brute_collapsed([w.decode() for w in words], want)


def test_nested_and_longer_runs():
    line = [b"%d" % i for i in range(40)]
    words = [b"x"] + (line + [b"a"] * 14) * 3 + line[:10] + [b"y"]
    assert runs_of(words) == brute(words) == [(1, 172, 54), (41, 14, 1), (95, 14, 1), (149, 14, 1)]
    assert runs_of([b"a"] * 11) == [] and runs_of([b"a"] * 12) == [(0, 12, 1)]
    with pytest.raises(ValueError):
        runs_of([b"a"] * 30, shortest=4)


@pytest.mark.parametrize("kind", ["same", "fibonacci", "binary", "lines"])
def test_long_repetitive_texts_end_soon(kind):
    rng, n = random.Random(2), 100_000
    if kind == "fibonacci":
        short, words = [b"a"], [b"a", b"b"]
        while len(words) < n:
            short, words = words, words + short
    else:
        words = {"same": [b"a"] * n, "binary": [b"%d" % rng.randrange(2) for _ in range(n)]}.get(kind)
    if kind == "lines":
        lines = [[b"%d" % rng.randrange(300) for _ in range(20)] for _ in range(20)]
        words = [w for _ in range(n // 20) for w in rng.choice(lines)]
    start = time.perf_counter()
    found = runs_of(words)
    assert time.perf_counter() - start < 20
    assert len(found) <= len(words) and (kind != "same" or found == [(0, n, 1)])


def test_query_equals_its_contract_on_documents(spark, sf_dir, documents):
    want = {}
    for r in documents.collect():
        words = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1000:
            continue
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want[r.doc_id] = (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(text.encode()).hexdigest(),
            hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest(),
        )
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = op11_periodic_runs(spark, sf_dir)
    types = dict(got.dtypes)
    assert all(types[c] == "bigint" for c in columns[:5])
    rows = {r.doc_id: tuple(r[c] for c in columns) for r in got.collect()}
    assert len(rows) == documents.count() and {i: rows[i] for i in want} == want
    assert sum(r[0] > 0 for r in want.values()) > 10


def test_odd_rows(odd, none):
    got = periodic_runs(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count()
    for i in (4, 5, 6):
        assert (rows[i].n_words, rows[i].runs, rows[i].collapsed) == (0, [], "")
    assert [tuple(r) for r in rows[7].runs] == [(0, 40_000, 5)] and rows[7].collapsed == "lorem ipsum dolor sit amet"
    assert rows[12].collapsed == "nul\x00byte and 😀 emoji with İ ΣΑΣ"
    assert periodic_runs(none).collect() == []
    other = odd.select(F.col("doc_id").alias("n_words"), F.col("text").alias("runs"))
    assert periodic_runs(other, "n_words", "runs").count() == odd.count()
