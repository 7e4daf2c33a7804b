import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import divergence as dv


def p_of(c, total, size):
    return 1 + 10**9 * (c + 2) // (total + 2 * size)


def f_of(p, q):
    return (p - q) ** 2 // (p + q)


def brute(rows, least=10, top=10):
    """Dense columns over the vocabulary, one term at a time."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = {i: i + 32 for i in range(0x41, 0x5B)}
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(lower))
        groups[lang].add(source)
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        size = len(kept)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        whole = sum(total.values())
        for s in sources:
            pairs = []
            for other in sources - {s}:
                value = 0
                for t in kept:
                    value += f_of(p_of(count[lang, s][t], total[s], size), p_of(count[lang, other][t], total[other], size))
                pairs.append((other, value))
            apart = []
            for t in kept:
                p, q = p_of(count[lang, s][t], total[s], size), p_of(sum(count[lang, x][t] for x in sources), whole, size)
                if count[lang, s][t] and p > q:
                    apart.append((t, f_of(p, q)))
            for part, items, limit in (("pair", pairs, None), ("term", apart, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:limit])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("cells", [dv.BLOCK_CELLS, 40])
def test_equals_dense_columns(spark, cells):
    """Also when the vocabulary lies in many small blocks."""
    rng = random.Random(4)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "éa", "日本", "ﬀ", "ZZ"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    rows = [
        (rng.choice(["en", "de", None, "none"]), rng.choice(["a", "b", "c", None, "é"]), "-".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40))))
        for _ in range(400)
    ]
    rows = [(x, s, "1 2 3" if x == "none" else t) for x, s, t in rows] + [("solo", "only", "word " * 3)] * 12 + [("en", "z", None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    got = dv.divergence(df, block_cells=cells)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    want = brute(rows)
    assert rows_of(got) == want and {r[0] for r in want} == {"en", "de", "", "none"}
    # A language without kept terms gives zeros; of a single source there are no pairs and nothing stands out.
    assert {r[4] for r in want if r[0] == "none"} == {0}


def test_run_lengths_do_not_depend_on_dealing():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (4, 200)) * rng.integers(0, 2, (4, 200))
    lengths = rng.integers(1, 5, 200)
    totals = [int((row * lengths).sum()) for row in counts]
    whole = dv.pair_sums(counts, lengths, totals, int(lengths.sum()))
    parts = sum(dv.pair_sums(counts[:, i::7], lengths[i::7], totals, int(lengths.sum())) for i in range(7))
    assert (whole == parts).all() and (whole == whole.T).all()
    for a in range(4):
        for b in range(4):
            one = [f_of(p_of(int(x), totals[a], int(lengths.sum())), p_of(int(y), totals[b], int(lengths.sum()))) * int(n) for x, y, n in zip(counts[a], counts[b], lengths)]
            assert whole[a, b] == sum(one)
    assert (dv.pair_sums(np.zeros((3, 0), np.int64), np.zeros(0, np.int64), [0, 0, 0], 0) == 0).all()


def test_counts_beyond_64_bit_products():
    big = 5 * 10**11
    sums = dv.pair_sums(np.array([[big, 1], [1, big]]), np.array([1, 1]), [big + 1, big + 1], 2)
    p, q = p_of(big, big + 1, 2), p_of(1, big + 1, 2)
    assert sums[0, 1] == 2 * f_of(p, q)


def test_odd_rows(odd, none, rows):
    got = dv.divergence(odd, least_docs=2)
    assert rows_of(got) == brute([(r[2], r[3], r[1]) for r in rows], least=2)
    assert dv.divergence(none).collect() == []
    other = odd.select(F.col("lang").alias("term"), F.col("source").alias("counts"), F.col("text").alias("block"))
    assert rows_of(dv.divergence(other, "term", "counts", "block", least_docs=2)) == rows_of(got)
