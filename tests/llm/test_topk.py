import math
import random

from pyspark.sql import functions as F

from tagloom.llm.topk import top_k


def brute(rows, k=10):
    good = [
        (i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    queries = {}
    for i, v in good:
        if i % 100 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, norm int, band int, ints int")
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0, **options).collect())


def vectors(n, dims, seed, scale=1.0):
    r = random.Random(seed)
    mean = [r.gauss(0, 1) for _ in range(dims)]
    rows = []
    for i in range(n):
        length = scale * r.choice([0.1, 1, 1, 3])
        rows.append((i, [float(F32(length * (m + r.gauss(0, 0.7)))) for m in mean], 0, 1, 2, 3))
    return rows


def F32(x):
    import numpy as np

    return np.float32(x)


def test_equals_brute_force_over_many_bands(spark):
    rows = vectors(900, 12, 1)
    assert run(spark, rows, band_rows=64, chunk_rows=4) == brute(rows)


def test_equal_vectors_and_ties(spark):
    same = [float(F32(0.25)), float(F32(-0.5))]
    rows = [(i, same, 0, 1, 2, 3) for i in range(400)] + vectors(100, 2, 2)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    assert run(spark, rows, band_rows=50) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 0, 1, 2, 3), (100, [0.5], 0, 1, 2, 3), (200, [], 0, 1, 2, 3), (1, None, 0, 1, 2, 3),
        (2, [None, 1.0], 0, 1, 2, 3), (3, [float("nan")], 0, 1, 2, 3), (4, [float("inf")], 0, 1, 2, 3),
        (None, [1.0], 0, 1, 2, 3), (5, [-1.0, 3.0], 0, 1, 2, 3), (5, [-1.0, 3.0], 0, 1, 2, 3), (300, None, 0, 1, 2, 3),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 0, 1, 2, 3)]) == []


def test_huge_components_are_exact(spark):
    rows = vectors(300, 6, 4, scale=2.0**17)
    assert run(spark, rows, band_rows=40) == brute(rows)
