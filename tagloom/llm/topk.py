"""Exact top-k by inner product, norms in descending order.

Components become floor(1024 * x).  Vectors are range-partitioned by descending
norm into bands of bounded size, ties spread by the hash of their id.  A query
visits bands in that order and only while |q| * (largest norm of the band) can
still reach its k-th best score.  Inside a band, vectors and queries are rotated
by the singular vectors of all vectors (eigenvectors of the Gram matrix), so the
first coordinates carry most of a product; the partial sum over them plus the
product of the residual norms (Cauchy-Schwarz) bounds every score, and only
pairs whose bound reaches the k-th best are computed, in whole numbers.

Queries go in chunks of bounded size; a task sees one band and one chunk.  The
stated query set meets all vectors in these blocks: no join emits pairs.

Scores are 64-bit integers, so products of norms must stay below 2**63.

Defined results: vectors that are null or hold a null or non-finite component,
and rows with a null id, take no part; a shorter vector counts as filled with
zeros; ties go to the smaller id; rows that repeat an id are separate candidates
but never candidates of their own id, and a query that repeats counts once, with
its smallest vector.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import narrow, written

_EXACT = 2.0**53
_BLOCK = 1024
_GATHER = 1 << 15
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    rows = narrow(table, vec_id=id_col, vector=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    value = lambda x: x.cast("double")
    bad = lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x)) == float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad))
    whole = rows.select("vec_id", F.transform("vector", lambda x: F.floor(value(x) * scale).cast("long")).alias("ints"))
    square = F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return whole.withColumn("norm", F.sqrt(square))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for row, values in zip(out, column):
        row[: len(values)] = values
    return out


def gram_matrix(vectors: DataFrame, dims: int) -> np.ndarray:
    """Sum of outer products: dims rows of dims numbers, whatever the number of vectors."""

    def partial(batches):
        total = np.zeros((dims, dims))
        for frame in batches:
            x = _matrix(frame["ints"], dims).astype(np.float64)
            total += x.T @ x
        yield pd.DataFrame({"row": np.arange(dims), "values": list(total)})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": frame["row"].iloc[:1], "values": [np.sum(np.stack(list(frame["values"])), axis=0)]})

    schema = "row int, values array<double>"
    rows = vectors.select("ints").mapInPandas(partial, schema).groupBy("row").applyInPandas(add, schema).collect()
    return np.array([r["values"] for r in sorted(rows, key=lambda r: r.row)])


def rotation(gram: np.ndarray, energy: float) -> tuple[np.ndarray, int]:
    """Singular vectors by descending weight, and how many leading ones hold ``energy`` of all."""
    values, basis = np.linalg.eigh(gram)
    values, basis = np.maximum(values[::-1], 0), basis[:, ::-1]
    held = np.cumsum(values) / max(values.sum(), 1e-300)
    return np.ascontiguousarray(basis), int(min(np.searchsorted(held, energy) + 1, len(values)))


class _Best:
    """The k best (score, id) of each query seen so far."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.query, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        score, vec = np.concatenate([self.score, score]), np.concatenate([self.vec, vec])
        order = np.lexsort((vec, -score, query))
        query, score, vec = query[order], score[order], vec[order]
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        kth = place == self.k - 1
        np.maximum.at(self.least, query[kth], score[kth].astype(np.float64))
        stay = place < self.k
        self.query, self.score, self.vec = query[stay], score[stay], vec[stay]


def search_band(
    ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray,
    basis: np.ndarray, head: int, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of the k best of one band for every query, dropping scores below ``least``."""
    fx, fq = x.astype(np.float64), q.astype(np.float64)
    xn, qn = np.linalg.norm(fx, axis=1), np.linalg.norm(fq, axis=1)
    order = np.argsort(-xn, kind="stable")
    ids, x, fx, xn = ids[order], x[order], fx[order], xn[order]
    exact_floats = qn.max(initial=0) * xn.max(initial=0) < _EXACT / 4
    hx, hq = fx @ basis[:, :head], fq @ basis[:, :head]
    rest = lambda n, h: np.sqrt(np.maximum(n**2 - (h**2).sum(1), 0) + 1e-9 * n**2)
    rx, rq = rest(xn, hx), rest(qn, hq)
    best = _Best(len(q), k, least)
    for start in range(0, len(ids), _BLOCK):
        part = slice(start, start + _BLOCK)
        slack = 1e-9 * qn * xn[start] + 1e-3
        live = np.flatnonzero(qn * xn[start] + slack >= best.least)
        if not len(live):
            break
        bound = hq[live] @ hx[part].T + np.outer(rq[live], rx[part])
        wanted = bound + slack[live, None] >= best.least[live, None]
        wanted &= ids[part][None, :] != query_ids[live, None]
        a, b = np.nonzero(wanted)
        if not len(a):
            continue
        if exact_floats and len(a) > wanted.size // 16:
            # Whole numbers below 2**53: float products and sums are exact in any order.
            score = (fq[live] @ fx[part].T)[a, b].astype(np.int64)
        else:
            score = np.concatenate([
                np.einsum("ij,ij->i", q[live[a[i : i + _GATHER]]], x[part][b[i : i + _GATHER]])
                for i in range(0, len(a), _GATHER)
            ])
        reach = score >= best.least[live[a]]
        best.add(live[a[reach]], score[reach], ids[part][b[reach]])
    return best.query, best.vec, best.score


def top_k(
    table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 1024, band_rows: int = 16_384, chunk_rows: int = 8_192, energy: float = 0.8,
) -> DataFrame:
    """query_id, rank, vec_id, score for every row that ``is_query`` (an expression of ``vec_id``) selects."""
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    total = table.count()
    bands = min(max(math.ceil(total / band_rows), min(16, math.ceil(total / 512)), 1), 65_536)
    vectors = integer_vectors(table, id_col, vector_col, scale)
    sorted_ = vectors.repartitionByRange(bands, F.desc("norm"), F.xxhash64("vec_id")).withColumn("band", F.spark_partition_id())
    vectors = written(sorted_, "norm-bands")
    # One number per band; bands are at most 65,536.
    tops = [(r.band, r.top, r.dims) for r in vectors.groupBy("band").agg(F.max("norm").alias("top"), F.max(F.size("ints")).alias("dims")).collect()]
    if not tops or not (dims := max(t[2] for t in tops)):
        if not tops:
            return empty
        dims = 1
    tops.sort(key=lambda t: -t[1])
    place = {band: i for i, (band, _, _) in enumerate(tops)}
    order, top = [t[0] for t in tops], np.array([t[1] for t in tops])
    basis, head = rotation(gram_matrix(vectors, dims), energy)

    queries = vectors.filter(is_query).groupBy("vec_id").agg(F.min("ints").alias("ints")).withColumnRenamed("vec_id", "query_id")
    chunks = max(1, math.ceil(queries.count() / chunk_rows))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))

    def kernel(key, left: pd.DataFrame, right: pd.DataFrame) -> tuple | None:
        if not len(left) or not len(right):
            return None
        return search_band(
            left["vec_id"].to_numpy(np.int64), _matrix(left["ints"], dims), right["query_id"].to_numpy(np.int64),
            _matrix(right["ints"], dims), right["least"].to_numpy(np.float64), basis, head, k,
        )

    def scan(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = kernel(key, left, right)
        if found is None:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[found[0]], "vec_id": found[1], "score": found[2]})

    def pairs(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        # Vectors go only where a query visits their band: at most bands times chunks narrow rows say so.
        visited = wanted.select(F.col("band").alias("seen"), F.col("chunk").alias("by")).distinct()
        spread = rows.join(visited, F.col("band") == F.col("seen")).select("band", F.col("by").alias("chunk"), "vec_id", "ints")
        return spread.groupBy("band", "chunk").cogroup(wanted.groupBy("band", "chunk")).applyInPandas(scan, FOUND)

    first = queries.select(F.lit(order[0]).alias("band"), "chunk", "query_id", "ints", F.lit(float("-inf")).alias("least"))
    seeds = written(pairs(vectors.filter(F.col("band") == order[0]), first), "seeds")
    kth = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    kth = kth.filter(F.col("n") >= k).select("query_id", F.col("kth").cast("double").alias("least"))

    @F.pandas_udf("array<int>")
    def bands_of(norm: pd.Series, least: pd.Series) -> pd.Series:
        """The bands after the first, in order, while their largest norm can reach ``least``."""
        reach = [np.searchsorted(-top * n, -(t - 1e-6 * abs(t) - 1), side="right") for n, t in zip(norm, least)]
        return pd.Series([order[1:r] for r in reach])

    square = F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    later = (
        queries.join(kth, "query_id", "left").fillna(float("-inf"), ["least"])
        .withColumn("band", F.explode(bands_of(F.sqrt(square), F.col("least"))))
        .select("band", "chunk", "query_id", "ints", "least")
    )
    rest = pairs(vectors.filter(F.col("band") != order[0]), later) if len(place) > 1 else seeds.limit(0)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        seeds.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
