"""How far the word frequencies of sources of one language lie apart, from run-length columns.

Per language the vocabulary holds the terms of at least ``least_docs`` documents; a group
(language, source) has a column of counts over it.  Most columns hold long stretches of
equal counts once terms with equal counts everywhere stand together, so terms are grouped
by their counts in all sources first (a row per distinct combination, with the number of
its terms as run length).  These rows are dealt into blocks by hash.  Inside a block they
are ordered column by column, columns with few distinct counts first, and every column is
run-length encoded.  For a pair of sources the boundaries of both are merged, and
``f(p, q)`` is computed once per merged run and multiplied by its length.  Sums over
blocks do not depend on how terms were dealt.

A block holds at most about ``block_cells`` counts (combinations times sources), whatever
the vocabulary, so no task sees a whole language.  Counting combines inside tasks before
the exchange.  The result has a row per pair of sources of a language: their number is the
size of the output, and an array per term is bounded by the number of sources.

With ``c`` occurrences of a term, ``N`` the sum over kept terms and ``V`` their number,
``p = 1 + floor(scale * (c + 2) / (N + 2 V))`` and ``f = floor((p - q)^2 / (p + q))``, all
in whole numbers (decimals of 38 digits, then 64 bits).

Defined results: null text, lang and source count as empty strings; documents without
terms still make their group occur; a language without kept terms gives 0 for every pair
and no terms; a single source gives no pairs; repeated rows count as often as they occur;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import narrow, written
from tagloom.operators.joins import lookup

SCALE = 1_000_000_000
LEAST_DOCS = 10
TOP_TERMS = 10
BLOCK_CELLS = 1 << 17
# Bytes of terms: letters, lowered, and all bytes of other characters; the rest separates.
_LETTERS = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_HELD = 200_000


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def term_counts(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of ``rows(lang, source, text)``; combined inside tasks, some rows per cell remain."""
    schema = "lang string, source string, term string, n long, docs long"
    arrow = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def flush(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            found = list(n)
            for at in range(0, len(found), 50_000):
                part = found[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64()),
                    ],
                    schema=arrow,
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                for lang, source, text in zip(*[c.to_pylist() for c in part.columns]):
                    words = terms(text)
                    if words:
                        n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                        n.update(words)
                        docs.update(set(words))
                if sum(len(n) for n, _ in held.values()) > _HELD:
                    yield from flush(held)
                    held = {}
        yield from flush(held)
        pa.default_memory_pool().release_unused()

    return rows.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(count, schema)


def _share(n: str, total: str) -> str:
    """p as SQL: decimals of up to 30 digits hold every step."""
    above = f"cast({n} + 2 as decimal(20,0)) * cast({SCALE} as decimal(10,0))"
    return f"1 + {above} div cast({total} + 2 * size as decimal(20,0))"


def run_lengths(column: np.ndarray) -> np.ndarray:
    """Places where a run of equal counts starts."""
    return np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])


def _shares(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    wide = len(counts) and int(counts.max()) + 2 > (1 << 63) // SCALE
    whole = counts.astype(object) if wide else counts
    return np.asarray(1 + SCALE * (whole + 2) // (total + 2 * size), np.int64)


def pair_sums(counts: np.ndarray, lengths: np.ndarray, totals: list[int], size: int) -> np.ndarray:
    """Sums of f for all pairs of rows of ``counts``; column ``j`` stands for ``lengths[j]`` terms."""
    n = len(counts)
    sums = np.zeros((n, n), np.int64)
    if not len(lengths):
        return sums
    variety = [len(np.unique(row)) for row in counts]
    # The last key sorts first: the columns with the fewest distinct counts get the longest runs.
    order = np.lexsort([counts[i] for i in sorted(range(n), key=lambda i: -variety[i])])
    ends = np.concatenate([[0], np.cumsum(lengths[order])])
    starts, shares = [], []
    for row, total in zip(counts, totals):
        column = row[order]
        starts.append(run_lengths(column))
        shares.append(_shares(column[starts[-1]], total, size))
    for a in range(n):
        for b in range(a):
            cuts = np.union1d(starts[a], starts[b])
            p = shares[a][np.searchsorted(starts[a], cuts, "right") - 1]
            q = shares[b][np.searchsorted(starts[b], cuts, "right") - 1]
            sizes = np.diff(ends[np.append(cuts, len(lengths))])
            sums[a, b] = sums[b, a] = int(((p - q) ** 2 // (p + q) * sizes).sum())
    return sums


def _block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pair sums of one block: ``left`` combinations, ``right`` the language's groups."""
    order = np.argsort(np.array(right["source"].to_pylist(), object), kind="stable") if right.num_rows else []
    right = right.take(pa.array(order, pa.int64()))
    sources = right["source"].to_pylist()
    lists = left["counts"].combine_chunks()
    flat = lists.flatten()
    places = np.repeat(np.arange(left.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    counts = np.zeros((len(sources), left.num_rows), np.int64)
    if len(flat):
        which = pc.index_in(flat.field("source"), value_set=pa.array(sources, pa.string())).to_numpy(zero_copy_only=False)
        counts[which, places] = flat.field("n").to_numpy(zero_copy_only=False)
    sums = pair_sums(counts, left["terms"].to_numpy(), right["total"].to_pylist(), right["size"][0].as_py() if sources else 0)
    pairs = [(a, b) for a in range(len(sources)) for b in range(len(sources)) if a != b]
    return pa.table(
        {
            "lang": pa.array([right["lang"][0].as_py()] * len(pairs), pa.string()),
            "source": pa.array([sources[a] for a, _ in pairs], pa.string()),
            "item": pa.array([sources[b] for _, b in pairs], pa.string()),
            "value": pa.array([int(sums[a, b]) for a, b in pairs], pa.int64()),
        }
    )


def vocabulary(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, n, counts) of the kept terms; ``counts`` lists (source, n) by source.  One exchange."""
    cells = term_counts(rows).repartition("lang", "term").groupBy("lang", "source", "term")
    cells = cells.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = cells.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"),
    )
    return kept.filter(F.col("docs") >= least_docs).select("lang", "term", "n", "counts")


def divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance to every other source, and the terms that stand out most."""
    rows = narrow(docs, lang=lang_col, source=source_col, text=text_col)
    rows = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    words = written(vocabulary(rows, least_docs), "vocabulary")
    cells = words.select("lang", "term", F.col("n").alias("lang_n"), F.explode("counts").alias("c"))
    cells = cells.select("lang", "term", "lang_n", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    sizes = words.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("lang_total"))
    groups = rows.select("lang", "source").distinct()
    totals = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    totals = totals.join(sizes, "lang", "left").fillna(0, ["total", "size", "lang_total"])
    totals = written(totals, "totals")
    # Enough blocks for combinations times sources, at least one per language.
    blocks = totals.groupBy("lang").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("sources"))
    blocks = blocks.select("lang", F.expr(f"1 + size * sources div {block_cells}").alias("blocks"))

    combinations = words.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("terms"))
    left = lookup(combinations, blocks, "lang", "inner")
    left = left.select("lang", F.expr("pmod(xxhash64(counts), blocks)").alias("block"), "counts", "terms")
    right = lookup(totals, blocks, "lang", "inner")
    right = right.select("lang", "source", "total", "size", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    sums = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(
        _block, "lang string, source string, item string, value long"
    )
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    # The tag makes the planner exchange both sides, so that AQE can split a hot group.
    tag = F.xxhash64("lang", "source").alias("tag")
    shares = cells.select("*", tag).join(totals.select("*", tag), ["lang", "source", "tag"])
    shares = shares.selectExpr("lang", "source", "term", f"{_share('n', 'total')} as p", f"{_share('lang_n', 'lang_total')} as q")
    apart = shares.filter("p > q").selectExpr("lang", "source", "term as item", "(p - q) * (p - q) div (p + q) as value")
    # Ranks up to a limit are cut inside tasks before the exchange.
    apart = apart.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms)

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    return part(pairs, "pair").unionByName(part(apart, "term"))
