"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Every text becomes counts and from them eight transformed statistics: logarithms of its
words, of their mean length and of the share of distinct ones, and square roots of the
shares of symbols, repeated lines, words in repeated three-word windows, characters of
words that are no letters, and capitals among the letters.  Per language and source the
mean and covariance of the half to three quarters of the texts with the smallest
covariance determinant are estimated; a text whose Mahalanobis distance from them is
beyond the chi-square cut is rejected.

The estimate is deterministic: distances start from medians and median absolute
deviations, once along the axes and once after spatial signs, and concentration steps
(mean and covariance of the nearest ``share`` of the rows) repeat until nothing moves.  Of
both starts the smaller determinant counts; one reweighting step follows.  Every step
covers all rows: one aggregate per (group, start, class of distance) with exact sums of
whole numbers, combined inside tasks before the exchange; then a few hundred such rows a
group decide where the nearest share ends (to a class, a sixteenth of a doubling of the
squared distance) and give the next mean and covariance.  So nothing depends on the order
of rows, a group with a third of all rows is split like any other, and no group is
collected.  Rows that fail the base rules take no part in estimates.

Covariances get the squares of the scale ``floors`` added to their diagonal: most texts
have no symbols and no repeats, and without floors a single one would be infinitely far.

Defined results: null and empty texts have no words and fail the base rules; null lang and
source count as empty strings; groups of fewer than ``least_rows`` estimated rows are
estimated together with the other small groups of their language; if those are still
fewer, the method rejects none of their rows; repeated rows get equal results; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import arrow_rows, narrow, written
from tagloom.operators.joins import lookup

# Names and scale floors of the statistics, in units of the transformed values.
FLOORS = {
    "words": 0.25, "word_length": 0.06, "distinct": 0.15, "symbols": 0.06,
    "repeated_lines": 0.15, "repeated_words": 0.15, "other_characters": 0.05, "capitals": 0.06,
}
D = len(FLOORS)
UNIT = 1024  # statistics are whole multiples of 1 / UNIT
SHARE = 0.75
TAIL = 1e-7
LEAST_ROWS = 80
STEPS = 12
_SYMBOLS = "#*$%&|<>"
_CAPITALS = bytes(range(0x41, 0x5B))
_LETTERS = bytes(range(0x61, 0x7B)) + _CAPITALS + bytes(range(0x80, 0x100))
_TRIANGLE = [(i, j) for i in range(D) for j in range(i + 1)]


def repeated_words(words: list[bytes], width: int = 3) -> tuple[int, int]:
    """Words inside windows of ``width`` words that occur twice or more, and distinct words."""
    names: dict[bytes, int] = {}
    codes = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    n = len(words) - width + 1
    if n < 2 or len(names) == len(words):
        return 0, len(names)
    windows = codes[:n]
    for i in range(1, width):
        # Renumbered on the way, so that products stay small for any vocabulary.
        windows = np.unique(windows * len(names) + codes[i : i + n], return_inverse=True)[1]
    again = np.bincount(windows)[windows] > 1
    inside = np.zeros(len(words), bool)
    for i in range(width):
        inside[i : i + n] |= again
    return int(inside.sum()), len(names)


def counts_of(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then lines, distinct words, other characters, letters, capitals."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    held = b"".join(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats, distinct = repeated_words(words)
    letters = len(held) - len(held.translate(None, _LETTERS))
    capitals = len(held) - len(held.translate(None, _CAPITALS))
    return (
        len(words), len(text) - (len(data) - len(held)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)),
        repeats, len(lines), distinct, len(held) - letters, letters, capitals,
    )


def transformed(counts: tuple[int, ...]) -> list[int]:
    """The eight statistics, in the order of FLOORS, as multiples of 1 / UNIT."""
    n, chars, symbols, dup, repeats, lines, distinct, other, letters, capitals = counts
    if not n:
        return [0] * D
    values = (
        math.log(n), math.log(chars / n), math.log(distinct / n), math.sqrt(symbols / chars), math.sqrt(dup / max(lines, 1)),
        math.sqrt(repeats / n), math.sqrt(other / (other + letters)), math.sqrt(capitals / max(letters, 1)),
    )
    return [round(v * UNIT) for v in values]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_words: int = 50, most_repeats: int = 50,
) -> DataFrame:
    """Counts and transformed statistics ``x`` of every whole text, with ``base_failed``."""
    rows = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col)
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]

    def make(ids: list, langs: list, sources: list, texts: list) -> list[list]:
        found = [counts_of(t) for t in texts]
        return [ids, langs, sources, *[list(c) for c in zip(*[f[: len(BASE)] for f in found])], [transformed(f) for f in found]]

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in BASE) + ", x array<int>"
    found = arrow_rows(rows.select(F.col("doc_id").cast("long").alias("doc_id"), *texts), make, schema, "doc_id", "lang", "source", "text", rows=200)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def chi_square_tail(x: float, d: int) -> float:
    """P(chi-square of ``d`` degrees, an even number, > x)."""
    term, total = 1.0, 1.0
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return math.exp(-x / 2) * total


def chi_square_cut(tail: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(middle, d) > tail else (low, middle)
    return high


def consistency(share: float, d: int) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal rows that of all."""
    return share / (1 - chi_square_tail(chi_square_cut(1 - share, d), d + 2))


def _medians(bins: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Lower weighted medians of (keys, value, n) rows: counts of whole values are few per group."""
    upto = Window.partitionBy(*keys).orderBy(value)
    ranked = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return ranked.filter(2 * F.col("upto") >= F.col("all")).groupBy(*keys).agg(F.min(value).alias("median"))


def starting_points(rows: DataFrame) -> DataFrame:
    """(key, middle, spread) of ``rows(key, x)``: medians and scaled absolute deviations with floors, from counted values."""
    bins = rows.select("key", F.posexplode("x").alias("i", "v")).groupBy("key", "i", "v").agg(F.count(F.lit(1)).alias("n"))
    bins = written(bins, "values")
    middle = _medians(bins, "v", ["key", "i"])
    away = bins.join(middle, ["key", "i"]).select("key", "i", F.abs(F.col("v") - F.col("median")).alias("v"), "n")
    away = away.groupBy("key", "i", "v").agg(F.sum("n").alias("n"))
    spread = _medians(away, "v", ["key", "i"]).withColumnRenamed("median", "away")
    floors = F.array(*[F.lit(f * UNIT) for f in FLOORS.values()])
    floor = F.get(floors, F.col("i"))
    both = middle.join(spread, ["key", "i"]).select(
        "key", F.struct("i", "median", F.greatest(1.4826 * F.col("away"), floor).alias("spread")).alias("s")
    )
    listed = both.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return listed.select("key", F.col("s.median").alias("middle"), F.col("s.spread").alias("spread"))


# An estimate: whole-number offset, mean above it, inverse Cholesky factor (rows of the lower triangle), log determinant.
ESTIMATE = "middle array<int>, mean array<double>, factor array<double>, logdet double"


def _squared_distance(x: Column, middle: Column, mean: Column, factor: Column) -> Column:
    away = [F.get(x, F.lit(i)) - F.get(middle, F.lit(i)) - F.get(mean, F.lit(i)) for i in range(D)]
    total, at = F.lit(0.0), 0
    for i in range(D):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + F.get(factor, F.lit(at)) * away[j]
            at += 1
        total = total + row * row
    return total


def _class(squared: Column) -> Column:
    return F.floor(16 * F.log2(F.least(F.greatest(squared, F.lit(2.0**-10)), F.lit(2.0**40)))).cast("int")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, sums and sums of products of the offsets ``o``, whole numbers."""
    o = [F.get("o", F.lit(i)).cast("long") for i in range(D)]
    first = [F.sum(c).alias(f"s{i}") for i, c in enumerate(o)]
    second = [F.sum(o[i] * o[j]).alias(f"p{i}_{j}") for i, j in _TRIANGLE]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *first, *second)


def estimate(sums: pd.DataFrame, factor: float) -> tuple[list[float], list[float], float]:
    """Mean, inverse Cholesky factor and log determinant from summed rows; ``factor`` scales the covariance."""
    n = int(sums["n"].sum())
    s = [int(sums[f"s{i}"].sum()) for i in range(D)]
    mean = np.array([v / n for v in s])
    cov = np.zeros((D, D))
    for i, j in _TRIANGLE:
        # Exact in whole numbers; one rounding at the end.
        cov[i, j] = cov[j, i] = (n * int(sums[f"p{i}_{j}"].sum()) - s[i] * s[j]) / (n * n)
    cov = cov * factor + np.diag([(f * UNIT) ** 2 for f in FLOORS.values()])
    lower = np.linalg.cholesky(cov)
    inverse = np.linalg.solve(lower, np.eye(D))
    return mean.tolist(), [float(inverse[i, j]) for i, j in _TRIANGLE], float(2 * np.log(np.diag(lower)).sum())


def _step(rows: DataFrame, estimates: DataFrame, name: str, share: float, cut: float | None) -> DataFrame:
    """The next estimates per key (and start): from the nearest share of the rows, or from those within ``cut``."""
    listed = estimates.groupBy("key").agg(F.first("middle").alias("middle"), F.collect_list(F.struct("start", "mean", "factor")).alias("e"))
    met = lookup(rows, listed, "key", "inner").select("key", "x", "middle", F.explode("e").alias("e"))
    squared = _squared_distance(F.col("x"), F.col("middle"), F.col("e.mean"), F.col("e.factor"))
    offsets = F.array(*[F.get("x", F.lit(i)) - F.get("middle", F.lit(i)) for i in range(D)])
    near = met.select("key", F.col("e.start").alias("start"), "middle", offsets.alias("o"), squared.alias("squared"))
    if cut is not None:
        near = near.filter(F.col("squared") <= cut)
        classed = _sums(near.withColumn("class", F.lit(0)), "key", "start", "middle", "class")
    else:
        classed = _sums(near.withColumn("class", _class(F.col("squared"))), "key", "start", "middle", "class")
    factor = consistency(share, D)

    def advance(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("class")
        upto = group["n"].cumsum()
        # Up to the class in which the share is reached.
        used = group[(upto - group["n"]) < share * upto.iloc[-1]] if cut is None else group
        mean, inverse, logdet = estimate(used, factor)
        first = group.iloc[0]
        return pd.DataFrame(
            [(first["key"], first["start"], first["middle"], mean, inverse, logdet)],
            columns=["key", "start", "middle", "mean", "factor", "logdet"],
        )

    new = classed.groupBy("key", "start").applyInPandas(advance, f"key string, start int, {ESTIMATE}")
    return written(new, name)


def fit(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """(key, middle, mean, factor, logdet) of ``rows(key, x)``, one row per key."""
    points = written(starting_points(rows), "starts")
    zero = F.array(*[F.lit(0.0)] * D)
    inverse = [F.lit(0.0) if i != j else 1 / F.get("spread", F.lit(i)) for i, j in _TRIANGLE]
    axes = points.select("key", F.lit(0).alias("start"), "middle", zero.alias("mean"), F.array(*inverse).alias("factor"))
    # Spatial signs: every row, scaled by the spreads, at length one.
    met = lookup(rows, points, "key", "inner")
    z = [(F.get("x", F.lit(i)) - F.get("middle", F.lit(i))) / F.get("spread", F.lit(i)) for i in range(D)]
    length = F.sqrt(sum((c * c for c in z[1:]), z[0] * z[0]))
    o = [F.round(F.coalesce(F.try_divide(c, length), F.lit(0.0)) * UNIT * UNIT).cast("long") for c in z]
    signs = _sums(met.select("key", "middle", "spread", F.array(*o).alias("o")), "key", "middle", "spread")

    def sign_scatter(groups):
        for group in groups:
            out = []
            for row in group.to_dict("records"):
                scatter = np.zeros((D, D))
                for i, j in _TRIANGLE:
                    scatter[i, j] = scatter[j, i] = row[f"p{i}_{j}"] / row["n"] / UNIT**4 * D
                spread = np.array(row["spread"])
                # Shares along the axes say how rows spread; floors keep the matrix regular.
                scatter = scatter * np.outer(spread, spread) + np.diag([(f * UNIT) ** 2 for f in FLOORS.values()])
                inverse = np.linalg.solve(np.linalg.cholesky(scatter), np.eye(D))
                out.append((row["key"], 1, list(row["middle"]), [0.0] * D, [float(inverse[i, j]) for i, j in _TRIANGLE]))
            yield pd.DataFrame(out, columns=["key", "start", "middle", "mean", "factor"])

    signed = signs.mapInPandas(sign_scatter, "key string, start int, middle array<int>, mean array<double>, factor array<double>")
    now = written(axes.unionByName(signed).withColumn("logdet", F.lit(math.inf)), "estimates")
    for _ in range(steps):
        new = _step(rows, now, "estimates", share, None)
        moved = new.join(now.select("key", "start", F.col("logdet").alias("before")), ["key", "start"])
        still = moved.filter(F.abs(F.col("logdet") - F.col("before")) > 1e-9).isEmpty()
        now = new
        if still:
            break
    best = now.groupBy("key").agg(F.min(F.struct("logdet", "start", "middle", "mean", "factor")).alias("b")).select("key", "b.*")
    reweighted = _step(rows, best, "reweighted", 0.975, chi_square_cut(0.025, D))
    # A group with nothing inside the cut keeps its raw estimate.
    raw = best.join(reweighted.select("key"), "key", "left_anti")
    return reweighted.unionByName(raw.select(*reweighted.columns)).drop("start")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    share: float = SHARE, tail: float = TAIL, least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """doc_id, the base counts, base_failed, squared_distance (null without an estimate) and kept, one row per document."""
    table = written(statistics(docs, id_col, text_col, lang_col, source_col), "statistics")
    usable = table.filter(~F.col("base_failed"))
    sizes = usable.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    # JSON keeps language and source apart in one key; small groups share their language's.
    own = F.when(F.col("n") >= least_rows, F.to_json(F.array("lang", "source"))).otherwise(F.to_json(F.array("lang")))
    keys = sizes.select(F.to_json(F.array("lang", "source")).alias("group"), own.alias("key"), "n")
    enough = keys.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_rows).select("key", F.lit(True).alias("ok"))
    keys = written(keys.join(enough, "key", "left").select("group", F.when(F.col("ok"), F.col("key")).alias("key")), "keys")
    keyed = lookup(table.withColumn("group", F.to_json(F.array("lang", "source"))), keys, "group", "left")
    keyed = written(keyed.drop("group", "lang", "source"), "keyed")
    fitted = fit(keyed.filter(F.col("key").isNotNull() & ~F.col("base_failed")).select("key", "x"), share)
    met = lookup(keyed, fitted.select("key", "middle", "mean", "factor"), "key", "left")
    squared = _squared_distance(F.col("x"), F.col("middle"), F.col("mean"), F.col("factor"))
    scored = met.select("doc_id", *BASE, "base_failed", squared.alias("squared_distance"))
    far = F.coalesce(F.col("squared_distance") > chi_square_cut(tail, D), F.lit(False))
    return scored.withColumn("kept", ~F.col("base_failed") & ~far)
