"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text.  A text is parsed
against it from left to right into the longest pieces that the labelled text
holds somewhere; a text needs few pieces in its own language.  Pieces times the
bits of a pointer, over the length, estimate the cross entropy, and the
language with the least wins; among equals the one whose pieces are commoner,
then the first by code point.

Letters are lowered; each run of other characters is one separator.  Long texts
are parsed whole, in segments: all segments of a batch advance together, one
symbol at a time, as arrays.

The models are fitted on a bounded sample of labelled rows, ``sample_rows`` per
language of at most ``longest`` characters each, taken by the hash of doc_id,
and ``sample_chars`` characters of their texts, ``total_chars`` over all languages.
Everything else covers all rows.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text when nothing was learned; languages that are null are not
learned; repeated rows get equal results.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.common import arrow_rows, fold, narrow

UNDETERMINED = "und"
_SEGMENT = 256
# Symbols: 0 separates, letters of the samples by frequency, the rest share classes; the last is unknown.
_OWN, _CLASSES = 200, 254
_PIECES = 256


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    training: Column | None = None, sample_rows: int = 200, longest: int = 20_000, sample_chars: int = 60_000,
    total_chars: int = 600_000,
) -> dict[str, str]:
    """Labelled text per language, in a bounded sample; by default of rows whose fold is not 1."""
    rows = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col)
    chosen = fold(F.col("doc_id")) != 1 if training is None else training
    rows = rows.filter(chosen & F.col("lang").isNotNull() & F.length("text").between(1, longest))
    # Narrow rows are ranked, in two steps so that no task sees a language; texts follow for the chosen only.
    rows = rows.withColumn("at", F.xxhash64("doc_id")).withColumn("key", F.xxhash64("doc_id", "text"))
    size = rows.select("lang", "at", "key", F.length("text").alias("size"))
    piece = Window.partitionBy("lang", F.pmod("at", F.lit(_PIECES))).orderBy("at", "key")
    first = Window.partitionBy("lang").orderBy("at", "key")
    size = size.withColumn("n", F.row_number().over(piece)).filter(F.col("n") <= sample_rows)
    size = size.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample_rows)
    before = F.coalesce(F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = size.withColumn("before", before).filter(F.col("before") < sample_chars)
    sample = sample.groupBy("lang", "key").agg(F.min("n").alias("n"))
    # At most ``sample_rows`` rows a language; equal rows are one.
    chosen_rows = rows.select("lang", "key", "text").join(F.broadcast(sample), ["lang", "key"])
    chosen_rows = chosen_rows.groupBy("lang", "key", "n").agg(F.min("text").alias("text"))
    samples: dict[str, list[str]] = {}
    for row in sorted(chosen_rows.collect(), key=lambda r: (r.lang, r.n)):
        samples.setdefault(row.lang, []).append(row.text)
    # Many languages share what a worker may hold of automata.
    share = min(sample_chars, total_chars // max(len(samples), 1))
    for texts in samples.values():
        while len(texts) > 1 and sum(map(len, texts[:-1])) >= share:
            texts.pop()
    return {lang: "\n".join(texts) for lang, texts in samples.items()}


class Automaton:
    """A suffix automaton as a table of states by symbols; state 0 is the start and, as a target, none."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        moves: list[dict[int, int]] = [{}]
        link, length, count = [-1], [0], [0]
        last = 0
        for symbol in symbols.tolist():
            state = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(1)
            at = last
            while at >= 0 and symbol not in moves[at]:
                moves[at][symbol] = state
                at = link[at]
            if at >= 0:
                target = moves[at][symbol]
                if length[target] == length[at] + 1:
                    link[state] = target
                else:
                    copy = len(moves)
                    moves.append(dict(moves[target]))
                    length.append(length[at] + 1)
                    link.append(link[target])
                    count.append(0)
                    while at >= 0 and moves[at].get(symbol) == target:
                        moves[at][symbol] = copy
                        at = link[at]
                    link[target] = link[state] = copy
            last = state
        for state in sorted(range(1, len(moves)), key=length.__getitem__, reverse=True):
            count[max(link[state], 0)] += count[state]
        self.table = np.zeros((len(moves), alphabet), np.int32)
        for state, row in enumerate(moves):
            self.table[state, list(row)] = list(row.values())
        self.table = self.table.ravel()
        self.alphabet = alphabet
        self.bits = float(np.log2(len(symbols) + 2))
        self.rarity = (np.log2(len(symbols) + 2) - np.log2(np.maximum(count, 1))).astype(np.float32)

    def parse(self, columns: np.ndarray, active: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and their rarity per segment; row t of ``columns`` has symbol t of the first ``active[t]`` segments."""
        pieces = np.ones(columns.shape[1], np.int32)
        rarity = np.zeros(columns.shape[1], np.float32)
        state = np.zeros(columns.shape[1], np.int64)
        for t, m in enumerate(active):
            symbol = columns[t, :m]
            now = state[:m]
            next_state = self.table[now * self.alphabet + symbol]
            ended = np.flatnonzero(next_state == 0)
            if len(ended):
                rarity[ended] += self.rarity[now[ended]]
                begun = self.table[symbol[ended]]
                # A symbol that the language lacks is a piece of its own.
                pieces[ended] += (now[ended] > 0).astype(np.int32) + (begun == 0)
                next_state[ended] = begun
            state[:m] = next_state
        open_ = state > 0
        rarity[open_] += self.rarity[state[open_]]
        pieces -= ~open_
        return pieces, rarity


class Models:
    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.letters = np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), np.bool_)
        points = np.concatenate([_points(t) for _, t in samples] or [np.zeros(0, np.uint32)])
        seen, counts = np.unique(points[self.letters[points]], return_counts=True)
        seen = seen[np.lexsort((seen, -counts))]
        self.symbol = np.where(self.letters, 255, 0).astype(np.int64)
        self.symbol[seen[:_OWN]] = np.arange(1, len(seen[:_OWN]) + 1)
        self.symbol[seen[_OWN:]] = _OWN + 1 + seen[_OWN:] % (_CLASSES - _OWN)
        self.alphabet = int(self.symbol[seen].max()) + 2 if len(seen) else 2
        self.symbol[self.symbol == 255] = self.alphabet - 1
        self.symbol = self.symbol.astype(np.uint8)
        self.names = [name for name, _ in samples]
        self.automata = [Automaton(self.symbols(text), self.alphabet) for _, text in samples]

    def symbols(self, text: str) -> np.ndarray:
        found = self.symbol[_points(text)]
        return found[np.r_[True, (found[1:] != 0) | (found[:-1] != 0)]] if len(found) else found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        streams = [self.symbols(t) if t else np.zeros(0, np.uint8) for t in texts]
        rows = [i for i, s in enumerate(streams) if s.any()]
        if not rows or not self.names:
            return langs, scores
        owners, parts = [], []
        for i in rows:
            for start in range(0, len(streams[i]), _SEGMENT):
                owners.append(i)
                parts.append(streams[i][start : start + _SEGMENT])
        sizes = np.array([len(p) for p in parts])
        order = np.argsort(-sizes, kind="stable")
        columns = np.zeros((int(sizes.max()), len(parts)), np.uint8)
        for place, number in enumerate(order.tolist()):
            columns[: sizes[number], place] = parts[number]
        active = np.searchsorted(-sizes[order], -np.arange(len(columns)), side="left").tolist()
        owner = np.array(owners)[order]
        total = np.bincount(owner, sizes[order], len(texts))
        entropy, rare = np.zeros((len(self.names), len(texts))), np.zeros((len(self.names), len(texts)))
        for k, automaton in enumerate(self.automata):
            pieces, rarity = automaton.parse(columns, active)
            entropy[k] = np.bincount(owner, pieces, len(texts)) * automaton.bits / np.maximum(total, 1)
            rare[k] = np.bincount(owner, rarity, len(texts))
        for i in rows:
            ranked = sorted(range(len(self.names)), key=lambda k: (entropy[k, i], rare[k, i], self.names[k]))
            best = ranked[0]
            second = entropy[ranked[1], i] if len(ranked) > 1 else float("inf")
            langs[i] = self.names[best]
            scores[i] = float(min(max(1.0 - entropy[best, i] / second, 0.0), 1.0)) if second else 0.0
        return langs, scores


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


# One: a worker that serves several tables must not hold the automata of them all.
@lru_cache(maxsize=1)
def _models(key: str, samples: tuple[tuple[str, str], ...]) -> Models:
    return Models(samples)


def _shared(spark: SparkSession, samples: dict[str, str]):
    """(key, broadcast samples): each Python worker builds their automata once."""
    ordered = tuple(sorted(samples.items()))
    key = hashlib.sha256(repr(ordered).encode("utf-8", "surrogatepass")).hexdigest()
    return key, spark.sparkContext.broadcast(ordered)


def determined(docs: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is not ``und``; a filter without an exchange."""
    key, shared = _shared(docs.sparkSession, samples)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        langs: list[str] = []
        for start in range(0, len(texts), 1000):
            langs += _models(key, shared.value).predict(texts.iloc[start : start + 1000].tolist())[0]
        return pd.Series([lang != UNDETERMINED for lang in langs], dtype="boolean")

    return docs.filter(known(F.col(f"`{text_col}`").cast("string")))


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; one narrow stage."""
    key, shared = _shared(docs.sparkSession, samples)

    def make(ids: list, texts: list) -> list[list]:
        langs, scores = _models(key, shared.value).predict(texts)
        return [ids, langs, scores]

    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return arrow_rows(rows, make, "doc_id long, lang_pred string, score double", "doc_id", "text", rows=1000)
