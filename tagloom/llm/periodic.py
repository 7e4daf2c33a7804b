"""Periodic runs of words, by online dyadic square catching.

Words are appended from left to right.  Every aligned block of ``2**k`` words becomes a
catcher once it is complete: the catcher looks for its block again at a distance ``p``
that belongs to level ``k``, which is from ``2 * size - 1`` on, so that the first half
of every square with half length ``p`` holds a whole block of that level.  When the
last appended words equal the block, a comparison of the suffix with itself ``p`` words
earlier is opened: it is followed to the left as far as it holds, and to the right with
every appended word.  From ``2 * p`` words on it is a square; squares at successive
places are one comparison, which is reported as a run when a word breaks it.  A catch
that an open comparison covers, whose period divides ``p``, is no new square.  So only
smallest periods are reported, and a text of ``n`` words costs about ``n log n``.

Blocks are told apart by hashes, and every catch is compared word by word afterwards:
the result is exact.  A text is one row of one task, held as whole numbers while it is
searched (a few dozen bytes a word); nothing is shuffled.

Defined results: null, empty and white-space texts have no words and no runs; repeated
rows get equal results; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import arrow_rows, narrow

Run = tuple[int, int, int]  # start, length, smallest period
SHORTEST = 12
CHUNK = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_ONES = np.uint64


def _agreement(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the common prefix, compared in growing pieces."""
    most, at, step = min(len(left), len(right)), 0, 16
    while at < most:
        differs = left[at : min(at + step, most)] != right[at : min(at + step, most)]
        first = int(differs.argmax())
        if differs[first]:
            return at + first
        at, step = at + step, step * 4
    return most


class SquareCatcher:
    """The runs of one sequence of words, at least ``shortest`` and two periods long."""

    def __init__(self, shortest: int = SHORTEST):
        if shortest < 12:
            raise ValueError("level 1 catches every short period only from 12 words on")
        self.shortest = shortest
        self._names: dict[bytes, int] = {}
        self._words = np.zeros(0, np.int64)
        # Sums of word hashes times powers of the base: a window's hash is a difference.
        self._sums = np.zeros(1, np.uint64)
        self._live: list[tuple[int, int, int]] = []  # start, end, period
        self._runs: set[Run] = set()

    def append(self, words: Iterable[bytes]) -> None:
        """Append words; all comparisons and catchers advance over them."""
        names = self._names
        new = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
        low = len(self._words)
        self._words = np.concatenate([self._words, new])
        high = len(self._words)
        if high == low:
            return
        self._extend_sums(new)
        followed = []
        for start, end, period in self._live:
            end += _agreement(self._words[low:], self._words[low - period :])
            followed.append((start, end, period))
            if end < high:
                self._close(start, end, period)
        self._live = [c for c in followed if c[1] == high]
        self._advance(low, high, followed)

    def finish(self) -> list[Run]:
        for comparison in self._live:
            self._close(*comparison)
        self._live = []
        return sorted(self._runs, key=lambda r: (r[0], r[2]))

    def _extend_sums(self, new: np.ndarray) -> None:
        done = len(self._sums) - 1
        with np.errstate(over="ignore"):
            powers = np.full(len(new), _BASE, np.uint64)
            powers[0] = pow(_BASE, done, 1 << 64)
            hashes = (new.astype(np.uint64) + _ONES(1)) * _ONES(0xD1B54A32D192ED03)
            hashes ^= hashes >> _ONES(29)
            sums = np.cumsum(hashes * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64) + self._sums[-1]
        self._sums = np.concatenate([self._sums, sums])

    def _close(self, start: int, end: int, period: int) -> None:
        if end - start >= max(self.shortest, 2 * period):
            self._runs.add((start, end - start, period))

    def _catches(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last word, block, distance) of every window that ends in ``[low, high)`` and equals a waiting block."""
        found = []
        size = 2
        while 3 * size - 1 <= high or size == 2:
            least, beyond = (1 if size == 2 else 2 * size - 1), 4 * size - 1
            first = max(0, low - size + 1 - beyond)  # the earliest block that still waits
            first -= first % size
            starts = np.arange(max(low - size + 1, 0), high - size + 1)
            if not len(starts):
                break
            # Window hashes from ``first`` on, brought to one power of the base.
            inverse = pow(_BASE, -1, 1 << 64)
            count = high - size + 1 - first
            powers = np.full(count, inverse, np.uint64)
            powers[0] = 1
            with np.errstate(over="ignore"):
                hashes = (self._sums[first + size : high + 1] - self._sums[first : high - size + 1]) * np.cumprod(powers, dtype=np.uint64)
            mine = hashes[starts - first]
            latest = (starts - least) // size * size
            for back in range(3 if size == 2 else 2):
                block = latest - back * size
                waits = (block >= 0) & (starts - block < beyond)
                at, place = starts[waits], block[waits]
                equal = mine[waits] == hashes[place - first]
                at, place = at[equal], place[equal]
                found.append((at + size - 1, place, at - place))
            size *= 2
        if not found:
            return (np.zeros(0, np.int64),) * 3
        last, block, distance = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((distance, last))
        return last[order], block[order], distance[order]

    def _advance(self, low: int, high: int, followed: list[tuple[int, int, int]]) -> None:
        words = self._words
        last, block, distance = self._catches(low, high)
        covered = np.zeros(len(last), bool)

        def cover(at: int, start: int, end: int, period: int) -> None:
            """Catches from ``at`` on inside a comparison whose period divides their distance are no new squares."""
            inside = slice(at, at + int(np.searchsorted(last[at:], end)))
            covered[inside] |= (block[inside] >= start) & (distance[inside] % period == 0)

        for comparison in followed:
            cover(0, *comparison)
        at = 0
        while at < len(last):
            if covered[at]:
                # On to the next catch that no comparison covers.
                at += max(1, int(covered[at:].argmin())) if not covered[at:].all() else len(last)
                continue
            b, p = int(block[at]), int(distance[at])
            right = _agreement(words[b + p :], words[b:])
            left = _agreement(words[:b][::-1], words[: b + p][::-1]) if right else 0
            start, end = b - left, b + p + right
            if end > int(last[at]):
                cover(at, start, end, p)
                if end == high:
                    self._live.append((start, end, p))
                else:
                    self._close(start, end, p)
            at += 1


def runs_of(words: list[bytes], shortest: int = SHORTEST, chunk: int = CHUNK) -> list[Run]:
    """Maximal stretches with a smallest period, by start and period."""
    if len(words) < shortest:
        return []
    if len(words) <= chunk:
        # A run repeats a window of six words: most texts hold none and need no catchers.
        seen = set(zip(*[words[i:] for i in range(6)]))
        if len(seen) == len(words) - 5:
            return []
    catcher = SquareCatcher(shortest)
    for low in range(0, len(words), chunk):
        catcher.append(words[low : low + chunk])
    return catcher.finish()


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, of every run only its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every text; words end at ASCII white space."""

    def make(ids: list, texts: list) -> list[list]:
        sizes, found, short = [], [], []
        for text in texts:
            # On bytes, white space is exactly that of ASCII.
            words = (text or b"").split()
            runs = runs_of(words, shortest)
            sizes.append(len(words))
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            short.append(collapsed(words, runs).decode("utf-8", "replace"))
        return [ids, sizes, found, short]

    rows = narrow(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return arrow_rows(rows, make, f"doc_id long, n_words long, runs {RUNS}, collapsed string", "doc_id", "text", rows=100)
