"""Near-duplicate passages by compact windows.

A text is its sequence of word shingles.  For each of several hashes, the
Cartesian tree over the hashed shingles splits the sequence into compact
windows (left, least, right): every passage between left and right that holds
the place of the least value has that value as its min-hash.  Only nodes at
least as wide as the shortest passage matter; they are the places that are least
in some window of that width, so the tree is built over these few alone.

Texts that hold windows of equal hash and value may hold similar passages.
Equal texts are one node.  Each group of nodes with a common value is a star:
its smallest and its largest node are paired with the others, so pairs grow with
the rows.  A pair that shares values of enough hashes is verified on both whole
sequences: its windows are joined on their values, intervals of enough hashes
must overlap on the length of a passage, and a passage is then a run of common
shingles with small gaps, at least ``min_words`` words long and of Jaccard
similarity ``similarity`` or more on both sides.  Linked passages form classes.

A star could miss two texts that share a passage neither shares with a centre, as
when a group is one of a frequent line.  So every group whose windows lie in
passages of several classes, or in none, is compared in full, inside tasks of
bounded blocks, where contexts that share none of their rarest shingles fall
apart and links that tell nothing new are left out.  What is compared there is the context of each window's least
place, a few hundred bytes that hold a piece of every passage around it, so an
exchange does not grow with the lengths of the texts; the linked pairs are then
verified on whole texts.  The blocks are dealt out in slices, each of about four
copies of the texts at most, so that disk does not grow with the groups of a text.

A passage that two texts share word for word has the same value under every
hash.  With 6 hashes, 2 of which must agree, a single window at similarity 0.8
passes with probability 0.998; longer passages have more windows.

Defined results: null and short texts and rows with a null id have no passages;
passages that repeat inside one document only are not reported; rows that
repeat an id are one document.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import WORD, arrow_rows, narrow, settled
from tagloom.llm.graph import components
from tagloom.llm.shingles import mixed, shingle_codes, word_codes

WIDTH, MIN_WORDS, SIMILARITY = 5, 50, 80
HASHES, ENOUGH = 6, 2
_WORD = re.compile(WORD)
# Shingles without a partner that a passage may pass over: two changed words and those between them.
_GAP = 2 * WIDTH + 2
# Members of a block of the full comparison.
_BLOCK = 8192
# Copies of the texts that a slice of it exchanges; columns of keys compared at once.
_COPIES = 4
_COLUMNS = 4096
# Members of groups that are compared at once, of a group that is compared by itself, and pairs of them.
_TOGETHER = 2048
_MANY = 64
_PAIRS = 1024
# Links of a row that do not pass its window's place and are kept even if they tell nothing new.
_LINKS = 8
# Places in the tables of partners that a comparison has at once.
_CELLS = 1 << 20
# Shingles of the pairs of texts that are verified at once.
_SHINGLES = 1 << 16
# Links that a task hands on at once.
_ROWS = 10_000


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over all windows of ``width`` places of each row."""
    places, done = values.shape[1] - width + 1, 1
    while done * 2 <= width:
        values = pick(values[:, :-done], values[:, done:])
        done *= 2
    return pick(values[:, :places], values[:, width - done : width - done + places])


def hashed(codes: np.ndarray, hashes: int) -> np.ndarray:
    """One row of hashed codes per hash."""
    seeds = mixed(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mixed(codes[None, :] ^ seeds[:, None])


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Per row the places that are least in some window of ``width``: the wide nodes of its tree."""
    least = _slide(values, width, np.minimum)
    padded = np.zeros((len(values), least.shape[1] + 2 * (width - 1)), values.dtype)
    padded[:, width - 1 : width - 1 + least.shape[1]] = least
    return _slide(padded, width, np.maximum) == values


def compact_windows(values: np.ndarray, width: int, values_too: bool = False) -> tuple[list, list, list]:
    """(left, least, right) of all nodes of the Cartesian tree that are at least ``width`` wide; ends inclusive.

    Of equal values the first is the least.  ``values_too`` gives the least value in place of its place.
    """
    n = len(values)
    if n < width:
        return [], [], []
    places = np.flatnonzero(least_places(values[None, :], width)[0])
    # The nearest smaller values around such a place are such places themselves.
    own, numbers = values[places].tolist(), places.tolist()
    left, right, stack = [0] * len(own), [n - 1] * len(own), []
    for i, value in enumerate(own):
        while stack and own[stack[-1]] > value:
            right[stack.pop()] = numbers[i] - 1
        left[i] = numbers[stack[-1]] + 1 if stack else 0
        stack.append(i)
    middle = own if values_too else numbers
    kept = [(a, m, b) for a, m, b in zip(left, middle, right) if b - a + 1 >= width]
    return tuple(map(list, zip(*kept))) if kept else ([], [], [])


def window_keys(codes: np.ndarray, shortest: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of all compact windows, with the number of the hash in the last three bits, and their places.

    A value with several places has the place -1.
    """
    if len(codes) < shortest:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    values = hashed(codes, hashes)
    row, place = np.nonzero(least_places(values, shortest))
    keys = values[row, place] & np.uint64(0xFFFFFFFFFFFFFFF8) | row.astype(np.uint64)
    order = np.argsort(keys)
    ordered = keys[order]
    if _fresh(ordered):
        return ordered.view(np.int64), place[order].astype(np.int32)
    keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
    return keys.view(np.int64), np.where(counts > 1, -1, place[first]).astype(np.int32)


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, node, text): equal texts are one node."""
    rows = narrow(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    return rows.filter("doc IS NOT NULL AND text IS NOT NULL").withColumn("node", F.xxhash64("text"))


def _bytes(rows: DataFrame) -> DataFrame:
    """Texts as bytes: Python need not decode them."""
    return rows.withColumn("text", F.col("text").cast("binary"))


def windows(rows: DataFrame, width: int, shortest: int, hashes: int) -> DataFrame:
    """(key, node, place) of all compact windows of all texts."""

    def make(nodes: list, texts: list) -> list[np.ndarray]:
        keys, places = zip(*[window_keys(shingle_codes(word_codes(t), width), shortest, hashes) for t in texts])
        return [np.concatenate(keys), np.repeat(np.array(nodes, np.int64), [len(k) for k in keys]), np.concatenate(places)]

    return arrow_rows(_bytes(rows), make, "key long, node long, place int", "node", "text", rows=200)


def overlap(hashes: list[int], low: list[int], high: list[int], enough: int, shortest: int) -> bool:
    """Whether windows of ``enough`` different hashes share an interval of ``shortest`` places."""
    # A window may begin an interval anywhere from low to high - shortest + 1.
    events = sorted([(a, 0, h) for h, a in zip(hashes, low)] + [(b - shortest + 1, 1, h) for h, b in zip(hashes, high)])
    open_: dict[int, int] = {}
    for _, closes, h in events:
        if closes:
            open_[h] -= 1
            if not open_[h]:
                del open_[h]
        else:
            open_[h] = open_.get(h, 0) + 1
            if len(open_) >= enough:
                return True
    return False


def intervals_agree(one: np.ndarray, two: np.ndarray, shortest: int, hashes: int, enough: int) -> bool:
    """Join the windows of two sequences on hash and value, until enough of them overlap in the second."""
    numbers, low, high = [], [], []
    for h, (first, second) in enumerate(zip(hashed(one, hashes), hashed(two, hashes))):
        known = set(first[least_places(first[None, :], shortest)[0]].tolist()) if len(first) >= shortest else ()
        for left, value, right in zip(*compact_windows(second, shortest, values_too=True)):
            if value in known:
                numbers.append(h)
                low.append(left)
                high.append(right)
        if h + 1 >= enough and overlap(numbers, low, high, enough, shortest):
            return True
    return False


def verbatim(one: np.ndarray, two: np.ndarray, found: list[tuple[int, int, int, int]], shortest: int) -> bool:
    """Whether ``shortest`` shingles in a row are equal from the start, or up to the end, of a passage of both.

    Every hash has a window around such a row in both, so ``intervals_agree`` need not look.
    """
    for a, b, c, d in found:
        n = min(b - a, d - c)
        for x, y in ((a, c), (b - n, d - n)):
            differ = np.flatnonzero(one[x : x + n] != two[y : y + n])
            if (np.diff(differ, prepend=-1, append=n) > shortest).any():
                return True
    return False


def _distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    return codes[new]


def _fresh(ordered: np.ndarray) -> bool:
    """Whether sorted codes are all different."""
    return not (ordered[1:] == ordered[:-1]).any()


def _before(codes: np.ndarray) -> np.ndarray:
    """Per place the last one before it with the same shingle, else -1."""
    places = np.argsort(codes, kind="stable")
    same = np.flatnonzero(codes[places[1:]] == codes[places[:-1]])
    before = np.full(len(codes), -1)
    before[places[same + 1]] = places[same]
    return before


def _occurrences(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``one`` by shingle, and per place of ``two`` where its shingle begins there and how often it occurs."""
    places = np.argsort(one, kind="stable")
    ordered = one[places]
    low = np.searchsorted(ordered, two)
    if _fresh(ordered):
        return places, low, (ordered[np.minimum(low, len(one) - 1)] == two).astype(np.int64)
    return places, low, np.searchsorted(ordered, two, side="right") - low


def _longest(one: np.ndarray, two: np.ndarray, options: list[int], j: int) -> int:
    """The first place of ``options`` from which ``one`` goes on longest like ``two`` from j on."""
    left, done, step = np.array(options), 0, 32
    while (reach := min(step, len(two) - j - done)) > 0:
        at = left[:, None] + np.arange(done, done + reach)
        same = (one[np.minimum(at, len(one) - 1)] == two[j + done : j + done + reach]) & (at < len(one))
        whole = same.all(axis=1)
        if not whole.any():
            return int(left[same.argmin(axis=1).argmax()])
        left, done = left[whole], done + reach
        if len(left) == 1:
            break
        step = min(step * 2, max(32, (1 << 20) // len(left)))
    return int(left[0])


def _alignments(one: np.ndarray, two: np.ndarray, shortest: int) -> list[np.ndarray]:
    """Per place of ``two`` a place of ``one`` with the same shingle, else -1, in up to two ways; none if no run is long enough.

    A shingle that ``one`` holds more than once continues the shift of its neighbour where it can: of the one
    before it in the first way, of the one after it in the second.  Where no shift goes on, the longest copy does.
    """
    places, low, counts = _occurrences(one, two)
    partners = np.where(counts > 0, places[np.minimum(low, len(one) - 1)], -1)
    matched = np.flatnonzero(counts > 0)
    if len(matched) < 2 or matched[-1] - matched[0] + 1 < shortest:
        return [partners]
    cuts = np.flatnonzero(np.diff(matched) > _GAP)
    first, last = np.append(0, cuts + 1), np.append(cuts, len(matched) - 1)
    long = matched[last] - matched[first] + 1 >= shortest
    if not long.any():
        return []
    several, order, numbers = counts[matched] > 1, places.tolist(), matched.tolist()
    begins, own, ways = low[matched], partners[matched].tolist(), []
    begins, ends = begins.tolist(), (begins + counts[matched]).tolist()
    for way in range(2):
        for start, end in zip(first[long].tolist(), last[long].tolist()):
            for k in (np.flatnonzero(several[start : end + 1]) + start).tolist()[:: -1 if way else 1]:
                a, b = begins[k], ends[k]
                near = k + 1 if way else k - 1
                if start <= near <= end:
                    wanted = numbers[k] + own[near] - numbers[near]
                    best = bisect_left(order, wanted, a, b)
                    if best == b or best > a and wanted - order[best - 1] <= order[best] - wanted:
                        best -= 1
                    if abs(order[best] - wanted) <= _GAP:
                        own[k] = order[best]
                        continue
                if not way:
                    own[k] = _longest(one, two, order[a:b], numbers[k])
        ways.append(partners.copy())
        ways[way][matched] = own
    return ways[:1] if np.array_equal(*ways) else ways


def passages(one: np.ndarray, two: np.ndarray, shortest: int, similarity: int) -> list[tuple[int, int, int, int]]:
    """Similar passages of two sequences: (start, end) in each, ends exclusive, in shingles."""
    if min(len(one), len(two)) < shortest:
        return []
    found: list[tuple[int, int, int, int]] = []
    ways = _alignments(one, two, shortest)
    fresh = bool(ways) and _fresh(np.sort(one)) and _fresh(np.sort(two))
    for partners in ways:
        found += _aligned(one, two, partners, shortest, similarity, fresh)
    return _widest(found)


def _widest(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """What is no part of another: what one way finds may be a part of what the other finds."""
    if len(found) < 2:
        return found
    within = lambda p, q: q[0] <= p[0] and p[1] <= q[1] and q[2] <= p[2] and p[3] <= q[3]
    found = list(dict.fromkeys(found))
    return [p for p in found if not any(p != q and within(p, q) for q in found)]


def _aligned(
    one: np.ndarray, two: np.ndarray, partners: np.ndarray, shortest: int, similarity: int, fresh: bool = False
) -> list[tuple[int, int, int, int]]:
    """Similar passages of one alignment; of ``fresh`` sequences, neither of which repeats a shingle, partners are counted."""
    found: list[tuple[int, int, int, int]] = []
    before: list[np.ndarray] = []

    def pieces(run: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
        """Parts of a run that are long enough for a passage."""
        bounds = [0, *cuts, len(run)]
        return [run[a:b] for a, b in zip(bounds, bounds[1:]) if a < b and run[b - 1] - run[a] + 1 >= shortest]

    todo = pieces(np.flatnonzero(partners >= 0), [])
    while todo:
        run = todo.pop()
        step = run[1:] - run[:-1]
        widest = int(step.max()) if len(step) else 1
        if widest > _GAP:
            todo += pieces(run, (np.flatnonzero(step > _GAP) + 1).tolist())
            continue
        # Both sides go on together: a jump in either ends a run, but for shingles that occur twice.
        own = partners[run]
        shift = own - run
        jumps: list[int] = []
        straight = int(shift.max()) - int(shift.min()) <= _GAP
        kept = run
        if not straight:
            ordered, half = np.sort(shift), len(shift) // 2
            middle = int(ordered[half]) if len(shift) % 2 else int((int(ordered[half - 1]) + int(ordered[half])) / 2)
            near = np.abs(shift - middle) <= _GAP
            jumps = (np.flatnonzero(np.abs(shift[1:] - shift[:-1]) > _GAP) + 1).tolist()
            kept, own = run[near], own[near]
        if len(kept) * 2 >= len(run):
            start, end = int(kept[0]), int(kept[-1]) + 1
            begin, stop = int(own.min()), int(own.max()) + 1
            if end - start >= shortest and stop - begin >= shortest:
                if not fresh:
                    before = before or [_before(one), _before(two)]
                    both = int((before[0][begin:stop] < begin).sum()) + int((before[1][start:end] < start).sum())
                    # Each common shingle has a place in the run: if these are too few, sets need not be made.
                    common = min(len(run), both)
                    if 100 * common >= similarity * (both - common):
                        common = both - len(_distinct(np.concatenate([_distinct(one[begin:stop]), _distinct(two[start:end])])))
                    either = both - common
                else:
                    # A straight run holds every place between its ends that has a partner.
                    between = partners[start:end]
                    common = len(run) if straight else int(((between >= begin) & (between < stop)).sum())
                    either = stop - begin + end - start - common
                if 100 * common >= similarity * either:
                    found.append((begin, stop, start, end))
                    # What lies before and after on other diagonals may be a passage too.
                    for rest in (run[run < start], run[run >= end]) if not straight else ():
                        todo += pieces(rest, [])
                    continue
            if not len(jumps) and widest > 1:
                jumps = [int(step.argmax()) + 1]
        if len(jumps):
            todo += pieces(run, jumps)
    return found


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of ``counts`` from ``starts`` on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _cut(rows: np.ndarray, place: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the runs of matched places, given by row and place, that are long enough for a passage."""
    edges = np.flatnonzero((rows[1:] != rows[:-1]) | (place[1:] - place[:-1] > _GAP)) + 1
    low, high = np.append(0, edges), np.append(edges, len(rows))
    if not len(rows):
        low = high = edges
    long = place[high - 1] - place[low] + 1 >= shortest
    return low[long], high[long]


def _similar(
    place: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, shortest: int, similarity: int,
    repeats: Callable[..., tuple] | None = None,
) -> tuple[np.ndarray, ...]:
    """``_aligned`` of many runs at once, ranges of ``place`` with its partners in ``own``.

    Returns (run, start and end in each, whether all of it has one shift, places) of the passages.  ``repeats`` gives
    the places between the ends in each, and those of the range, whose shingle occurs before between these ends.
    """
    # One more element: a range may end with the last.
    place, own = np.append(place, 0), np.append(own, 0)
    shift, step = own - place, np.append(place[1:] - place[:-1], 0)
    number, found = np.arange(len(low)), []
    while len(low):
        edges, count = np.stack([low, high], axis=1).ravel(), high - low
        least, most = np.minimum.reduceat(shift, edges)[::2], np.maximum.reduceat(shift, edges)[::2]
        begin, stop = np.minimum.reduceat(own, edges)[::2], np.maximum.reduceat(own, edges)[::2] + 1
        start, end = place[low], place[high - 1] + 1
        straight, common = most - least <= _GAP, count
        either = stop - begin + end - start - count
        long = np.flatnonzero(straight & (stop - begin >= shortest) & (end - start >= shortest))
        if repeats is not None and len(long):
            twice = repeats(number[long], begin[long], stop[long], start[long], end[long], low[long], high[long])
            common, either = common.copy(), either
            common[long] -= twice[2]
            either[long] += twice[2] - twice[1] - twice[0]
        good = np.zeros(len(low), bool)
        good[long] = 100 * common[long] >= similarity * either[long]
        found.append(np.stack([number, begin, stop, start, end, least == most, count])[:, good])
        # What is not similar is cut where it pauses longest.
        rest = np.flatnonzero(straight & ~good & (count > 1))
        pieces = [np.zeros((3, 0), np.int64)]
        if len(rest):
            widest = np.maximum.reduceat(step, np.stack([low[rest], high[rest] - 1], axis=1).ravel())[::2]
            rest, widest = rest[widest > 1], widest[widest > 1]
            first, last = low[rest], high[rest]
            inner, run = _expand(first, last - 1 - first), np.repeat(np.arange(len(rest)), last - 1 - first)
            pauses = np.flatnonzero(step[inner] == widest[run])
            cut = inner[pauses[np.flatnonzero(np.diff(run[pauses], prepend=-1))]] + 1
            pieces += [np.stack([number[rest], first, cut]), np.stack([number[rest], cut, last])]
        for k in np.flatnonzero(~straight).tolist():
            passage, parts = _jumping(place, own, int(number[k]), int(low[k]), int(high[k]), shortest, similarity, repeats)
            if passage:
                found.append(np.array([[number[k], *passage, 0, 0]]).T)
            if parts:
                pieces.append(np.array([(number[k], *x) for x in parts]).T)
        number, low, high = np.concatenate(pieces, axis=1)
        long = place[high - 1] - place[low] + 1 >= shortest
        number, low, high = number[long], low[long], high[long]
    return tuple(np.concatenate(found, axis=1)) if found else tuple(np.zeros((7, 0), np.int64))


def _jumping(
    place: np.ndarray, own: np.ndarray, number: int, low: int, high: int, shortest: int, similarity: int,
    repeats: Callable[..., tuple] | None,
) -> tuple[tuple[int, int, int, int] | None, list[tuple[int, int]]]:
    """The passage of one run whose shifts differ, if it is one, and the ranges that are still to be looked at."""
    at, to = place[low:high], own[low:high]
    shift, step = to - at, at[1:] - at[:-1]
    widest = int(step.max())
    ordered, half = np.sort(shift), len(shift) // 2
    middle = int(ordered[half]) if len(shift) % 2 else int((int(ordered[half - 1]) + int(ordered[half])) / 2)
    near = np.flatnonzero(np.abs(shift - middle) <= _GAP)
    jumps = (np.flatnonzero(np.abs(shift[1:] - shift[:-1]) > _GAP) + 1).tolist()
    if len(near) * 2 >= len(at):
        first, last = int(near[0]), int(near[-1]) + 1
        start, end = int(at[first]), int(at[last - 1]) + 1
        begin, stop = int(to[near].min()), int(to[near].max()) + 1
        if end - start >= shortest and stop - begin >= shortest:
            inside = (to[first:last] >= begin) & (to[first:last] < stop)
            common, lost = int(inside.sum()), (0, 0)
            if repeats is not None:
                *lost, again = repeats(*(np.array([x]) for x in (number, begin, stop, start, end, low + first, low + last)), inside)
                common -= int(again[0])
            either = stop - begin + end - start - int(lost[0]) - int(lost[1]) - common
            if 100 * common >= similarity * either:
                # What lies before and after on other diagonals may be a passage too.
                return (begin, stop, start, end), [(low, low + first)] * (first > 0) + [(low + last, high)] * (low + last < high)
        if not jumps and widest > 1:
            jumps = [int(step.argmax()) + 1]
    if not jumps:
        return None, []
    bounds = [0, *jumps, len(at)]
    return None, [(low + a, low + b) for a, b in zip(bounds, bounds[1:])]


def _partners(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shingles that the two sequences of pairs share; ``begins`` and ``sizes`` in ``codes`` have a row per pair.

    Returns (partner of each place of the second sequences, -1: none; whether it is one of several; the place of an
    equal shingle before each place of both, -1: none; whether to take a pair on its own).
    """
    lengths, starts = sizes.ravel(), begins.ravel()
    offsets = np.append(0, np.cumsum(lengths))
    total, place_bits, pair_bits = int(offsets[-1]), int(lengths.max()).bit_length(), (len(sizes) - 1).bit_length()
    tail = place_bits + 1
    # Sorted by pair, as many bits of the shingle as there is room for, sequence and place.
    places = np.arange(int(lengths.max()), dtype=np.uint64)
    short = codes >> np.uint64(pair_bits + tail) << np.uint64(tail)
    keys = np.empty(total, np.uint64)
    for k, (o, b, n) in enumerate(zip(offsets.tolist(), starts.tolist(), lengths.tolist())):
        own = keys[o : o + n]
        np.bitwise_or(short[b : b + n], places[:n], out=own)
        own |= np.uint64((k >> 1 << 64 - pair_bits if pair_bits else 0) | (k & 1) << place_bits)
    keys.sort()
    same = keys[1:] ^ keys[:-1] < np.uint64(1 << tail)
    # Only elements of runs of equal shingles matter.
    whole = np.zeros(total, bool)
    whole[1:], whole[0] = same, False
    new = ~whole
    whole[:-1] |= same
    runs = np.flatnonzero(whole)
    new = new[runs]
    own = keys[runs]
    pair = (own >> np.uint64(64 - pair_bits)).astype(np.int64) if pair_bits else np.zeros(len(own), np.int64)
    side = (own >> np.uint64(place_bits) & np.uint64(1)).astype(np.int64)
    at = (own & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    where = offsets[2 * pair + side] + at
    partner, several, before = np.full(total, -1), np.zeros(total, bool), np.full(total, -1)
    alone = np.zeros(len(sizes), bool)
    if len(runs):
        full = codes[starts[2 * pair + side] + at]
        alone[pair[1:][~new[1:] & (full[1:] != full[:-1])]] = True
        again = np.flatnonzero(~new[1:] & (side[1:] == side[:-1])) + 1
        before[where[again]] = where[again - 1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        matched = (side == 1) & (side[first] == 0)
        partner[where[matched]] = where[first[matched]]
        second = first[matched] + 1
        several[where[matched]] = side[second] == 0
    return partner, several, before, alone


def verified_pairs(
    pairs: list[tuple[int, int]], words: list[np.ndarray], width: int, shortest: int, similarity: int, hashes: int, enough: int
) -> Iterator[tuple[int, int, int, int, int]]:
    """(number of the pair, start and end in each) of the passages of pairs of sequences of word codes, by ``words``.

    The same as ``passages`` of each pair, if enough windows agree.
    """
    sizes = np.array([len(w) for w in words])
    flat = np.concatenate([*words, np.zeros(width, np.uint32)]).astype(np.uint64)
    codes = shingle_codes(flat, width)
    begins = np.append(0, np.cumsum(sizes))[:-1]
    counts = np.maximum(sizes - width + 1, 0)
    both = np.array(pairs).reshape(-1, 2)
    kept = np.flatnonzero(counts[both].min(axis=1) >= shortest)
    if not len(kept):
        return
    both = both[kept]
    sizes, begins = counts[both], begins[both]
    partner, several, before, alone = _partners(codes, begins, sizes)
    offsets = np.append(0, np.cumsum(sizes.ravel()))
    ones, twos = offsets[:-1:2], offsets[1::2]
    matched = np.flatnonzero(partner >= 0)
    rows = np.searchsorted(ones, matched, side="right") - 1
    place, own = matched - twos[rows], partner[matched] - ones[rows]
    low, high = _cut(rows, place, shortest)
    if len(low):
        some = np.logical_or.reduceat(np.append(several[matched], False), np.stack([low, high], axis=1).ravel())[::2]
        alone[rows[low[some]]] = True
    plain = ~alone[rows[low]] if len(low) else np.zeros(0, bool)
    low, high = low[plain], high[plain]
    run_rows = rows[low]

    twice = np.append(before >= 0, False)

    def repeats(
        run: np.ndarray, begin: np.ndarray, stop: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray,
        counted: np.ndarray | None = None,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places between the ends in each sequence, and of the run, whose shingle occurs before between the ends."""
        row, out = run_rows[run], [np.zeros(len(run), np.int64) for _ in range(3)]
        ranges = ((0, ones[row], begin, stop), (1, twos[row], start, end))
        some = [np.logical_or.reduceat(twice, np.stack([o + a, o + b], axis=1).ravel())[::2] for _, o, a, b in ranges]
        for k, offset, a, b in ranges:
            own = np.flatnonzero(some[k])
            if len(own):
                inner, of_run = _expand((offset + a)[own], (b - a)[own]), np.repeat(own, (b - a)[own])
                out[k] = np.bincount(of_run[before[inner] >= (offset + a)[of_run]], minlength=len(run))
        own = np.flatnonzero(some[1])
        if len(own):
            inner, of_run = _expand(first[own], (last - first)[own]), np.repeat(own, (last - first)[own])
            again = before[matched[inner]] >= (twos[row] + start)[of_run]
            out[2] = np.bincount(of_run[again if counted is None else again & counted], minlength=len(run))
        return tuple(out)

    run, begin, stop, start, end, even, count = _similar(place, own, low, high, shortest, similarity, repeats)
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    row = run_rows[run]
    for r, *passage in zip(row.tolist(), begin.tolist(), stop.tolist(), start.tolist(), end.tolist()):
        found.setdefault(r, []).append(tuple(passage))
    # ``verbatim`` of all these passages.
    length = np.minimum(stop - begin, end - start)
    sure: set[int] = set()
    for first, second in ((begin, start), (stop - length, end - length)) if len(row) else ():
        # One more element after each parts them.
        inner, ends = _expand(np.zeros(len(row), np.int64), length + 1), np.cumsum(length + 1) - 1
        other = np.repeat(begins[row, 1] + second, length + 1) + inner
        inner += np.repeat(begins[row, 0] + first, length + 1)
        differ = codes[np.minimum(inner, len(codes) - 1)] != codes[np.minimum(other, len(codes) - 1)]
        differ[ends] = True
        stops = np.flatnonzero(differ)
        sure.update(row[np.searchsorted(ends, stops[np.diff(stops, prepend=-1) > shortest])].tolist())
    of = lambda r, k: codes[begins[r, k] : begins[r, k] + sizes[r, k]]
    for r in np.flatnonzero(alone).tolist():
        found[r] = passages(of(r, 0), of(r, 1), shortest, similarity)
    for r, got in found.items():
        got = _widest(got)
        # The cheaper tests go first.
        if got and (
            enough <= hashes and (r in sure or alone[r] and verbatim(of(r, 0), of(r, 1), got, shortest))
            or intervals_agree(of(r, 0), of(r, 1), shortest, hashes, enough)
        ):
            yield from ((int(kept[r]), *p) for p in got)


def sharing(keys: list[np.ndarray], enough: int) -> np.ndarray:
    """Per pair of members whether their window keys agree in ``enough`` hashes, as windows that overlap must."""
    owner, flat = np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys)
    _, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
    agreed = np.zeros((len(keys), len(keys)), np.int8)
    for number in range(8):
        own = (counts[ids] > 1) & (flat & 7 == number)
        columns = np.unique(ids[own], return_inverse=True)[1]
        both = np.zeros(agreed.shape, bool)
        for start in range(0, columns.max(initial=-1) + 1, _COLUMNS):
            part = (columns >= start) & (columns < start + _COLUMNS)
            held = np.zeros((len(keys), _COLUMNS if columns.max() >= start + _COLUMNS else columns.max() - start + 1), np.float32)
            held[owner[own][part], columns[part] - start] = 1
            both |= held @ held.T > 0
        agreed += both
    return agreed >= enough


def contexts(
    words: np.ndarray, keys: list[int], places: list[int], width: int, shortest: int, hashes: int
) -> Iterator[tuple[int, int, int, bytes]]:
    """(number of the key, place, start, shingles) around the places of window keys.

    Whatever passage holds a place, a piece of it of the shortest length lies in reach.  Shingles are told by 32 bits.
    A key with several places has a context for each, equal ones once.
    """
    codes = shingle_codes(words.astype(np.uint64), width)
    short, reach = codes.astype(np.uint32), shortest + _GAP
    values = least = None
    for number, (key, place) in enumerate(zip(keys, places)):
        own = [place]
        if place < 0:
            if values is None:
                values = hashed(codes, hashes)
                least = least_places(values, shortest)
            h = key & 7
            same = values[h] & np.uint64(0xFFFFFFFFFFFFFFF8) == np.uint64((key & 0xFFFFFFFFFFFFFFFF) - h)
            own = np.flatnonzero(same & least[h]).tolist()
        seen = set()
        for at in own:
            start = max(at - reach, 0)
            around = short[start : at + reach + 1].tobytes()
            if place >= 0 or around not in seen:
                seen.add(around)
                yield number, at, start, around


def _least_distinct(codes: np.ndarray, shortest: int) -> int:
    """The fewest different shingles in any window of the shortest length."""
    held = np.sort(np.lib.stride_tricks.sliding_window_view(codes, shortest), axis=1)
    return int((held[:, 1:] != held[:, :-1]).sum(axis=1).min()) + 1


def _close(at: np.ndarray, shortest: int, similarity: int) -> np.ndarray:
    """Rows of partners (-1: none), of sequences without repeats, where a similar passage may lie.

    Such a passage has ``similarity`` percent of the shingles of both sides together in common, and the other
    side reaches from the partner of its first place to that of its last.
    """
    if at.shape[1] < shortest:
        return np.zeros(len(at), bool)
    matched, far = at >= 0, np.int32(1 << 29)
    run = np.zeros((len(at), at.shape[1] + 1), np.int32)
    np.cumsum(matched, axis=1, out=run[:, 1:])
    run *= 100 + similarity
    run -= similarity * np.arange(run.shape[1], dtype=np.int32)
    opens = np.where(matched, run[:, :-1] - similarity * at, far)[:, : at.shape[1] - shortest + 1]
    closes = np.where(matched, run[:, 1:] - similarity * at, -far)[:, shortest - 1 :]
    return (closes - np.minimum.accumulate(opens, axis=1)).max(axis=1) >= similarity


def _order(*columns: np.ndarray) -> np.ndarray:
    """Places of the rows sorted by columns of whole numbers from 0 on, the first column first."""
    n = len(columns[0])
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) + n.bit_length() > 63:
        return np.lexsort(columns[::-1])
    keys = np.zeros(n, np.int64)
    for column, width in zip(columns, bits):
        keys = keys << width | column
    keys = keys << n.bit_length() | np.arange(n)
    keys.sort()
    return keys & (1 << n.bit_length()) - 1


def _parts(row: np.ndarray, element: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """A number per set, the same for sets that may have ``needed`` elements in common, directly or by others; -1: none has.

    Sets are given by row and element, each once.  Two sets with that many elements in common share one of the rarest
    of each, all but ``needed`` - 1 of them: sets that share only what many others hold fall apart.
    """
    part = np.full(len(needed), -1)
    while True:
        own = np.bincount(element)[element] > 1
        row, element = row[own], element[own]
        size = np.bincount(row, minlength=len(needed))
        kept = (size >= needed)[row]
        if kept.all():
            break
        row, element = row[kept], element[kept]
    if not len(row):
        return part
    order = _order(row, np.bincount(element)[element], element)
    row, element = row[order], element[order]
    rank = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    rare = rank <= (size - needed)[row]
    row, element = row[rare], element[rare]
    own = np.bincount(element)[element] > 1
    row, element = row[own], element[own]
    if not len(row):
        return part
    # The smallest row that is reached, passed on by elements and rows in turn.
    sets, first = np.unique(row, return_index=True)
    by_element = np.argsort(element, kind="stable")
    heads = np.flatnonzero(np.diff(element[by_element], prepend=-1))
    widths = np.diff(np.append(heads, len(row)))
    part[sets] = sets
    while True:
        passed = np.empty(len(row), np.int64)
        passed[by_element] = np.repeat(np.minimum.reduceat(part[row[by_element]], heads), widths)
        least = np.minimum.reduceat(passed, first)
        least = np.minimum(least, part[least])
        if (least == part[sets]).all():
            return part
        np.minimum.at(part, part[sets], least)
        part[sets] = np.minimum(least, part[sets])


class _Zones:
    """What links between passages of rows have told: passages that overlap in a row are one zone of it."""

    def __init__(self) -> None:
        self.of: dict[int, list[tuple[int, int, int]]] = {}
        self.root: list[int] = []
        self.links: Counter[int] = Counter()

    def top(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def enter(self, row: int, start: int, end: int) -> tuple[int, bool]:
        """The zone of a passage, and whether it grew."""
        held = self.of.setdefault(row, [])
        for a, b, zone in held:
            if a <= start and end <= b:
                return self.top(zone), False
        joined = [z for z in held if z[0] < end and start < z[1]]
        if joined:
            zone = joined[0][2]
            for a, b, other in joined:
                start, end = min(start, a), max(end, b)
                self.root[self.top(other)] = self.top(zone)
        else:
            zone = len(self.root)
            self.root.append(zone)
        self.of[row] = [z for z in held if z not in joined] + [(start, end, zone)]
        return self.top(zone), True

    def link(self, i: int, j: int, start: int, end: int, begin: int, stop: int) -> bool:
        """Whether a link of two passages tells what those before it did not, or one of the rows has few links so far."""
        one, grew = self.enter(i, start, end)
        two, also = self.enter(j, begin, stop)
        one = self.top(one)
        self.root[one] = two
        told = grew or also or one != two or min(self.links[i], self.links[j]) < _LINKS
        self.links.update((i, j) if told else ())
        return told


def compare_block(
    nodes: np.ndarray, blocks: np.ndarray, labels: np.ndarray, places: np.ndarray, starts: np.ndarray,
    around: list[np.ndarray], shortest: int, similarity: int, both_blocks: bool,
) -> list[tuple]:
    """Links between members of one open group, by the contexts of the window they share: a spanning forest."""
    columns = (np.asarray(x) for x in (nodes, blocks, labels, places, starts))
    return compare_groups(np.array([len(around)]), *columns, around, shortest, similarity, np.array([both_blocks]))


def compare_groups(
    members: np.ndarray, nodes: np.ndarray, blocks: np.ndarray, labels: np.ndarray, places: np.ndarray, starts: np.ndarray,
    around: list[np.ndarray], shortest: int, similarity: int, both_blocks: np.ndarray,
) -> list[tuple]:
    """``compare_block`` of several groups, one after the other in rows, of ``members`` rows each.

    A similar passage has at least as many different shingles as the poorest window of each context, and at least
    ``similarity`` percent of them in common.  Pairs whose classes are linked already are left out.
    """
    sizes, group = np.array([len(c) for c in around]), np.repeat(np.arange(len(members)), members)
    total = int(sizes.sum())
    row = np.repeat(np.arange(len(around)), sizes)
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = np.concatenate(around).astype(np.uint64)
    # Sorted by group, shingle, row and place.
    bits = [(len(x) - 1).bit_length() for x in (members, around)] + [int(sizes.max()).bit_length()]
    if 32 + sum(bits) > 64:
        half = np.cumsum(members)[: len(members) // 2]
        if not len(half):
            raise ValueError("a group of contexts that is too large")
        cut, at = len(half), int(half[-1])
        columns = (nodes, blocks, labels, places, starts, around)
        one = compare_groups(members[:cut], *(x[:at] for x in columns), shortest, similarity, both_blocks[:cut])
        return one + compare_groups(members[cut:], *(x[at:] for x in columns), shortest, similarity, both_blocks[cut:])
    low = np.uint64(bits[1] + bits[2])
    keys = flat << low | row.astype(np.uint64) << np.uint64(bits[2]) | place.astype(np.uint64)
    if bits[0]:
        keys |= group[row].astype(np.uint64) << np.uint64(32 + bits[1] + bits[2])
    keys.sort()
    heads = keys >> low
    row = (keys >> np.uint64(bits[2]) & np.uint64((1 << bits[1]) - 1)).astype(np.int64)
    place = (keys & np.uint64((1 << bits[2]) - 1)).astype(np.int64)
    new = np.append(True, heads[1:] != heads[:-1])
    again = np.append(False, ~new[1:] & (row[1:] == row[:-1]))
    fresh = np.ones(len(around), bool)
    fresh[row[again]] = False
    ids = np.cumsum(new) - 1
    least = np.full(len(around), shortest)
    for i in np.flatnonzero(~fresh).tolist():
        least[i] = _least_distinct(around[i], shortest)
    bounds = np.append(0, np.cumsum(members))
    needed = -(-similarity * (least + np.minimum.reduceat(least, bounds[:-1])[group]) // (100 + similarity))
    entry = np.flatnonzero(~again)
    if members.max() > _MANY:
        part = _parts(row[entry], ids[entry], needed)
    else:
        # Small groups are parts of their own.
        common = np.bincount(row[entry], weights=np.bincount(ids[entry])[ids[entry]] > 1, minlength=len(around))
        part = np.where(common >= needed, bounds[group], -1)
    left = np.flatnonzero(part >= 0)
    if not len(left):
        return []
    # Columns of the shingles that rows of a part share; 0 is any other shingle.
    own = np.flatnonzero(part[row] >= 0)
    own = own[_order(part[row[own]], ids[own])]
    row, place, ids = row[own], place[own], ids[own]
    new = (np.diff(part[row], prepend=-1) != 0) | (np.diff(ids, prepend=-1) != 0)
    run = np.cumsum(new) - 1
    shared = np.bincount(run) > 1
    numbers, parts = np.cumsum(shared), part[row[new]]
    heads = np.flatnonzero(np.diff(parts, prepend=-1))
    widths = np.zeros(len(around), np.int64)
    widths[parts[heads]] = np.add.reduceat(shared.astype(np.int64), heads) + 1
    before = np.repeat((numbers - shared)[heads], np.diff(np.append(heads, len(parts))))
    column = np.zeros((len(around), int(sizes.max())), np.int32)
    column[row, place] = np.where(shared, numbers - before, 0)[run]
    classes = np.unique(np.stack([group, labels]), axis=1, return_inverse=True)[1].ravel()
    lengths = np.arange(column.shape[1], dtype=np.int32)
    found: list[tuple] = []
    zones = _Zones()

    def linked(one: np.ndarray, two: np.ndarray) -> None:
        """Compare pairs of rows, in order."""
        apart = classes[one] != classes[two]
        one, two = one[apart], two[apart]
        if not len(one):
            return
        own = np.flatnonzero(np.diff(one, prepend=-1))
        rows, at = one[own], np.cumsum(np.diff(one, prepend=-1) != 0) - 1
        wide = widths[part[rows]]
        base = np.cumsum(wide) - wide
        partner = np.full(int(wide.sum()), -1, np.int32)
        partner[base[:, None] + column[rows]] = lengths
        partner[base] = -1
        to = partner[base[at][:, None] + column[two]]
        count = (to >= 0).sum(axis=1)
        plain = fresh[one] & fresh[two]
        kept = np.flatnonzero((100 + similarity) * count >= similarity * (least[one] + least[two]))
        kept = kept[~plain[kept] | _close(to[kept], shortest, similarity)]
        if not len(kept):
            return
        one, two, to, plain = one[kept], two[kept], to[kept], plain[kept]
        where = np.flatnonzero(to >= 0)
        pair, inner = np.divmod(where, to.shape[1])
        low, high = _cut(pair, inner, shortest)
        # Where shingles repeat, pairs are taken on their own.
        alone = set(pair[low].tolist()) - set(np.flatnonzero(plain).tolist())
        own = plain[pair[low]]
        low, high = low[own], high[own]
        run, *passage, _, _ = _similar(inner, to.ravel()[where].astype(np.int64), low, high, shortest, similarity)
        got: dict[int, list[tuple[int, int, int, int]]] = {}
        for k, *p in zip(pair[low[run]].tolist(), *(x.tolist() for x in passage)):
            got.setdefault(k, []).append(tuple(p))
        for k in sorted(got.keys() | alone):
            i, j = int(one[k]), int(two[k])
            if classes[i] == classes[j]:
                continue
            spans = _widest(got[k]) if plain[k] else passages(around[i], around[j], shortest, similarity)
            x, y = int(starts[i]), int(starts[j])
            spans = [(a + x, b + x, c + y, d + y) for a, b, c, d in spans]
            around_places = any(a <= places[i] < b and c <= places[j] < d for a, b, c, d in spans)
            # All are entered: a list, as any() would stop.
            told = any([zones.link(i, j, *p) for p in spans])
            if around_places or told:
                found.extend((int(nodes[i]), int(nodes[j]), *p) for p in spans)
            if around_places:
                own = classes[bounds[group[i]] : bounds[group[i] + 1]]
                own[own == classes[i]] = classes[j]

    def differ(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (nodes[one] != nodes[two]) & (~both_blocks[group[one]] | (blocks[one] != blocks[two])) & (classes[one] != classes[two])

    # Few rows of each group go first: what they link need not be compared.  Rows meet those of their part only.
    order = left[np.argsort(part[left], kind="stable")]
    ends = np.searchsorted(part[order], part[order], side="right")
    rank = np.arange(len(left)) - np.searchsorted(group[left], group[left])
    number = np.frexp(rank[np.searchsorted(left, order)] + 1)[1]
    rows = np.lexsort((order, number))
    waves = np.append(np.flatnonzero(np.diff(number[rows], prepend=-1)), len(rows))
    for first, last in zip(waves, waves[1:]):
        own = rows[first:last]
        pairs = np.cumsum(ends[own] - own - 1)
        while len(own):
            # As many rows as make some pairs at least.
            n = int(np.searchsorted(pairs, _PAIRS << 6)) + 1
            others = ends[own[:n]] - own[:n] - 1
            one, two = order[np.repeat(own[:n], others)], order[_expand(own[:n] + 1, others)]
            apart = differ(one, two)
            one, two = one[apart], two[apart]
            while len(one):
                # Tables of the partners of some rows at once.
                wide = np.cumsum(np.where(np.diff(one[:_PAIRS], prepend=-1), widths[part[one[:_PAIRS]]], 0))
                end = max(int(np.searchsorted(wide, _CELLS, side="right")), int(np.searchsorted(one[:_PAIRS], one[0], side="right")))
                linked(one[:end], two[:end])
                one, two = one[end:], two[end:]
            own, pairs = own[n:], pairs[n:] - (pairs[n - 1] if n <= len(pairs) else 0)
    return found


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal keys in sorted batches, whole across batch borders, as columns of plain arrays."""
    held: list[dict[str, np.ndarray]] = []
    for frame in batches:
        columns = {c: frame[c].to_numpy() for c in frame.columns}
        change = np.flatnonzero(np.any([columns[k][1:] != columns[k][:-1] for k in keys], axis=0)) + 1
        edges = [0, *change.tolist(), len(frame)]
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            part = {c: v[start:end] for c, v in columns.items()}
            if held and (start or any(held[-1][k][-1] != part[k][0] for k in keys)):
                yield {c: np.concatenate([h[c] for h in held]) for c in part} if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, min_words: int = MIN_WORDS,
    similarity: int = SIMILARITY, hashes: int = HASHES, enough: int = ENOUGH,
) -> DataFrame:
    """One row per repeated passage: doc_id, start_word, end_word (exclusive), class_id, n_docs.

    ``class_id`` is the smallest doc_id that holds a passage of the class.
    """
    shortest = max(min_words - width + 1, 1)
    rows = _nodes(docs, id_col, text_col)
    names = settled(rows.select("doc", "node").distinct(), "names")
    copies = names.groupBy("node").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("copies"))

    # One exchange tells which values are shared, and by whom.
    group = Window.partitionBy("key")
    shared = windows(rows, width, shortest, hashes).withColumns(
        {"first": F.min("node").over(group), "last": F.max("node").over(group), "size": F.count(F.lit(1)).over(group)}
    )
    shared = settled(shared.filter("first < last"), "windows")
    centres = F.array(F.col("first"), F.when(F.col("node") != F.col("first"), F.col("last")))
    star = (
        shared.select(F.explode(centres).alias("a"), F.col("node").alias("b"), F.expr("shiftleft(1, cast(key & 7 AS int))").alias("hash"))
        .filter("a IS NOT NULL AND a <> b")
    )
    pairs = star.groupBy("a", "b").agg(F.bit_or("hash").alias("hashes")).filter(F.bit_count("hashes") >= enough).select("a", "b")
    pairs = settled(pairs, "pairs")

    repeated = copies.filter("copies > 1").select("node")
    # Texts of pairs, of groups that may be compared in full, and repeated ones: all that is read of them later.
    large = shared.filter("size > 3").select("key", "node", "place")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(repeated).unionByName(large.select("node")).distinct()
    chosen = wanted.join(copies, "node").select(F.col("node").alias("n"), F.col("least").alias("d"))
    texts = rows.join(chosen, (F.col("doc") == F.col("d")) & (F.col("node") == F.col("n")), "left_semi")

    def encode(nodes: list, values: list) -> list[list]:
        words = [word_codes(t).astype(np.uint32) for t in values]
        return [nodes, [len(w) for w in words], [w.tobytes() for w in words]]

    sequences = settled(arrow_rows(_bytes(texts), encode, "node long, n int, words binary", "node", "text").dropDuplicates(["node"]), "sequences")

    def verify(a: list, b: list, one: list, two: list) -> list[list]:
        out, at = [], 0
        while at < len(a):
            # Some pairs at once, each text once.
            words, numbers, pairs, first, size = [], {}, [], at, 0
            while at < len(a) and (at == first or size + len(one[at]) + len(two[at]) <= 4 * _SHINGLES):
                size += len(one[at]) + len(two[at])
                for node, text in ((a[at], one[at]), (b[at], two[at])):
                    if node not in numbers:
                        numbers[node] = len(words)
                        words.append(np.frombuffer(text, np.uint32))
                pairs.append((numbers[a[at]], numbers[b[at]]))
                at += 1
            found = verified_pairs(pairs, words, width, shortest, similarity, hashes, enough)
            out += [(a[first + k], b[first + k], *p) for k, *p in found]
        return [list(c) for c in zip(*out)] if out else [[] for _ in range(6)]

    schema = "a long, b long, a_start int, a_end int, b_start int, b_end int"

    def verified(pairs: DataFrame) -> DataFrame:
        both = (
            pairs.join(sequences.select(F.col("node").alias("a"), F.col("words").alias("one")), "a")
            .join(sequences.select(F.col("node").alias("b"), F.col("words").alias("two")), "b")
        )
        return settled(arrow_rows(both, verify, schema, "a", "b", "one", "two", rows=50), "passages")

    links = verified(pairs)

    def labelled(links: DataFrame, sequences: DataFrame) -> DataFrame:
        """(part, node, start, end, label) of all passages."""
        # Overlapping passages of a node are one; equal ones are counted once before.
        sides = [links.select(F.col(x).alias("node"), F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end")) for x in "ab"]
        whole_texts = (
            sequences.join(repeated, "node", "left_semi").filter(F.col("n") - width + 1 >= shortest)
            .select("node", F.lit(0).alias("start"), (F.col("n") - width + 1).alias("end"))
        )
        spans = sides[0].unionByName(sides[1]).unionByName(whole_texts).distinct()
        order = Window.partitionBy("node").orderBy("start", F.desc("end"))
        before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        runs = (
            spans.withColumn("new", F.when(F.col("start") < before, 0).otherwise(1))
            .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        )
        runs = settled(runs.select("node", "start", "end", F.xxhash64("node", "run").alias("part")), "runs")
        side = lambda x: runs.select(
            F.col("node").alias(x), F.col("start").alias(f"{x}_start"), F.col("end").alias(f"{x}_end"), F.col("part").alias(f"{x}_part")
        )
        edges = (
            links.join(side("a"), ["a", "a_start", "a_end"]).join(side("b"), ["b", "b_start", "b_end"])
            .select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct()
        )
        labels = components(edges).withColumnRenamed("node", "part")
        parts = runs.groupBy("node", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        return parts.join(labels, "part", "left").withColumn("label", F.coalesce("label", "part"))

    parts = settled(labelled(links, sequences), "parts")

    # Groups of up to three nodes are stars of all their pairs.
    inside = (
        large
        .join(parts.select(F.col("node").alias("n"), "start", "end", "label"), F.expr("node = n AND place >= start AND place < end"), "left")
        .select("key", "node", "place", F.coalesce("label", F.xxhash64(F.lit("alone"), "node", "key")).alias("label"))
        .withColumns({"low": F.min("label").over(group), "high": F.max("label").over(group), "size": F.count(F.lit(1)).over(group)})
    )
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int").alias("blocks")
    members = settled(inside.filter("low <> high").select("key", "node", "place", "label", blocks), "members")
    lists = members.groupBy("node").agg(F.collect_set(F.struct("key", "label", "place", "blocks")).alias("w"))
    carried = settled(lists.select("node", "w.key", "w.label", "w.place", "w.blocks"), "carried")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, found, held, rows = ["a", "b", "a_start", "a_end", "b_start", "b_end"], [], [], 0

        def links(groups: list[dict[str, np.ndarray]]) -> list[tuple]:
            columns = [np.concatenate([g[c] for g in groups]) for c in ("node", "block", "label", "place", "start")]
            around = [np.frombuffer(c, np.uint32) for g in groups for c in g["around"]]
            across = np.array([g["i"][0] != g["j"][0] for g in groups])
            return compare_groups(np.array([len(g["node"]) for g in groups]), *columns, around, shortest, similarity, across)

        for group in _runs(batches, ["key", "i", "j"]):
            n = len(group["node"])
            if n < 2:
                continue
            if n > _MANY:
                found += links([group])
            else:
                held.append(group)
                rows += n
                if rows >= _TOGETHER:
                    found += links(held)
                    held, rows = [], 0
            if len(found) >= _ROWS:
                yield pd.DataFrame(found, columns=names)
                found = []
        yield pd.DataFrame(found + (links(held) if held else []), columns=names)

    def cells(number: int, slices: int) -> DataFrame:
        """The contexts of a slice, for every pair of blocks that a group has there."""

        def cut(nodes: list, words: list, keys: list, labels: list, places: list, blocks: list) -> list[list]:
            out = []
            for node, text, ks, ls, ps, bs in zip(nodes, words, keys, labels, places, blocks):
                own = [k for k in range(len(ks)) if bs[k] > 1 or (ks[k] >> 3) % slices == number]
                if not own:
                    continue
                found = contexts(np.frombuffer(text, np.uint32), [ks[k] for k in own], [ps[k] for k in own], width, shortest, hashes)
                out += [(ks[own[k]], node, ls[own[k]], bs[own[k]], at, start, around) for k, at, start, around in found]
            return [list(c) for c in zip(*out)] if out else [[] for _ in range(7)]

        columns = "key long, node long, label long, blocks int, place int, start int, around binary"
        found = arrow_rows(carried.join(sequences, "node"), cut, columns, "node", "words", "key", "label", "place", "blocks", rows=50)
        found = found.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = found.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        return found.filter((F.col("blocks") == 1) | (F.pmod(F.xxhash64("key", "i", "j"), F.lit(slices)) == number)).drop("blocks", "other")

    held = sequences.agg(F.sum(4 * F.col("n").cast("long"))).first()[0] or 0
    dealt = (members.agg(F.sum("blocks")).first()[0] or 0) * 4 * (2 * (shortest + _GAP) + 1)
    slices = max(1, -(-dealt // max(1, _COPIES * held)))
    rest = None
    for number in range(slices):
        # The exchanges of a slice leave the disks before the next one begins.
        own = cells(number, slices).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node", "place").mapInPandas(compare, schema)
        own = settled(own.distinct(), "passages")
        rest = own if rest is None else rest.unionByName(own)
    if not rest.isEmpty():
        # A context may cut a passage short or do without the rest of a run: whole texts decide.
        more = rest.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
        parts = labelled(links.unionByName(verified(more)).distinct(), sequences)
    # Every copy of a text holds its passages.
    parts = parts.withColumn("tag", F.xxhash64("node"))
    whole = names.withColumn("tag", F.xxhash64("node")).join(parts, ["node", "tag"]).select("doc", "label", "start", "end").distinct()
    per_doc = whole.groupBy("label", "doc").agg(F.lit(1).alias("one"))
    classes = per_doc.groupBy("label").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("n_docs"))
    classes = classes.filter("n_docs > 1").withColumn("tag", F.xxhash64("label"))
    return whole.withColumn("tag", F.xxhash64("label")).join(classes, ["label", "tag"]).select(
        F.col("doc").alias("doc_id"), F.col("start").cast("long").alias("start_word"),
        (F.col("end") + width - 1).cast("long").alias("end_word"), "class_id", "n_docs",
    )


def without_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of the documents that lose passages: each stays in its class's first document only.

    ``found`` are rows of ``repeated_passages``.  Words outside keep their white space.
    """
    gone = found.filter("doc_id <> class_id").groupBy(F.col("doc_id").alias("key"))
    gone = gone.agg(F.collect_set(F.struct("start_word", "end_word")).alias("gone"))
    rows = narrow(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    rows = rows.join(gone, F.col("doc") == F.col("key")).select(
        "doc", "text", F.col("gone.start_word").alias("starts"), F.col("gone.end_word").alias("ends")
    )

    def cut(ids: list, texts: list, starts: list, ends: list) -> list[list]:
        out = []
        for text, first, last in zip(texts, starts, ends):
            words = [m.span() for m in _WORD.finditer(text or "")]
            parts, at = [], 0
            for a, b in sorted(zip(first, last)):
                if a < len(words):
                    parts.append(text[at : max(words[a][0], at)])
                    at = max(words[min(b, len(words)) - 1][1], at)
            out.append("".join([*parts, (text or "")[at:]]))
        return [ids, out]

    return arrow_rows(rows, cut, "doc_id long, text string", "doc", "text", "starts", "ends")
