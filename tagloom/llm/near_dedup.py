"""Near-duplicate documents by one-permutation MinHash.

A document is its set of distinct word shingles.  One hash spreads the set over
``bands * rows`` bins, the smallest value of each is kept, and empty bins borrow
from bins chosen by a hash of their number (optimal densification).  Documents
with equal sets are one node.  Nodes that agree on all bins of a band share a
bucket; each bucket is a star: its busiest member is compared with every other,
so candidates grow with the rows and not with the square of a group.  Every
candidate is confirmed on the full sets: ``100 * both >= similarity * either``.

A star alone could miss two members that resemble each other but not its
centre.  So components are formed and every bucket that still spans several of
them is compared in full, inside tasks of bounded blocks that return only the
links of a spanning forest.  No bucket or partner is capped.

With 40 bands of 6 a pair at similarity 0.8 shares no bucket with probability
0.74 ** 40, about 5e-6.  Bins of small sets repeat each other, so sets of up to 14
shingles are bucketed exactly, by what is left of them without one or two members,
and sets of up to 48 have a second sketch.

Defined results: a text without words has an empty set and links with nothing;
a text with fewer words than a shingle is one shingle; rows that repeat a doc_id
are one document; null doc_ids take the component of equal texts, alone null.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import arrow_rows, narrow, written
from tagloom.llm.graph import components
from tagloom.llm.shingles import mixed, shingle_set
from tagloom.operators.joins import lookup

BANDS, ROWS = 40, 6
_BLOCK = 256
_SMALL, _FEW = 14, 48
_TRIES = 16
_COLUMNS = 1 << 14


@lru_cache(maxsize=4)
def _probes(bins: int) -> np.ndarray:
    """Bins to borrow from: per bin a fixed row of choices, equal for all documents."""
    numbers = np.arange(bins * (_TRIES + 1), dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03)
    return (mixed(mixed(numbers)) % np.uint64(bins)).astype(np.int64).reshape(bins, _TRIES + 1)


def sketch(codes: np.ndarray, bins: int) -> np.ndarray:
    """Smallest value per bin of ascending distinct codes, empty bins densified."""
    values = np.sort(mixed(codes ^ np.uint64(0xA0761D6478BD642F)))
    place = ((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    filled, out = place[first].astype(np.int64), np.zeros(bins, np.uint64)
    out[filled] = values[first]
    if len(filled) == bins:
        return out
    has = np.zeros(bins, bool)
    has[filled] = True
    probes, source = _probes(bins), np.arange(bins)
    empty = np.flatnonzero(~has)
    for t in range(_TRIES):
        choice = probes[empty, t]
        good = has[choice]
        source[empty[good]] = choice[good]
        empty = empty[~good]
        if not len(empty):
            break
    if len(empty):
        # Few bins are filled: the next filled one after a last chosen place.
        after = np.searchsorted(filled, probes[empty, _TRIES])
        source[empty] = filled[after % len(filled)]
    return out[source]


def band_keys(codes: np.ndarray, bands: int, rows: int, sketch_number: int = 0) -> list[int]:
    values = sketch(codes ^ np.uint64(0x632BE59BD9B4E019 * sketch_number & 0xFFFFFFFFFFFFFFFF), bands * rows).reshape(bands, rows)
    keys = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(0x8EBC6AF09C88C6E3 + sketch_number * bands))
    for i in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
    return keys.view(np.int64).tolist()


def small_keys(codes: np.ndarray) -> list[int]:
    """Keys of the set and of the set without one or two of its members.

    Sets of up to ``_SMALL`` shingles at similarity 0.8 or more become equal when
    each loses at most two members, so they share a key for certain.
    """
    parts = mixed(codes ^ np.uint64(0x3C6EF372FE94F82B))
    total = parts.sum(dtype=np.uint64)
    one, two = np.triu_indices(len(codes), 1)
    sums = np.concatenate([total[None], total - parts, total - parts[one] - parts[two]])
    left = np.concatenate([[0], np.ones(len(codes)), np.full(len(one), 2)]).astype(np.uint64)
    return np.unique(mixed(sums ^ mixed(np.uint64(len(codes)) - left))).view(np.int64).tolist()


def bucket_keys(codes: np.ndarray, bands: int, rows: int, similarity: int) -> list[int]:
    """Small sets by what is left of them, others by bands; sets near the limit by both."""
    small = similarity >= 80 and len(codes) <= _SMALL
    keys = small_keys(codes) if small else []
    if not small or 100 * len(codes) >= similarity * (_SMALL + 1):
        for number in range(1 if len(codes) > _FEW else 2):
            keys += band_keys(codes, bands, rows, number)
    return keys


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, similarity: int) -> DataFrame:
    """(doc_id, n, set_key, keys): the size of the set, its digest and its bucket keys."""

    def make(ids: list, texts: list) -> list[list]:
        sets = [shingle_set(t, width) for t in texts]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
        return [ids, [len(s) for s in sets], digests, [bucket_keys(s, bands, rows, similarity) if len(s) else [] for s in sets]]

    source = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return arrow_rows(source, make, "doc_id long, n long, set_key string, keys array<long>", "doc_id", "text")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the common codes."""
    codes = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    unique, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
    common = counts > 1
    number = np.cumsum(common) - 1
    keep = common[place]
    owner, column = owner[keep], number[place[keep]]
    total = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(common.sum()), _COLUMNS):
        part = slice(*np.searchsorted(column, [start, start + _COLUMNS]))
        grid = np.zeros((len(sets), min(_COLUMNS, int(common.sum()) - start)), np.float32)
        grid[owner[part], column[part] - start] = 1
        total += grid @ grid.T
    return total


def forest(ids: list[int], labels: list[int], sets: list[np.ndarray], similarity: int) -> list[tuple[int, int]]:
    """Links between members of different components: enough of them to join what is linked."""
    sizes = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    linked = np.triu(100 * both >= similarity * (sizes[:, None] + sizes[None, :] - both), 1)
    root = {label: label for label in labels}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        one, two = top(labels[i]), top(labels[j])
        if one != two:
            root[one] = two
            found.append((ids[i], ids[j]))
    return found


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in sorted batches, whole across batch borders."""
    held: list[pd.DataFrame] = []
    for frame in batches:
        if not len(frame):
            continue
        values = [frame[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        edges = [0, *change.tolist(), len(frame)]
        for n, (start, end) in enumerate(zip(edges, edges[1:])):
            part = frame.iloc[start:end]
            if n == 0 and held and all(held[-1][k].iloc[0] == part[k].iloc[0] for k in keys):
                held.append(part)
                continue
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held = [part]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def confirmed(edges: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def test(a: list, b: list, first: list, second: list) -> list[list]:
        keep = [[], []]
        for x, y, s, t in zip(a, b, first, second):
            one, two = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            if 100 * min(len(one), len(two)) < similarity * max(len(one), len(two)):
                continue
            both = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * both >= similarity * (len(one) + len(two) - both):
                keep[0].append(x)
                keep[1].append(y)
        return keep

    joined = (
        edges.join(sets.select(F.col("rep").alias("a"), F.col("codes").alias("first")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("codes").alias("second")), "b")
    )
    return arrow_rows(joined, test, "a long, b long", "a", "b", "first", "second")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: int = 80,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = written(signatures(docs, id_col, text_col, width, bands, rows, similarity), "signatures")
    full = signed.filter("n > 0")
    nodes = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    nodes = written(nodes.filter("rep IS NOT NULL"), "nodes")
    tagged = nodes.withColumnsRenamed({"rep": "r", "set_key": "k"})
    one_each = full.join(tagged, (F.col("doc_id") == F.col("r")) & (F.col("set_key") == F.col("k")), "left_semi")

    # Rows of buckets with more than one node.
    cells = one_each.select(F.explode("keys").alias("bucket"), F.col("doc_id").alias("rep"))
    shared = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(lookup(cells, shared, "bucket", "inner"), "members")
    busy = members.groupBy("rep").agg(F.sum("size").alias("busy"))
    centre = (
        members.join(busy, "rep").groupBy("bucket")
        .agg(F.max(F.struct("busy", (-F.col("rep")).alias("minus"))).alias("m"))
        .select("bucket", (-F.col("m.minus")).alias("a"))
    )
    stars = lookup(members, centre, "bucket", "inner").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()

    wanted = members.select(F.col("rep").alias("key")).distinct()
    texts = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = texts.join(wanted, F.col("doc_id") == F.col("key"), "left_semi")
    sets = arrow_rows(
        texts, lambda ids, values: [ids, [shingle_set(t, width).tobytes() for t in values]], "rep long, codes binary",
        "doc_id", "text",
    )
    sets = written(sets, "sets")
    links = written(confirmed(stars, sets, similarity), "links")
    labels = components(links)

    # Buckets that still span components; equal buckets of several bands are one.
    label = F.coalesce("label", "rep").alias("label")
    labelled = members.join(labels, F.col("rep") == F.col("node"), "left").select("bucket", "rep", label)
    mixed_up = (
        labelled.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"),
            F.min("rep").alias("least"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"),
        )
        .filter("low <> high").groupBy("size", "least", "sum").agg(F.min("bucket").alias("bucket"))
        .select("bucket", F.ceil(F.col("size") / _BLOCK).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    blocks = (
        labelled.join(mixed_up, "bucket").withColumn("block", block).withColumn("other", F.explode(other))
        .select("bucket", "rep", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["bucket", "i", "j"]):
            codes = [np.frombuffer(c, np.uint64) for c in group["codes"]]
            found = forest(group["rep"].tolist(), group["label"].tolist(), codes, similarity)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    rest = (
        blocks.join(sets, "rep").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        .mapInPandas(compare, "a long, b long")
    )
    rest = written(rest, "links")
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))
    labels = labels.withColumnRenamed("node", "rep").withColumn("tag", F.xxhash64("rep"))

    named = nodes.withColumn("tag", F.xxhash64("rep")).join(labels, ["rep", "tag"], "left")
    named = named.select("set_key", F.coalesce("label", "rep").alias("component_id"), F.xxhash64("set_key").alias("tag"))
    joined = full.select("doc_id", "n", "set_key", F.xxhash64("set_key").alias("tag")).join(named, ["set_key", "tag"], "left")
    joined = joined.select("doc_id", "n", "component_id")
    empty = signed.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return joined.unionByName(empty).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept")
    )
