"""Positions of pattern matches as column expressions, in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.sql_text import scan_sql

_RUN = 256
SPAN = "array<struct<kind:string,rank:int,start:long,end:long,value:string>>"


def nothing() -> Column:
    return F.array().cast(SPAN)


def _struct(kind: str, rank: int, start: Column, end: Column, value: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), end.alias("end"),
        value.alias("value"),
    )


def matches(text: Column, kind: str, rank: int, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches with their spans; ``value`` is the given group.

    The pieces between matches come from ``split`` with the same pattern, so
    spans are running sums of lengths.  They are summed in runs of 256 and the
    runs then shifted: appending to one long array would be quadratic.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(whole.alias("w"), values.alias("v"), F.slice(gaps, F.lit(1), F.size(whole)).alias("g"))
    parts = F.transform(
        zipped, lambda x: F.struct(
            F.length(x["g"]).cast("long").alias("gap"), F.length(x["w"]).cast("long").alias("len"), x["v"].alias("value")
        )
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), nothing().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(_struct(kind, rank, begin, end, x["value"]))).alias("out"))

    def runs(p: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _RUN).cast("int"))
        return F.transform(numbers, lambda i: F.aggregate(F.slice(p, i * _RUN + 1, F.lit(_RUN)), start, step))

    def shift(acc: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda y: _struct(kind, rank, y["start"] + acc["at"], y["end"] + acc["at"], y["value"]))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    # ``parts`` is bound once, as the only element of an array, and not computed again for each use.
    folded = F.transform(F.array(parts), lambda p: F.aggregate(runs(p), start, shift)["out"])[0]
    return F.when(text.rlike(pattern), folded).otherwise(nothing())


def ordered(spans: Column) -> Column:
    """By start, then by the rank of the kind, then by end."""
    keyed = F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"], x["value"]))
    return F.transform(
        F.array_sort(keyed), lambda x: F.struct(x["kind"], x["rank"], x["start"], x["end"], x["value"])
    )


def outside(words: str, spans: str) -> str:
    """SQL: the spans of ``words`` that overlap none of ``spans``, as ``struct<start, word, end, value>``.

    Both are put into one order and passed once; a word is also dropped if the next span
    begins inside it.
    """
    events = f"""array_sort(concat(
        transform({spans}, b -> struct(b.start AS start, false AS word, b.end AS end, '' AS value)),
        transform({words}, w -> struct(w.start AS start, true AS word, w.end AS end, w.value AS value))))"""
    reach = scan_sql(
        "events", "-1L", lambda s, e: f"CASE WHEN {e}.word THEN {s} ELSE greatest({s}, {e}.end) END", lambda s, e: s, "bigint"
    )
    free = """e.word AND e.start >= get(reach, k)
        AND NOT coalesce(NOT get(events, k + 1).word AND e.end > get(events, k + 1).start, false)"""
    found = f"get(transform(array({reach}), reach -> filter(events, (e, k) -> {free})), 0)"
    return f"get(transform(array({events}), events -> {found}), 0)"


def named(words: str, names: str, kind: str, rank: int) -> str:
    """SQL: spans of the ``words`` whose value is a key of ``names``, entries of (key, value).

    Names with a true value mark their words by a leading ``-``.  Sorted by value a name
    stands before its words, a true one last, so one pass finds them.
    """
    events = f"""array_sort(concat(
        transform({names}, n -> struct(n.key AS value, -1L AS start, -1L AS end, n.value AS gone)),
        transform({words}, w -> struct(w.value AS value, w.start AS start, w.end AS end, false AS gone))))"""
    last = scan_sql(
        "events", "struct('' AS name, false AS gone)",
        lambda s, e: f"CASE WHEN {e}.start < 0 THEN struct({e}.value AS name, {e}.gone AS gone) ELSE {s} END",
        lambda s, e: s, "struct<name: string, gone: boolean>",
    )
    made = f"""struct('{kind}' AS kind, {rank} AS rank, m.e.start AS start, m.e.end AS end,
        CASE WHEN m.l.gone THEN concat('-', m.e.value) ELSE m.e.value END AS value)"""
    paired = "transform(events, (e, k) -> struct(e AS e, get(last, k) AS l))"
    found = f"transform(filter({paired}, m -> m.e.start >= 0 AND m.e.value = m.l.name), m -> {made})"
    return f"get(transform(array({events}), events -> get(transform(array({last}), last -> {found}), 0)), 0)"


def listed(spans: Column) -> Column:
    """``kind:start:end`` of ordered spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def digest(spans: Column) -> Column:
    return F.sha2(listed(spans).cast("binary"), 256)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
