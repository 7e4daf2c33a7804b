"""Small helpers to compose Spark SQL expression text.

Expressions with nested lambdas are cheaper to hand over as text: one parser
call instead of thousands of driver round trips to build the same tree.
"""

from __future__ import annotations

from collections.abc import Callable

from tagloom.functions.text import TAG_LIKE, TRIM_CHARS


def quote(text: str) -> str:
    """A Spark SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\u0000"), ("\x0b", "\\u000B")):
        escaped = escaped.replace(char, code)
    return f"'{escaped}'"


def trim_sql(x: str) -> str:
    return f"btrim({x}, {quote(TRIM_CHARS)})"


def present_sql(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} NOT IN ('', '0'))"


def replace_sql(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(by)})"


def extract_sql(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {quote(pattern)}, {group})"


def extract_all_sql(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {quote(pattern)}, {group})"


def strip_tags_sql(x: str) -> str:
    return replace_sql(x, TAG_LIKE)


_RUN = 256


def scan_sql(items: str, state: str, step: Callable[[str, str], str], out: Callable[[str, str], str], kind: str) -> str:
    """One value per element of the array ``items``: ``out`` of the state before it and the element.

    ``state`` is a small struct that ``step`` carries on.  An accumulator is copied at every
    step, so results are not gathered in one: states are kept at every 256th element, and
    each such run is then worked off with a list of its own.  ``items`` names a column or a
    lambda variable, ``kind`` is the type of ``out``.
    """
    runs = f"sequence(0, cast(greatest(size({items}) - 1, 0) div {_RUN} AS int))"
    run = f"slice({items}, i * {_RUN} + 1, {_RUN})"
    starts = f"""aggregate({runs}, array({state}), (z, i) -> concat(z, array(
        aggregate({run}, element_at(z, -1), (s, e) -> {step('s', 'e')}))))"""
    each = f"""aggregate({run}, struct(get(z, i) AS s, cast(array() AS array<{kind}>) AS o),
        (a, e) -> struct({step('a.s', 'e')} AS s, concat(a.o, array({out('a.s', 'e')})) AS o), a -> a.o)"""
    return f"get(transform(array({starts}), z -> flatten(transform({runs}, i -> {each}))), 0)"
