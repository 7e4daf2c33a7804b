"""Strict JSON checks on text.

Spark's JSON readers stop at the end of the first value, so trailing garbage
would go unnoticed.  The text is therefore read as the first element of an
array that ends with a sentinel, and once more as the only member of an object:
it is one valid JSON value exactly when the array has two elements, the second
one is the sentinel, and the object has that one member.  A text that closes the
array by itself breaks the object.
"""

from __future__ import annotations

from tagloom.functions.sql_text import quote

_SENTINEL = "~end of value~"
_STRICT = "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"

FALSY_JSON = (
    r'^\s*(?:\{\s*\}|\[\s*\]|-?0(?:\.0+)?(?:[eE][+-]?[0-9]+)?|"0?"|null|false)\s*\z'
)


def is_valid_json(x: str) -> str:
    wrapped = f"concat('[', {x}, {quote(f',"{_SENTINEL}"]')})"
    parts = f"array(from_json({wrapped}, 'array<string>', {_STRICT}))"
    member = f"""from_json(concat('{{"v":', {x}, '}}'), 'map<string,string>', {_STRICT})"""
    # Bound once through the lambda, so each form is parsed once.
    listed = f"""coalesce(get(transform({parts},
        v -> size(v) = 2 AND get(v, 1) = '{_SENTINEL}'), 0), false)"""
    return f"({listed} AND coalesce(size({member}) = 1, false))"


def is_falsy_json(x: str) -> str:
    """Empty object or list, zero, empty or ``"0"`` string, null and false."""
    return f"({x} RLIKE {quote(FALSY_JSON)})"


def has_json_value(x: str) -> str:
    """Valid JSON that is not empty; false (never NULL) for a NULL text."""
    return f"coalesce(NOT {is_falsy_json(x)} AND {is_valid_json(x)}, false)"
