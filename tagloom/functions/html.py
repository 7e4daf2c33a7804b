"""HTML expressions: a tag-soup contract over native regular expressions.

There is no DOM.  The contract is: comments vanish, script and style bodies are
opaque, tag and attribute names ignore case, attribute values do not, quoted
attribute values may hold ``>``, an unclosed container runs to the end of the
document, navigation, headers and footers end at their own closing tag also if
they are nested, and an entity counts only with its ``;``.

All functions take and return Spark SQL expression text (see ``sql_text``).
Quantifiers are possessive, and whatever opens a tag, comment or element is
consumed even if the document ends inside it: no part of a broken document is
scanned again from each of its ``<`` characters, and the matcher's stack cannot
overflow.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from tagloom.functions.sql_text import (
    extract_all_sql,
    extract_sql,
    present_sql,
    quote,
    replace_sql,
    scan_sql,
    strip_tags_sql,
    trim_sql,
)
from tagloom.functions.text import SPACE_RUN

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""


# A tag ends at its ``>``; with a quote that never closes, at the next ``>``; else with the document.
_TAG_END = rf"(?:{_ATTRS}(?:>|\z)|[^>]*+(?:>|\z))"


def open_tag(name: str) -> str:
    return rf"<{name}(?:>|[\s/]{_TAG_END})"


def until_close(name: str) -> str:
    """Everything up to the closing tag, in runs between ``<`` characters."""
    return rf"(?:[^<]++|<(?!/{name}\s*>))*+"


def element(names: str, group: int) -> str:
    """Whole element, without its ``<``; unclosed means up to the document end.

    ``names`` are alternatives; ``group`` is the number their capture gets.
    """
    tag = rf"({names})(?:>|[\s/]{_TAG_END})"
    return rf"{tag}{until_close(chr(92) + str(group))}(?:</\{group}\s*>|\z)"


# All alternatives share their first character, so text between tags is skipped
# at the cost of one comparison per character.  Whichever construct opens first
# wins: a comment marker inside a script is script text and vice versa.
_COMMENT = r"!--(?:[^-]++|-(?!->))*+(?:-->|\z)"
OPAQUE = rf"(?is)<(?:{_COMMENT}|{element('script|style', 1)})"
# Containers that are no part of the main text.
_FURNITURE = "nav|footer|header"
PAGE_FURNITURE = rf"(?is)<{element(_FURNITURE, 1)}"
# Such a container, up to its first closing tag, that opens its own kind again.
OPENS_AGAIN = rf"(?is)^<({_FURNITURE})(?:>|[\s/]{_TAG_END}).*<\1[\s/>]"
FURNITURE_OPEN = rf"(?i)^<({_FURNITURE})[\s/>]"
FURNITURE_CLOSE = rf"(?i)^</({_FURNITURE})\s*>\z"
# The document as tags of these containers and the stretches between them.
FURNITURE_TOKEN = (
    rf"(?is)<(?:{_FURNITURE})(?:>|[\s/]{_TAG_END})|</(?:{_FURNITURE})\s*>"
    rf"|(?:[^<]++|<(?!(?:{_FURNITURE})[\s/>]|/(?:{_FURNITURE})\s*>))++"
)
ANY_TAG = rf"(?is)<[a-z/!?]{_TAG_END}"
PARAGRAPH_START = r"(?i)<p(?:>|\s[^>]*+(?:>|\z))"
# Tags whose start or end closes an open paragraph.
BLOCK_TAGS = (
    "p div article section main aside ul ol li dl table h[1-6] nav footer "
    "header form body html blockquote pre"
)
BLOCK_BOUNDARY = rf"(?is)</?(?:{'|'.join(BLOCK_TAGS.split())})\b.*\z"
# Tried once per run of name characters, at the first one that may begin a name.
ATTRIBUTE = (
    r"""(?<![-A-Za-z0-9_:.])[-0-9.]*+([A-Za-z_:][-A-Za-z0-9_:.]*+)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
)
HEAD_END = r"(?is)</head\s*>(.*)\z"
ENTITY = r"^(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"

# Length for slices to the end (no second evaluation of the array for its size).
ALL = 1_000_000_000

# HTML 4 entity names (the standard library's table) plus ``apos``.
NAMED_ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


# One literal that constant folding turns into a map.
ENTITY_TABLE = f"from_json({quote(json.dumps(NAMED_ENTITIES))}, 'map<string,string>')"


def decode_numeric(name: str) -> str:
    """Character of ``#123`` / ``#x7b``; numbers that are no character vanish.

    No code point has more than six hexadecimal digits; ``conv`` would fail on long ones.
    """
    hexadecimal = f"ltrim('0', substring({name}, 3))"
    code = (
        f"try_cast(CASE WHEN substring({name}, 2, 1) NOT IN ('x', 'X') THEN substring({name}, 2) "
        f"WHEN length({hexadecimal}) <= 6 THEN conv({hexadecimal}, 16, 10) END AS bigint)"
    )
    return f"""get(transform(array({code}), code -> CASE
        WHEN code IN (9, 10, 13) OR code BETWEEN 32 AND 55295
          OR code BETWEEN 57344 AND 65533 OR code BETWEEN 65536 AND 1114111
        THEN decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32') ELSE '' END), 0)"""


def decode_entities(x: str) -> str:
    """Decode named and numeric entities once, natively.

    The text is split at ``&``; each later piece either starts with a known
    entity, which is replaced, or gets its ``&`` back.
    """
    names = f"""transform(slice(split({x}, '&', -1), 2, {ALL}),
        p -> struct(p AS text, {extract_sql('p', ENTITY, 1)} AS name))"""
    chars = f"""transform({names}, p -> struct(p.text AS text, length(p.name) AS skip, CASE
        WHEN p.name = '' THEN NULL
        WHEN startswith(p.name, '#') THEN {decode_numeric('p.name')}
        ELSE try_element_at({ENTITY_TABLE}, p.name) END AS char))"""
    rendered = f"""transform({chars}, p -> CASE
        WHEN p.char IS NULL THEN concat('&', p.text)
        ELSE concat(p.char, substring(p.text, p.skip + 2)) END)"""
    return f"""CASE WHEN contains({x}, '&')
        THEN concat(get(split({x}, '&', -1), 0), array_join({rendered}, ''))
        ELSE {x} END"""


def drop_tags(x: str) -> str:
    return replace_sql(x, ANY_TAG)


def markup_of(html: str) -> str:
    """The document without comments, scripts and styles."""
    return replace_sql(f"coalesce({html}, '')", OPAQUE)


def attribute(attrs: str, name: str) -> str:
    """Value of the first attribute with that name; NULL when absent."""
    raw = f"get({attrs}.raws, cast(array_position({attrs}.names, {quote(name)}) AS int) - 1)"
    return f"""CASE WHEN startswith({raw}, '"') OR startswith({raw}, {quote("'")})
        THEN substring({raw}, 2, length({raw}) - 2) ELSE {raw} END"""


def parse_attributes(tag: str) -> str:
    """``STRUCT<names, raws>``: lower-case names and still quoted values."""
    return f"""struct(transform({extract_all_sql(tag, ATTRIBUTE, 1)}, n -> lower(n)) AS names,
        {extract_all_sql(tag, ATTRIBUTE, 2)} AS raws)"""


def tag_attributes(markup: str, name: str, needs: str, fields: tuple[str, ...]) -> str:
    """The named attributes of every ``<name …>`` tag that mentions ``needs``."""
    tags = extract_all_sql(markup, rf"(?is){open_tag(name)}")
    wanted = f"filter({tags}, t -> endswith(t, '>') AND t RLIKE {quote(rf'(?i){needs}\s*=')})"
    parsed = f"transform({wanted}, t -> {parse_attributes('t')})"
    columns = ", ".join(f"{attribute('a', f)} AS `{f}`" for f in fields)
    return f"transform({parsed}, a -> struct({columns}))"


def inner_pattern(name: str) -> str:
    return rf"(?is){open_tag(name)}({until_close(name)})"


def element_text(markup: str, name: str) -> str:
    """Undecoded, untagged text of the first element of that name."""
    return drop_tags(extract_sql(markup, inner_pattern(name), 1))


def _clean_texts(texts: str) -> str:
    return f"filter(transform({texts}, t -> {trim_sql('t')}), t -> {present_sql('t')})"


def element_texts(markup: str, name: str) -> str:
    """Decoded, trimmed, non-empty texts of all elements of that name."""
    inner = extract_all_sql(markup, inner_pattern(name), 1)
    plain = f"transform({inner}, t -> {drop_tags('t')})"
    return _clean_texts(f"transform({plain}, t -> {decode_entities('t')})")


def paragraph_texts(markup: str, longer_than: int) -> str:
    """Decoded texts of paragraphs longer than the bound (before trimming).

    Decoding only shrinks a text, so pieces whose markup is already too short
    are dropped before it.
    """
    pieces = f"split({markup}, {quote(PARAGRAPH_START)}, -1)"
    bodies = f"filter(slice({pieces}, 2, {ALL}), p -> length(p) > {longer_than})"
    cut = f"transform({bodies}, p -> {replace_sql('p', BLOCK_BOUNDARY)})"
    plain = f"transform({cut}, p -> CASE WHEN contains(p, '<') THEN {drop_tags('p')} ELSE p END)"
    plain = f"filter({plain}, p -> length(p) > {longer_than})"
    texts = f"transform({plain}, p -> {decode_entities('p')})"
    return _clean_texts(f"filter({texts}, p -> length(p) > {longer_than})")


def _balanced(markup: str) -> str:
    """What lies outside the containers, each closed by its own closing tag.

    One pass over the tokens with the outermost open container and its depth; other
    containers inside it, and closing tags that close nothing, do not count.
    """
    tokens = f"""transform({extract_all_sql(markup, FURNITURE_TOKEN)}, t -> struct(t AS text,
        lower({extract_sql('t', FURNITURE_OPEN, 1)}) AS opens, lower({extract_sql('t', FURNITURE_CLOSE, 1)}) AS closes))"""

    def step(s: str, t: str) -> str:
        return f"""struct(
          CASE WHEN {s}.outer = '' THEN {t}.opens WHEN {t}.closes = {s}.outer AND {s}.depth = 1 THEN '' ELSE {s}.outer END AS outer,
          CASE WHEN {s}.outer = '' THEN cast({t}.opens <> '' AS int) WHEN {t}.opens = {s}.outer THEN {s}.depth + 1
            WHEN {t}.closes = {s}.outer THEN {s}.depth - 1 ELSE {s}.depth END AS depth)"""

    kept = scan_sql("tokens", "struct('' AS outer, 0 AS depth)", step, lambda s, t: f"{s}.outer = '' AND {t}.opens = ''", "boolean")
    outside = f"""get(transform(array({kept}), kept ->
        array_join(transform(filter(tokens, (t, k) -> get(kept, k)), t -> t.text), '')), 0)"""
    return f"get(transform(array({tokens}), tokens -> {outside}), 0)"


def without_furniture(markup: str) -> str:
    """The document without navigation, headers and footers, however deep they are nested.

    A pattern does for documents whose containers do not contain their own kind.
    """
    nested = f"exists({extract_all_sql(markup, PAGE_FURNITURE, 0)}, e -> e RLIKE {quote(OPENS_AGAIN)})"
    return f"""CASE WHEN {nested} THEN {_balanced(markup)}
        ELSE {replace_sql(markup, PAGE_FURNITURE)} END"""


def body_markup(plain: str) -> str:
    """Inside of the first ``<body>`` of a document without furniture.

    Without that tag, which is optional, the body is what follows the head: the
    document behind ``</head>``, or without the title where that is left out too.
    """
    behind = f"""CASE WHEN {plain} RLIKE {quote(HEAD_END)} THEN {extract_sql(plain, HEAD_END, 1)}
        ELSE {replace_sql(plain, rf'(?is)<{element("title", 1)}')} END"""
    return f"""CASE WHEN {plain} RLIKE {quote(r'(?i)<body[\s/>]')}
        THEN {extract_sql(plain, inner_pattern("body"), 1)} ELSE {behind} END"""


def flatten_text(decoded: str) -> str:
    """Single-spaced text; tag-like runs that decoding produced vanish too."""
    stripped = f"CASE WHEN contains({decoded}, '<') THEN {strip_tags_sql(decoded)} ELSE {decoded} END"
    return replace_sql(stripped, SPACE_RUN, " ")


def script_blocks(html: str, media_type: str) -> str:
    """Bodies of ``<script type=…>`` elements in document order.

    Most documents have none: a plain substring test spares them the scan.
    """
    scripts = f"""filter({extract_all_sql(html, OPAQUE)},
        s -> s RLIKE {quote(r'(?i)^<script[\s/]')} AND contains(s, {quote(media_type)}))"""
    split = f"""transform({scripts}, s -> struct(
        {parse_attributes(extract_sql('s', rf"(?is)^{open_tag('script')}"))} AS attrs,
        {extract_sql('s', rf"(?is)^{open_tag('script')}(.*?)(?:</script\s*>)?\z", 1)} AS body))"""
    typed = f"filter({split}, s -> {attribute('s.attrs', 'type')} = {quote(media_type)})"
    return f"""CASE WHEN contains({html}, {quote(media_type)})
        THEN transform({typed}, s -> s.body) ELSE cast(array() AS array<string>) END"""
