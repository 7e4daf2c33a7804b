"""Text expressions: emptiness rules, trimming and length-bounded rewriting.

Everything returns a native ``Column``; nothing here leaves the JVM.  Lengths
and positions count Unicode code points.  The patterns avoid look-around so the
same semantics can be checked with an RE2 engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a plain trim removes (no NBSP, no form feed).
TRIM_CHARS = " \t\n\r\0\x0b"

# Fixed value: characters dropped from the end of a word-cut text.
TAIL_CHARS = " .,;:\\-–—"

# Delimiters a long text may be cut at, in priority order.
CUT_DELIMITERS = ("|", "–", "—", ":", " - ", ",")

# Words that must not end a word-cut text (German, English).
STOPWORDS = tuple(
    """
    seit für mit und oder von zu zur zum bei der die
    das den dem des ein eine einer einen im am an auf
    als wie aus nach vor über unter durch ohne gegen um
    since for with and or of to the a an at on in
    as by from into about than that this
    """.split()
)

# Domain endings dropped from a brand name, in this order.
BRAND_ENDINGS = (".de", ".com", ".net", ".org")

# Whitespace to be replaced by one space: all runs but a single space itself.
SPACE_RUN = r"[\t\n\x0B\f\r]\s*+| \s++"
TAG_LIKE = r"<(?:>|[^\s>][^>]*+(?:>|\z))"


def to_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def falsy(c: Column | str) -> Column:
    """NULL, the empty string and ``'0'`` all count as "no value"."""
    c = to_col(c)
    return c.isNull() | c.isin("", "0")


def trimmed(c: Column | str) -> Column:
    return F.btrim(to_col(c), F.lit(TRIM_CHARS))


def right_trimmed(c: Column | str) -> Column:
    return F.rtrim(to_col(c), F.lit(TRIM_CHARS))


def strip_tags(c: Column | str) -> Column:
    """Drop tag-like runs; ``< `` is text, an unclosed tag runs to the end."""
    c = to_col(c)
    return F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, TAG_LIKE, "")).otherwise(c)


def collapse_whitespace(c: Column | str) -> Column:
    return F.regexp_replace(to_col(c), SPACE_RUN, " ")


def last_position(c: Column | str, needle: str) -> Column:
    """0-based position of the last occurrence; negative when absent."""
    c = to_col(c)
    tail = F.substring_index(c, needle, -1)
    return F.length(c) - F.length(tail) - F.lit(len(needle))


def brand_name(domain: Column | str) -> Column:
    name = to_col(domain)
    for ending in BRAND_ENDINGS:
        name = F.replace(name, F.lit(ending), F.lit(""))
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))


def optimize_title(raw: Column | str, domain: Column | str) -> Column:
    """Strip the brand suffix, cut hard above 60, pad with the brand below 30."""
    stem = trimmed(F.regexp_replace(to_col(raw), r"\s*[|\-–]\s*[^|\-–]+\z", ""))
    return (
        F.when(F.length(stem) > 60, F.concat(F.substring(stem, 1, 57), F.lit("…")))
        .when(F.length(stem) < 30, F.concat(stem, F.lit(" – "), brand_name(domain)))
        .otherwise(stem)
    )


def flat_text(text: Column | str) -> Column:
    return collapse_whitespace(strip_tags(text))


def build_description(text: Column | str) -> Column:
    """Whole sentences up to 160 characters, else the first 155 characters.

    Sentences are taken from the front until one would overflow, and after
    collapsing they are joined by the very spaces that separated them.  The
    packed text is therefore the longest prefix that ends a sentence and has at
    most 159 characters (one is spent on the joining space), which a single
    greedy match finds without building a sentence array.
    """
    flat = flat_text(text)
    packed = trimmed(
        F.when(F.length(flat) <= 159, flat).otherwise(
            F.regexp_extract(F.substring(flat, 1, 160), r"(?s)^(.*[.!?]) ", 1)
        )
    )
    return F.when(falsy(packed), F.substring(flat, 1, 155)).otherwise(packed)


def repeat_description(flat: str, times: str) -> Column:
    """``build_description`` of a text that is listed ``times`` times: each sentence follows itself.

    ``flat`` names a column with the first 160 characters of the flat text.
    """
    pieces = rf"""filter(split(regexp_replace({flat}, '([.!?]) ', '$1\u0001'), '\u0001'), s -> s <> '')"""
    packed = trimmed(
        F.expr(
            f"""aggregate({pieces}, struct(0L AS n, '' AS o), (a, s) -> struct(
                a.n + {times} * (length(s) + 1) AS n,
                CASE WHEN a.n + {times} * (length(s) + 1) <= 160 THEN concat(a.o, repeat(concat(s, ' '), cast({times} AS int))) ELSE a.o END AS o), a -> a.o)"""
        )
    )
    return F.when(falsy(packed), F.substring(flat, 1, 155)).otherwise(packed)


def _drop_tail_stopwords(c: Column) -> Column:
    words = "|".join(dict.fromkeys(STOPWORDS))
    return F.regexp_replace(c, rf"(?iu)(?:[{TAIL_CHARS}]* (?:{words}))+\z", "")


def trim_to_length(text: Column | str, limit: int) -> Column:
    """Shorten to ``limit`` characters at the most natural place.

    Sentence end past half of the limit, else the first delimiter (by priority)
    whose last occurrence lies past 40 %, else a word boundary followed by "…".
    """
    text = to_col(text)
    head = F.substring(text, 1, limit)

    sentence = F.length(F.regexp_extract(head, r"(?s)^(.*)[.!?]", 1))
    by_delimiter = F.coalesce(
        *[
            F.when(
                last_position(head, d) > limit * 0.4,
                right_trimmed(F.left(text, last_position(head, d))),
            )
            for d in CUT_DELIMITERS
        ]
    )

    short = F.substring(text, 1, limit - 1)
    space = last_position(short, " ")
    at_word = F.when(space > (limit - 1) * 0.6, F.left(short, space)).otherwise(short)
    at_word = F.regexp_replace(at_word, rf"[{TAIL_CHARS}]+\z", "")
    by_word = F.concat(_drop_tail_stopwords(at_word), F.lit("…"))

    return (
        F.when(F.length(text) <= limit, text)
        .when(sentence > limit * 0.5, trimmed(F.left(text, sentence + 1)))
        .otherwise(F.coalesce(by_delimiter, by_word))
    )
