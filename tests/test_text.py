import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions.errors import error_code, is_transient, key_of_address
from tagloom.functions.text import (
    STOPWORDS,
    build_description,
    collapse_whitespace,
    optimize_title,
    strip_tags,
    trim_to_length,
    trimmed,
)


def column(spark, values, make):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


TITLES = [
    ("Handmade Leather Wallets | Shop", "www.developer.com", "Handmade Leather Wallets – Wwwveloper"),
    ("E-Mail Marketing", "example.de", "E – Example"),
    ("", "example.com", " – Example"),
    ("A" * 61, "x.de", "A" * 57 + "…"),
    ("Foo |", "x.de", "Foo | – X"),
    ("One | Two | Three words here to make this long enough", "x.de", "One | Two – X"),
    ("Thirty characters exactly here", "x.de", "Thirty characters exactly here"),
]


def test_optimize_title(spark):
    df = spark.createDataFrame(TITLES, "raw string, domain string, want string")
    for row in df.withColumn("got", optimize_title("raw", "domain")).collect():
        assert row.got == row.want


DESCRIPTIONS = [
    ("One. Two! Three?", "One. Two! Three?"),
    ("x" * 200, "x" * 155),
    ("Short one. " + "y" * 150 + ". Tail.", "Short one."),
    ("A" * 99 + ". " + "B" * 57 + ".", "A" * 99 + ". " + "B" * 57 + "."),
    ("A" * 99 + ". " + "B" * 58 + ".", "A" * 99 + "."),
    ("0", "0"),
    ("", ""),
    (" <b>Lead.</b>\n\n Next. ", "Lead. Next."),
]


def test_build_description(spark):
    got = column(spark, [t for t, _ in DESCRIPTIONS], build_description)
    assert got == [w for _, w in DESCRIPTIONS]


TRIMS = [
    (
        "Discover our range of shoes for men. And a lot more words that follow here",
        "Discover our range of shoes for men.",
    ),
    (
        "Winter jackets, hats, gloves and scarves for the whole family now",
        "Winter jackets, hats, gloves and scarves for the whole…",
    ),
    (
        "Winterjacken und Handschuhe und Schals für die ganze liebe Familie",
        "Winterjacken und Handschuhe und Schals für die ganze liebe…",
    ),
    (
        "Premium leather goods made by hand in a small workshop of the old town",
        "Premium leather goods made by hand in a small workshop…",
    ),
    (
        "Kaufen Sie jetzt die besten Winterjacken des Jahres seit dem Sommer",
        "Kaufen Sie jetzt die besten Winterjacken des Jahres…",
    ),
    ("x" * 70, "x" * 59 + "…"),
    ("  short  ", "  short  "),
]


def test_trim_to_length(spark):
    got = column(spark, [t for t, _ in TRIMS], lambda c: trim_to_length(c, 60))
    assert got == [w for _, w in TRIMS]


def model_pack(text):
    """Sentence by sentence, as described; the expression finds it in one match."""
    flat = re.sub(r"[ \t\n\r\f\v]+", " ", text)
    packed = ""
    for sentence in [s for s in re.split(r"(?<=[.!?]) +", flat) if s]:
        if len(packed + " " + sentence) > 160:
            break
        packed += " " + sentence
    packed = packed.strip(" \t\n\r\0\x0b")
    return packed if packed not in ("", "0") else flat[:155]


def model_trim(text, limit):
    if len(text) <= limit:
        return text
    head = text[:limit]
    ends = [head.rfind(p) for p in ".!?"]
    if max(ends) > limit * 0.5:
        return text[: max(ends) + 1].strip(" \t\n\r\0\x0b")
    for delimiter in ("|", "–", "—", ":", " - ", ","):
        at = head.rfind(delimiter)
        if at > limit * 0.4:
            return text[:at].rstrip(" \t\n\r\0\x0b")
    cut = text[: limit - 1]
    space = cut.rfind(" ")
    if space > (limit - 1) * 0.6:
        cut = cut[:space]
    cut = cut.rstrip(" .,;:-–—")
    while " " in cut and cut.rpartition(" ")[2].lower() in STOPWORDS:
        cut = cut.rpartition(" ")[0].rstrip(" .,;:-–—")
    return cut + "…"


WORDS = st.sampled_from(
    ["und", "the", "Für", "shoe", "Winterjacke", "a", "x" * 30, "…", "0", "ÜBER", "\n", " "]
)
JOINTS = st.sampled_from([" ", ". ", ", ", " - ", "|", "–", "—", ": ", "! ", "?", "  ", "-"])
TEXTS = st.lists(st.tuples(WORDS, JOINTS), max_size=45).map(
    lambda parts: "".join(w + j for w, j in parts)
)


@settings(max_examples=4, deadline=None)
@given(st.lists(TEXTS, min_size=150, max_size=250))
def test_against_scalar_model(spark, texts):
    assert column(spark, texts, build_description) == [model_pack(t) for t in texts]
    for limit in (60, 155, 160):
        got = column(spark, texts, lambda c: trim_to_length(c, limit))
        assert got == [model_trim(t, limit) for t in texts]
        assert all(len(g) <= limit for g in got)


def test_trim_strip_collapse(spark):
    assert column(spark, ["  a \x0b\0", "\f b"], trimmed) == ["  a", "\f b"]
    assert column(spark, ["a < b <i>c</i> <> d <x"], strip_tags) == ["a < b c  d "]
    assert column(spark, ["a \n\t b"], collapse_whitespace) == ["a b"]


def test_errors(spark):
    messages = [
        "HTTP 404 on fetch",
        "connect to port 443: refused",
        "timed out after 10001 milliseconds",
        "API error 503: x 429",
    ]
    assert column(spark, messages, error_code) == ["404", "443", "error", "503"]
    assert column(spark, messages, is_transient) == [False, False, False, True]
    assert column(spark, ["10.0.0.1 x", None], key_of_address) == ["10.0.0.1", "0"]
