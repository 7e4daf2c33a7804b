import time

import pytest
from pyspark.sql import functions as F

from tagloom import extract_pages
from tagloom.operators.discovery import page_links
from tagloom.functions.html import decode_entities
from tagloom.functions.json_text import has_json_value

LONG = "A paragraph that is certainly longer than eighty characters, so that it counts as content."


def record(spark, html, url="https://a.com/x"):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    return extract_pages(df).collect()[0]


def test_entities(spark):
    cases = [
        ("a &amp; b &amp;lt; &euro;", "a & b &lt; €"),
        ("&#8211;&#x1F600;&#X41;", "–😀A"),
        ("&amp &nope; & &#0;x &#55296;", "&amp &nope; & x "),
        ("plain", "plain"),
        ("&apos;&nbsp;&quot;", "' \""),
        ("", ""),
        (None, None),
    ]
    df = spark.createDataFrame(cases, "x string, want string")
    for row in df.select("want", F.expr(decode_entities("x")).alias("got")).collect():
        assert row.got == row.want


def test_json_values(spark):
    good = ['{"a":1}', '[{"b":[1,2]}]', '"x"', "7", " true ", '{"a":1,"a":2}']
    bad = [
        "{}", "[]", "0", '""', '"0"', "null", "false", "{bad", '{"a":1};', '{"a":1}]', '{"a":1}]}',
        '{"a":1},{"b":2}', '1,"~end of value~"], [2', "", None, "{'a':1}", "NaN", "-0.0", " { } ",
    ]
    df = spark.createDataFrame([(x,) for x in good + bad], "x string")
    got = [r.v for r in df.select(F.expr(has_json_value("x")).alias("v")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_existing_tags(spark):
    html = """<html><head><TITLE> A &amp; B </TITLE>
      <!-- <meta name="description" content="commented"> -->
      <script>var x = '<meta name="description" content="scripted">';</script>
      <meta name="Description" content="wrong case"><meta content=' 1 > 0 ' name='description'>
      <meta name="keywords" content="k1"><meta name="keywords" content="k2">
      <meta name="og:title" content="by name"><meta property="og:title" content="">
      <meta property="og:type"><meta name="og:type" content="fallback">
      <meta name=robots content=noindex><meta data-x="name='author'" content="nobody">
      <link rel="CANONICAL" href="/no"><link href="https://c.com/?a=1&amp;b=2" rel="canonical">
      </head><body></body></html>"""
    got = record(spark, html).existing
    assert got.title == "A & B"
    assert got.description == "1 > 0"
    assert got.keywords == "k1"
    assert got.og_title == ""
    assert got.og_type == "fallback"
    assert got.robots == "noindex"
    assert got.author == got.og_image == got.tw_card == ""
    assert got.canonical == "https://c.com/?a=1&b=2"


def test_headings_and_paragraphs(spark):
    html = f"""<body><header><h1> First <b>one</b> &amp; more</h1></header><h1>Second</h1>
      <h2>A</h2><h2> </h2><h2>0</h2><h2 class="x">B <i>b</i></h2><h2>C</h2><h2>D</h2><h2>E</h2><h2>F</h2>
      <script>"<p>{LONG}"</script><p>short<p>{LONG} <b>x<p class="c">{LONG}<div>{LONG}</div>
      <pre>{LONG}</pre><nav><p> {LONG}\n</nav></body>"""
    got = record(spark, html)
    assert got.h1 == "First one & more"
    assert got.h2s == ["A", "B b", "C", "D", "E"]
    assert got.paragraphs == [LONG + " x", LONG, LONG]


def test_body_text(spark):
    html = """<html><head><title>t</title></head><body class="a>b"><nav>N<nav-x>n</nav-x></nav>
      <p>a</p><p>b</p><style>p{}</style><header>H<script>"</header>"</script></header>
      <script>x = "<!--"; y = "<body>";</script> c &lt;b&gt;d&lt;/b&gt; 1 &lt; 2<footer>unclosed"""
    assert record(spark, html).body_text == " ab c d 1 < 2"
    assert record(spark, "<p>no body tag").body_text == "no body tag"
    assert record(spark, "<title>t</title><meta name=a><h1>H</h1><p>text<nav>n</nav>").body_text == "Htext"
    assert record(spark, "<head><title>t</title><noscript>x</noscript></head><p>after").body_text == "after"
    assert record(spark, None).body_text == ""
    long = record(spark, "<body>" + "ä" * 50_010 + "</body>").body_text
    assert long == "ä" * 50_000


def test_broken_markup_is_linear(spark):
    """Unbalanced quotes and unclosed elements must not blow up the matcher."""
    html = "<body>" + '<p title="x>' * 3_000 + "<script>" + "<" * 20_000 + "'" * 5_001
    assert record(spark, html).h1 == ""
    assert record(spark, "<!--" + "-" * 50_000).body_text == ""


@pytest.mark.parametrize(
    "shape",
    ["<a ", "<meta ", "<h1 ", "<h2>", "<p ", "<body ", "<script ", "<title ", "<!--", "<a 'x", '<a ">" ', "<a href=\"x", "a=", "<", "</h1 ", "&#",
     "<nav>", "<nav ", "</nav>", "<nav><nav></nav>", "<nav></nav><nav>x</nav>t", "<nav><footer>", "<nav/><header>t</header></nav>"],
)
def test_broken_markup_takes_linear_time(spark, shape):
    def seconds(size):
        page = spark.createDataFrame([("https://a.com/", shape * (size // len(shape)))], "url string, html string")
        start = time.perf_counter()
        extract_pages(page).collect()
        page_links(page).count()
        return time.perf_counter() - start

    seconds(1_000)
    small, large = seconds(240_000), seconds(1_000_000)
    # Quadratic time would be 17 times as much.
    assert large < 10 and large < 8 * small + 2


def test_references_that_are_no_character_vanish(spark):
    html = "<h1>a&#xFFFFFFFFFFFFFFFFFFFFFF;b&#99999999999999999999999;c&#x0;d&#x00000041;&#65;&#x110000;</h1>"
    assert record(spark, html).h1 == "abcdAA"


def test_hosts(spark):
    assert record(spark, "", "http://user@[2001:db8::1]:8080/p").domain == "[2001:db8::1]"
    assert record(spark, "", "http://u:p@a.com:80/p").domain == "a.com"


@pytest.mark.parametrize(
    "blocks, url, want",
    [
        (['{"@type":"Person"}', '{"@type":"LocalBusiness"}'], "https://a.com/blog/x", "organization"),
        (['{"@type":["Article"]}', '[{"@type":"Product"}]'], "https://a.com/x", "website"),
        (['{"@graph":[{"@type":"Product"}]}'], "https://a.com/NEWS/x", "article"),
        ([], "https://shop.a.com/", "product"),
        ([], "https://a.com/?x=/produkt", "product"),
        (['{"@type":"BlogPosting"}'], "https://a.com/shop", "article"),
        ([], "https://a.com/x", "website"),
    ],
)
def test_page_type(spark, blocks, url, want):
    html = "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
    got = record(spark, html, url)
    assert got.page_type == want
    assert got.jsonld == blocks


def test_jsonld_blocks(spark):
    html = """<script type="application/ld+json">{"@type":"Product"};</script>
      <script type='application/ld+json' id="x"> {"a": "<b>"} </script>
      <!-- <script type="application/ld+json">{"@type":"Article"}</script> -->
      <script type="text/javascript">'<script type="application/ld+json">{"c":1}'</script>
      <script type="APPLICATION/LD+JSON">{"d":1}</script>"""
    assert record(spark, html).jsonld == ['{"a": "<b>"}']


def test_domain(spark):
    for url, want in [
        ("https://user:pw@www.Ex_ample.com:8080/p", "www.Ex_ample.com"),
        ("http://münchen.de?x", "münchen.de"),
        ("no url", ""),
    ]:
        assert record(spark, "", url).domain == want
