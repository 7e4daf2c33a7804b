"""Tables the queries run on, derived row by row from the given tables.

The given pages lack meta tags, structured data, sitemaps and so on, so those
are added by expressions that depend on ``page_id``.  Every row of a given table
is used and none is grouped, so the derived tables grow with the given ones.
The expressions are written in the SQL subset that Spark and DuckDB share, so
the checks derive the very same inputs (see ``oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Head elements added after the title.
_HEAD = """concat('</title>',
  CASE WHEN page_id % 3 = 0 THEN concat('<meta name="description" content=" Desc ', cast(page_id AS string), ' &amp; more &#8211; &euro;5 ">') ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN concat('<meta content="k', cast(page_id AS string), ', shoes" name="keywords">') ELSE '' END,
  CASE WHEN page_id % 5 = 1 THEN '<meta name="Robots" content="noindex">' WHEN page_id % 5 = 2 THEN '<meta name="robots" content="noindex">' ELSE '' END,
  CASE page_id % 4
    WHEN 0 THEN '<meta name="og:title" content="by-name"><meta property="og:title" content="by-property">'
    WHEN 1 THEN '<meta name="og:title" content="by-name">'
    WHEN 2 THEN '<meta property="og:title" content=""><meta name="og:title" content="by-name">'
    ELSE '<meta property="og:title"><meta name="og:title" content="by-name">' END,
  CASE WHEN page_id % 7 = 3 THEN concat('<meta property="og:image" content="https://img.example.com/', cast(page_id AS string), '.png?a=1&amp;b=2">') ELSE '' END,
  CASE WHEN page_id % 8 = 1 THEN concat('<META NAME=', chr(39), 'author', chr(39), ' CONTENT=', chr(39), 'Ann "Q" &gt; B > C', chr(39), '>') ELSE '' END,
  CASE WHEN page_id % 8 = 2 THEN '<meta name=twitter:card content=summary>' ELSE '' END,
  CASE WHEN page_id % 2 = 0 THEN concat('<link rel="stylesheet" href="/s.css"><link rel="canonical" href="https://c.example.com/', cast(page_id AS string), '">') ELSE '' END,
  CASE page_id % 6
    WHEN 0 THEN '<script type="application/ld+json">{"@type":"NewsArticle"}</script>'
    WHEN 1 THEN '<script type="application/ld+json">{"@type":"Product"}</script>'
    WHEN 2 THEN '<script type="application/ld+json">{}</script><script type="application/ld+json">{"@type":"WebSite"}</script>'
    WHEN 3 THEN '<script type="application/ld+json">{"@type":"Person"}</script><script type="application/ld+json">{"@type":"LocalBusiness"}</script>'
    WHEN 4 THEN '<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"Product"}]</script><script type="application/ld+json">{"@type":["Article"]}</script>'
    ELSE '' END)"""

# Headings added after the h1.
_HEADINGS = """concat('</h1>',
  CASE WHEN page_id % 3 = 1 THEN '<h2>A</h2><h2> </h2><h2>0</h2><h2 class="x"> B &amp; <i>b</i></h2><h2>C</h2><h2>D</h2><h2>E</h2><h2>F</h2>' ELSE '' END,
  CASE WHEN page_id % 3 = 2 THEN '<header><h2>In header</h2></header>' ELSE '' END)"""

PAGES_ENRICHED = {
    "page_id": "page_id",
    "url": """CASE page_id % 7
      WHEN 1 THEN regexp_replace(url, '/(en|de|fr|es)/', '/blog/')
      WHEN 2 THEN regexp_replace(url, '/(en|de|fr|es)/', '/Shop/')
      ELSE url END""",
    "html": f"replace(replace(html, '</title>', {_HEAD}), '</h1>', {_HEADINGS})",
}

OVERRIDES = {
    "url": PAGES_ENRICHED["url"],
    "title": """CASE page_id % 10 WHEN 0 THEN concat('Override title ', cast(page_id AS string), ' | Brand')
      WHEN 1 THEN '' WHEN 2 THEN '0' ELSE NULL END""",
    "keywords": "CASE page_id % 10 WHEN 0 THEN 'one, two' WHEN 1 THEN '' WHEN 3 THEN '0' ELSE NULL END",
    "description": """CASE page_id % 10 WHEN 0 THEN concat('Override text ', cast(page_id AS string), '. ', repeat('More words here, ', 12))
      WHEN 1 THEN '0' WHEN 2 THEN '' ELSE NULL END""",
}

PAGE_FETCH = {
    "page_id": "page_id",
    "url": """CASE page_id % 9 WHEN 1 THEN concat('not a url ', cast(page_id AS string))
      WHEN 2 THEN concat('ftp://files.example.com/', cast(page_id AS string)) ELSE url END""",
    "http_status": "CASE page_id % 9 WHEN 3 THEN 404 WHEN 4 THEN 503 WHEN 8 THEN 301 ELSE 200 END",
    "fetch_error": """CASE page_id % 9 WHEN 5 THEN 'connect to port 443: refused'
      WHEN 3 THEN '' ELSE NULL END""",
    "html": "CASE page_id % 9 WHEN 6 THEN NULL WHEN 7 THEN '0' ELSE html END",
}

# The second round of fetches: every page answers, some again with an error.
PAGE_REFETCH = {
    "page_id": "page_id",
    "url": PAGE_FETCH["url"],
    "http_status": "CASE WHEN page_id % 4 = 3 THEN 503 ELSE 200 END",
    "fetch_error": "cast(NULL AS string)",
    "html": "html",
}

FRONTIER = {
    "job_id": "concat('job-', cast(page_id % 5 AS string))",
    "pos": "page_id",
    "url": f"CASE WHEN page_id % 11 = 10 THEN concat('https://missing.example.com/', cast(page_id AS string)) ELSE {PAGE_FETCH['url']} END",
}

_ANSWER = """concat('{"title":"Titel ', cast(page_id AS string), ' ', repeat('und mehr ', page_id % 9),
  '","description":"Satz eins ist da. ', repeat('Noch ein Satz mit Worten. ', page_id % 11),
  '","keywords":"a, b","suggestions":["s', cast(page_id AS string), '","t"]',
  CASE WHEN page_id % 3 = 0 THEN ',"llms_txt":"# own text"' ELSE '' END, '}')"""

ANSWERS = {
    "page_id": "page_id",
    "url": PAGES_ENRICHED["url"],
    "provider": """CASE page_id % 7 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'google'
      WHEN 3 THEN 'perplexity' WHEN 4 THEN 'grok' WHEN 5 THEN 'ownai' ELSE 'other' END""",
    "answer": f"""CASE page_id % 8
      WHEN 0 THEN concat('Sure, here it is:', chr(10), {_ANSWER}, chr(10), 'Anything else?')
      WHEN 1 THEN concat('{{"title": broken', cast(page_id AS string), '}}')
      WHEN 2 THEN '{{ }}'
      WHEN 3 THEN 'no braces at all'
      WHEN 4 THEN concat({_ANSWER}, ' and {{more}}')
      WHEN 5 THEN '{{"title":null,"description":7}}'
      ELSE {_ANSWER} END""",
}

# Provider responses around those answers (quotes and line breaks escaped).
_ESCAPED = "replace(replace(answer, chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n'))"
RESPONSES = {
    "page_id": "page_id",
    "url": "url",
    "provider": "provider",
    "http_status": "CASE page_id % 10 WHEN 7 THEN 429 WHEN 8 THEN 500 ELSE 200 END",
    "raw": f"""CASE
      WHEN page_id % 10 = 7 THEN concat('slow down ', repeat('x', 400))
      WHEN page_id % 10 = 8 THEN NULL
      WHEN page_id % 10 = 9 THEN '<html>gateway</html>'
      WHEN page_id % 10 = 6 THEN '{{"usage":{{}}}}'
      WHEN provider = 'anthropic' THEN concat('{{"content":[{{"type":"text","text":"', {_ESCAPED}, '"}}]}}')
      WHEN provider = 'google' THEN concat('{{"candidates":[{{"content":{{"parts":[{{"text":"', {_ESCAPED}, '"}}]}}}}]}}')
      ELSE concat('{{"choices":[{{"message":{{"role":"assistant","content":"', {_ESCAPED}, '"}}}}]}}') END""",
}

ATTEMPTS = {
    "url": "concat('https://a.example.com/', cast(event_id - event_id % 5 AS string))",
    "n": "cast(event_id % 5 + 1 AS int)",
    "ok": "event_type = 'purchase'",
    "error": """CASE event_type WHEN 'purchase' THEN NULL WHEN 'error' THEN 'HTTP 404 on fetch'
      WHEN 'click' THEN 'API error 429: slow down' ELSE 'API error 503: busy' END""",
}

# Client addresses as a proxy may hand them over, and job names as a caller may.
ADDRESS = """CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ''
  WHEN 2 THEN concat('2001:DB8::', cast(user_id AS string), '%eth0') WHEN 3 THEN concat('[fe80::', cast(user_id AS string), ']:8080')
  WHEN 4 THEN concat('10.0.', cast(user_id % 256 AS string), '.1, 192.168.0.1') ELSE concat(' 10.1.', cast(user_id % 256 AS string), '.9', chr(10)) END"""
JOB_NAME = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('../job ', cast(user_id AS string)) ELSE concat('job_', cast(user_id AS string), '-é!') END"

JOB_STATES = {
    "job_id": "concat('job-', cast(user_id AS string))",
    "status": "event_type",
    "done": "event_id",
    "errors": "event_id % 7",
}

# Every page stands for a site of its own.  Its six documents follow a class:
# 0 plain sitemap, 1 index behind a malformed sitemap, 2 robots only, 3 links
# only, 4 foreign hosts only, 5 nested index, 6 an index that lists itself first
# and then a chain of ten indexes.
SITE = "concat('https://s', cast(page_id AS string), '.example.com')"
SITES = {"site": f"concat({SITE}, '/')"}


def _urlset(*paths: str, host: str = SITE) -> str:
    locs = ", ".join(f"'<url><loc> ', {host}, '{p}</loc></url>'" for p in paths)
    return f"concat('<urlset>', {locs}, '</urlset>')"


def _index(*paths: str) -> str:
    locs = ", ".join(f"'<sitemap><loc>', {SITE}, '{p}</loc></sitemap>'" for p in paths)
    return f"concat('<sitemapindex>', {locs}, '</sitemapindex>')"


_FOREIGN = "'https://foreign.example.org'"
_NO_DOC = "NULL"
SITE_CLASS = "CASE WHEN page_id % 12 = 11 THEN 6 ELSE page_id % 6 END"
_CLASS = SITE_CLASS
_CHAIN = 10
SITE_DOCS = [
    (
        "/sitemap.xml",
        f"""CASE {_CLASS}
          WHEN 0 THEN concat('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">',
            '<url><loc>', {SITE}, '/a</loc></url><url><loc>', {SITE}, '/b?x=1&amp;y=2</loc><loc>ignored</loc></url>',
            '<url><loc>', {SITE}, '/a</loc></url><url><loc>https://foreign.example.org/</loc></url>',
            '<url><loc>0</loc></url><url><lastmod>2024</lastmod></url><url><loc>', {SITE}, '/c/',
            cast(page_id AS string), '</loc></url></urlset>')
          WHEN 1 THEN '<urlset><url><loc>https://broken.example.com/</loc></url>'
          WHEN 4 THEN {_urlset('/x', '/y', host=_FOREIGN)}
          WHEN 5 THEN {_index('/nested.xml', '/child-1.xml')}
          WHEN 6 THEN {_index('/sitemap.xml', '/deep-1.xml', '/child-1.xml')}
          ELSE {_NO_DOC} END""",
    ),
    (
        "/sitemap_index.xml",
        f"CASE {_CLASS} WHEN 1 THEN {_index('/child-1.xml', '/gone.xml', '/child-2.xml', '/child-3.xml')} ELSE {_NO_DOC} END",
    ),
    (
        "/nested.xml",
        f"CASE {_CLASS} WHEN 5 THEN {_index('/gone.xml', '/child-2.xml')} ELSE {_NO_DOC} END",
    ),
    (
        "/child-1.xml",
        f"CASE WHEN {_CLASS} IN (1, 2, 5, 6) THEN {_urlset('/1a', '/1b')} ELSE {_NO_DOC} END",
    ),
    (
        "/child-2.xml",
        f"CASE WHEN {_CLASS} IN (1, 5, 6) THEN {_urlset('/2a', '/1b', '/2c')} ELSE {_NO_DOC} END",
    ),
    ("/child-3.xml", f"CASE WHEN {_CLASS} IN (1, 5) THEN {_urlset('/3a')} ELSE {_NO_DOC} END"),
    (
        "/robots.txt",
        f"""CASE {_CLASS}
          WHEN 2 THEN concat('User-agent: *', chr(13), chr(10), 'SITEMAP: ', {SITE}, '/gone.xml', chr(13), chr(10),
            ' Sitemap: ', {SITE}, '/indented.xml', chr(10), 'sitemap:', {SITE}, '/child-1.xml ', chr(13), chr(10))
          WHEN 3 THEN 'User-agent: *'
          ELSE {_NO_DOC} END""",
    ),
    ("", "html"),
    *[
        (f"/deep-{k}.xml", f"CASE {_CLASS} WHEN 6 THEN {_index('/child-2.xml' if k == _CHAIN else f'/deep-{k + 1}.xml')} ELSE {_NO_DOC} END")
        for k in range(1, _CHAIN + 1)
    ],
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages")


def pages_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(pages(spark, sf_dir), PAGES_ENRICHED)


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(pages(spark, sf_dir), OVERRIDES)


def page_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(pages(spark, sf_dir), PAGE_FETCH)


def page_refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(pages(spark, sf_dir), PAGE_REFETCH)


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(pages(spark, sf_dir), FRONTIER)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(pages(spark, sf_dir), ANSWERS)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(answers(spark, sf_dir), RESPONSES)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(pages(spark, sf_dir), SITES)


def site_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of all sites; one that a class lacks is a 404 row."""
    docs = ", ".join(
        f"""named_struct('doc_url', concat({SITE}, '{path}'), 'body', cast({body} AS string))"""
        for path, body in SITE_DOCS
    )
    return pages(spark, sf_dir).selectExpr(f"inline(array({docs}))").select(
        "doc_url",
        F.when(F.col("body").isNull(), 404).otherwise(200).alias("http_status"),
        "body",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def instant(ts: str) -> Column:
    """The zoneless event time as UTC, whatever time zone the session has."""
    return F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone())


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(events(spark, sf_dir), ATTEMPTS)


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = derive(events(spark, sf_dir), {**JOB_STATES, "ts": "ts"})
    return with_updated(states)


def with_updated(states: DataFrame) -> DataFrame:
    seconds = F.unix_seconds(instant("ts"))
    return states.select("job_id", seconds.alias("updated"), "status", "done", "errors")


def as_requests(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("key"),
        instant("ts").alias("ts"),
        F.col("event_id").alias("id"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(events(spark, sf_dir))
