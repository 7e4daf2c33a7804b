"""The same results in plain DuckDB SQL, for checking the queries.

Text is composed from small expression builders; patterns use RE2 syntax only.
Where practical the route differs from the Spark one: sequential removal
instead of one alternation, attribute lookup instead of tokenising, running
sums instead of a greedy match, a recursive query instead of a fold.
"""

from __future__ import annotations

from tagloom.functions.text import BRAND_ENDINGS, CUT_DELIMITERS, STOPWORDS, TAIL_CHARS
from tagloom.operators import pages as P
from tagloom.operators import responses as M
from tagloom.operators import rules as R
from tagloom.operators.jobs import NOT_FETCHED
from tagloom.plans import inputs as I

_ATTRS = r"""(?:[^>"']+|"[^"]*"|'[^']*')*"""


PARAGRAPH = r"(?i)<p(?:\s[^>]*)?>"


def lit(text: str) -> str:
    """A DuckDB literal; control characters are spelled with chr()."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def pat(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {pat(pattern)}, {pat(by)}, 'g')"


def grab(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {pat(pattern)}, {group})"


def grab_all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {pat(pattern)}, {group})"


def trim(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(13))"


def rtrim(x: str) -> str:
    return f"rtrim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(13))"


def tag(name: str) -> str:
    return rf"<{name}(?:[\s/]{_ATTRS})?>"


def columns(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


def select(exprs: dict[str, str], source: str) -> str:
    return f"SELECT {columns(exprs)} FROM {source}"


def decode(x: str) -> str:
    """The entities that occur in the tables; ``&amp;`` last decodes once."""
    for name, char in (
        ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"),
        ("&euro;", "€"), ("&#8211;", "–"), ("&amp;", "&"),
    ):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def untag(x: str) -> str:
    return sub(x, rf"(?is)<[a-z/!?]{_ATTRS}>|<[a-z/!?][^>]*>")


def strip_tag_like(x: str) -> str:
    return sub(x, r"<(?:[^\s\x0b>][^>]*)?>|<[^\s\x0b>][^>]*\z")


def collapse(x: str) -> str:
    return sub(x, r"[\s\x0b]+", " ")


def falsy(x: str) -> str:
    return f"({x} IS NULL OR {x} IN ('', '0'))"


def host(url: str) -> str:
    # Authority first, then without user and port; brackets hold their colons.
    authority = sub(grab(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"), r"^[^@]*@")
    return f"""CASE WHEN starts_with({authority}, '[') THEN {grab(authority, r'^[^]]*]', 0)}
      ELSE split_part({authority}, ':', 1) END"""


def scheme(url: str) -> str:
    return grab(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://")


# ── Titles, descriptions, lengths ─────────────────────────────────────────────


def optimized_title(raw: str, domain: str) -> str:
    stem = trim(sub(raw, r"[\s\x0b]*[|\-–][\s\x0b]*[^|\-–]+\z"))
    brand = domain
    for ending in BRAND_ENDINGS:
        brand = f"replace({brand}, '{ending}', '')"
    return f"""CASE WHEN length({stem}) > 60 THEN substring({stem}, 1, 57) || '…'
      WHEN length({stem}) < 30 THEN {stem} || ' – ' || upper(substring({brand}, 1, 1)) || substring({brand}, 2)
      ELSE {stem} END"""


def trimmed_to(x: str, limit: int) -> str:
    head, short = f"substring({x}, 1, {limit})", f"substring({x}, 1, {limit - 1})"

    def last(text: str, delimiter: str) -> str:
        return f"length({grab(text, '(?s)^(.*)' + delimiter)})"

    sentence = last(head, "[.!?]")
    delimiters = "".join(
        f" WHEN {last(head, d.replace('|', chr(92) + '|'))} > {limit * 0.4}"
        f" THEN {rtrim(f'substring({x}, 1, ' + last(head, d.replace('|', chr(92) + '|')) + ')')}"
        for d in CUT_DELIMITERS
    )
    word = f"CASE WHEN {last(short, ' ')} > {(limit - 1) * 0.6} THEN substring({short}, 1, {last(short, ' ')}) ELSE {short} END"
    word = sub(word, rf"[{TAIL_CHARS}]+\z")
    word = sub(word, rf"(?i)(?:[{TAIL_CHARS}]* (?:{'|'.join(dict.fromkeys(STOPWORDS))}))+\z")
    return f"""CASE WHEN length({x}) <= {limit} THEN {x}
      WHEN {sentence} > {limit * 0.5} THEN {trim(f'substring({x}, 1, {sentence} + 1)')}
      {delimiters} ELSE {word} || '…' END"""


def packed_ctes(source: str, key: str, text: str) -> str:
    """``packed(key, packed)``: whole sentences by a running sum of lengths."""
    flat = collapse(strip_tag_like(text))
    marked = sub("flat", r"([.!?]) ", r"\1" + "\x01")
    return f"""flat AS (SELECT {key} AS k, {flat} AS flat FROM {source}),
      pieces AS (SELECT k, unnest(list_filter(string_split({marked.replace(chr(1), "' || chr(1) || '")}, chr(1)), lambda s: s <> '')) AS s,
        generate_subscripts(list_filter(string_split({marked.replace(chr(1), "' || chr(1) || '")}, chr(1)), lambda s: s <> ''), 1) AS i FROM flat),
      sums AS (SELECT k, i, s, sum(length(s) + 1) OVER (PARTITION BY k ORDER BY i) AS total FROM pieces),
      kept AS (SELECT k, string_agg(s, ' ' ORDER BY i) AS joined FROM sums WHERE total <= 160 GROUP BY k),
      packed AS (SELECT flat.k AS k, CASE WHEN {falsy(trim('joined'))} THEN substring(flat, 1, 155) ELSE {trim('joined')} END AS packed
        FROM flat LEFT JOIN kept ON flat.k = kept.k)"""


# ── Page records ──────────────────────────────────────────────────────────────


def attr(x: str, name: str) -> str:
    """Raw attribute with its quotes; empty when absent."""
    return grab(x, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


def unquoted(raw: str) -> str:
    return f"""CASE WHEN {raw}[1] IN (chr(34), chr(39)) THEN substring({raw}, 2, length({raw}) - 2) ELSE {raw} END"""


def _removed(x: str, *names: str) -> str:
    for name in names:
        x = sub(x, rf"(?is){tag(name)}.*?(?:</{name}\s*>|\z)")
    return x


def _first_text(x: str, name: str) -> str:
    return trim(decode(untag(grab(x, rf"(?is){tag(name)}(.*?)(?:</{name}\s*>|\z)"))))


def record_ctes(source: str) -> str:
    """``records``: page records of ``source(page_id, url, html)``."""
    metas = f"""list_transform({grab_all('markup', '(?is)' + tag('meta'))},
      lambda t: {{'n': {unquoted(attr('t', 'name'))}, 'p': {unquoted(attr('t', 'property'))},
                 'has': {attr('t', 'content')} <> '', 'c': {trim(decode(unquoted(attr('t', 'content'))))}}})"""
    links = f"""list_transform({grab_all('markup', '(?is)' + tag('link'))},
      lambda t: {{'r': {unquoted(attr('t', 'rel'))}, 'h': {trim(decode(unquoted(attr('t', 'href'))))}}})"""

    def by(key: str, value: str) -> str:
        return f"list_filter(metas, lambda m: m.{key} = '{value}' AND m.has)[1].c"

    existing = {"title": _first_text("markup", "title")}
    existing["canonical"] = "coalesce(list_filter(links, lambda m: m.r = 'canonical')[1].h, '')"
    for field, name in P.META_NAMES.items():
        existing[field] = f"coalesce({by('n', name)}, '')"
    for field, prop in P.META_PROPERTIES.items():
        existing[field] = f"coalesce({by('p', prop)}, {by('n', prop)}, '')"

    texts = f"""list_filter(list_transform({grab_all('markup', '(?is)' + tag('h2') + r'(.*?)(?:</h2\s*>|\z)', 1)},
      lambda t: {trim(decode(untag('t')))}), lambda t: NOT {falsy('t')})[1:5]"""
    cut = sub("p", P.H.BLOCK_BOUNDARY)
    pieces = f"regexp_split_to_array(markup, {pat(PARAGRAPH)})[2:]"
    paragraphs = f"""list_filter(list_transform(list_filter(list_transform({pieces},
      lambda p: {decode(untag(cut))}), lambda p: length(p) > 80), lambda p: {trim('p')}), lambda p: NOT {falsy('p')})[1:6]"""
    body = grab(_removed("markup", "nav", "header", "footer"), rf"(?is){tag('body')}(.*?)(?:</body\s*>|\z)")
    scripts = grab_all(
        sub("html", r"(?is)<!--.*?(?:-->|\z)"),
        r'(?is)<script[^>]* type="application/ld\+json"[^>]*>(.*?)</script\s*>', 1,
    )
    jsonld = f"""list_filter({scripts}, lambda x: json_valid(x)
      AND trim(x) NOT IN ('{{}}', '[]', '0', '""', 'null', 'false'))"""
    types = " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in P.TYPES_BY_JSONLD.items())
    declared = f"""list_filter(list_transform(jsonld, lambda x: CASE json_extract_string(x, '$."@type"') {types} END),
      lambda k: k IS NOT NULL)[1]"""
    kind = f"""coalesce({declared}, CASE WHEN regexp_matches(url, '{P.ARTICLE_URL}') THEN 'article'
      WHEN regexp_matches(url, '{P.PRODUCT_URL}') THEN 'product' ELSE 'website' END)"""
    flat = f"substring({collapse(strip_tag_like(decode(untag(body))))}, 1, 50000)"
    return f"""cleaned AS (SELECT page_id, url, html, {_removed(sub('html', r'(?is)<!--.*?(?:-->|\z)'), 'script', 'style')} AS markup FROM {source}),
      tagged AS (SELECT *, {metas} AS metas, {links} AS links, {jsonld} AS jsonld FROM cleaned),
      records AS (SELECT page_id, url, {columns(existing)}, {_first_text('markup', 'h1')} AS h1,
        {texts} AS h2s, {paragraphs} AS paragraphs, jsonld, {kind} AS page_type, {flat} AS body_text,
        {host('url')} AS domain FROM tagged)"""


ENRICHED = f"enriched AS ({select(I.PAGES_ENRICHED, 'pages')})"
RECORDS = f"WITH {ENRICHED}, {record_ctes('enriched')}"
PLAIN_RECORDS = f"WITH {record_ctes('pages')}"


def rules_ctes(overridden: bool = False) -> str:
    """``meta``: the rule-based record of every record."""
    if overridden:
        source = f"""overrides AS ({select(I.OVERRIDES, 'pages')}),
          seeded AS (SELECT r.*, o.title AS o_title, o.keywords AS o_keywords, o.description AS o_description
            FROM records r LEFT JOIN overrides o ON r.url = o.url)"""
    else:
        source = """seeded AS (SELECT *, NULL::VARCHAR AS o_title, NULL::VARCHAR AS o_keywords,
          NULL::VARCHAR AS o_description FROM records)"""
    text = "CASE WHEN len(paragraphs) > 0 THEN paragraphs[1] ELSE body_text END"
    return f"""{source}, {packed_ctes('seeded', 'page_id', text)},
      seeds AS (SELECT s.*, coalesce(o_title, h1, title, domain) AS t,
        CASE WHEN NOT {falsy('o_description')} THEN o_description ELSE packed END AS d
        FROM seeded s JOIN packed ON s.page_id = packed.k),
      meta AS (SELECT page_id, url, h1, og_image, h2s, page_type, domain, body_text, keywords AS existing_keywords,
        o_keywords, {optimized_title('t', 'domain')} AS title, {trimmed_to('d', 155)} AS description,
        coalesce(o_keywords, keywords, '') AS keywords FROM seeds)"""


def json_ld(title: str = "title", description: str = "description") -> str:
    start = f"""'{{"@context":"{R.SCHEMA_CONTEXT}","url":' || to_json(url) || ',"name":'"""
    desc = f"',\"description\":' || to_json({description})"
    t = f"to_json({title})"
    return f"""CASE page_type
      WHEN 'article' THEN {start} || {t} || {desc} || ',"@type":"Article","headline":' || {t} || ',"publisher":{{"@type":"Organization","name":' || to_json(domain) || '}}}}'
      WHEN 'product' THEN {start} || {t} || {desc} || ',"@type":"Product"}}'
      WHEN 'organization' THEN {start} || to_json(domain) || {desc} || ',"@type":"Organization"}}'
      ELSE {start} || {t} || {desc} || ',"@type":"WebPage","isPartOf":{{"@type":"WebSite","url":' || to_json('https://' || domain) || '}}}}' END"""


def llms(title: str = "title", description: str = "description") -> str:
    return f"""'# ' || {title} || chr(10) || chr(10) || {description} || chr(10) || chr(10)
      || CASE WHEN len(h2s) > 0 THEN '{R.TOPICS_HEADING}' || chr(10)
           || array_to_string(list_transform(h2s, lambda h: '- ' || h), chr(10)) || chr(10) || chr(10) ELSE '' END
      || '{R.PAGES_HEADING}' || chr(10) || '- [' || {title} || '](' || url || ')'"""


META = f"{RECORDS}, {rules_ctes()}"
META_OVERRIDDEN = f"{RECORDS}, {rules_ctes(True)}"


# ── Links and sitemaps ────────────────────────────────────────────────────────


def links_ctes(source: str) -> str:
    """``page_links(page_id, pos, url)`` of ``source(page_id, url, html)``."""
    href = f"list_transform({grab_all('markup', '(?is)' + tag('a'))}, lambda t: {attr('t', 'href')})"
    hrefs = f"list_transform(list_filter({href}, lambda h: h <> ''), lambda h: {trim(decode(unquoted('h')))})"
    absolute = """CASE WHEN starts_with(href, '/') THEN base || href
      WHEN NOT starts_with(href, 'http') THEN page || '/' || href ELSE href END"""
    path = grab("a", r"^[^:/?#]+://[^/?#]*(/[^?#]*)")
    clean = f"rtrim({scheme('a')} || '://' || {host('a')} || CASE WHEN {path} = '' THEN '/' ELSE {path} END, '/')"
    return f"""link_source AS (SELECT page_id, rtrim(url, '/') AS page,
        {scheme('url')} || '://' || {host('url')} AS base,
        {_removed(sub('html', r'(?is)<!--.*?(?:-->|\z)'), 'script', 'style')} AS markup FROM {source}),
      hrefs AS (SELECT page_id, page, base, unnest({hrefs}) AS href, generate_subscripts({hrefs}, 1) AS pos FROM link_source),
      resolved AS (SELECT page_id, pos, {absolute} AS a FROM hrefs WHERE NOT {falsy('href')}
        AND NOT starts_with(href, '#') AND NOT starts_with(href, 'mailto:') AND NOT starts_with(href, 'tel:')),
      page_links AS (SELECT page_id, 0 AS pos, page AS url FROM link_source
        UNION ALL SELECT page_id, pos, {clean} AS url FROM resolved WHERE {host('a')} <> '')"""


# What each class of site offers, in reading order: class, order, path, foreign.
_SITE_URLS = [
    (0, "0", "/a"), (0, "1", "/b?x=1&y=2"), (0, "2", "/a"), (0, "3", "!/"), (0, "4", "/c/#"),
    (1, "0,0", "/1a"), (1, "0,1", "/1b"), (1, "2,0", "/2a"), (1, "2,1", "/1b"), (1, "2,2", "/2c"),
    (1, "3,0", "/3a"),
    (2, "0", "/1a"), (2, "1", "/1b"),
    (4, "0", "!/x"), (4, "1", "!/y"),
    *[(6, "1," + "0," * 10 + str(i), path) for i, path in enumerate(("/2a", "/1b", "/2c"))], (6, "2,0", "/1a"), (6, "2,1", "/1b"),
    (5, "0,1,0", "/2a"), (5, "0,1,1", "/1b"), (5, "0,1,2", "/2c"), (5, "1,0", "/1a"), (5, "1,1", "/1b"),
]


def site_urls_ctes(skip: tuple[tuple[int, str], ...] = ()) -> str:
    """``mapped(page_id, site, ord, url)`` from the list above."""
    values = ", ".join(
        f"({c}, '{o}', '{p}')" for c, o, p in _SITE_URLS if not any(c == k and o.startswith(s) for k, s in skip)
    )
    return f"""offered(class, ord, path) AS (VALUES {values}),
      mapped AS (SELECT page_id, {I.SITES['site']} AS site, ord,
        CASE WHEN starts_with(path, '!') THEN 'https://foreign.example.org' || substring(path, 2)
        ELSE {I.SITE} || replace(path, '#', cast(page_id AS VARCHAR)) END AS url
        FROM pages JOIN offered ON {I.SITE_CLASS} = class)"""


def discovered(cap: int, skip: tuple[tuple[int, str], ...] = ()) -> str:
    start = f"start_pages AS (SELECT page_id, {I.SITE} AS url, html FROM pages WHERE page_id % 6 = 3)"
    return f"""WITH {start}, {links_ctes('start_pages')}, {site_urls_ctes(skip)},
      merged AS (SELECT site, url, ord FROM mapped UNION ALL
        SELECT {I.SITES['site']} AS site, url, lpad(cast(pos AS VARCHAR), 9, '0') AS ord FROM page_links),
      firsts AS (SELECT site, url, min(ord) AS ord FROM merged WHERE {host('url')} = {host('site')} GROUP BY site, url),
      ranked AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY ord) - 1 AS pos FROM firsts)
      SELECT site, pos::BIGINT AS pos, url FROM ranked WHERE pos < {cap}"""


# ── Model answers ─────────────────────────────────────────────────────────────


def _values(rows: tuple[tuple[str, ...], ...]) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


REGISTRY = f"registry({', '.join(M.PROVIDER_COLUMNS)}) AS (VALUES {_values(M.PROVIDERS)})"
ANSWERS = f"answers AS ({select(I.ANSWERS, 'pages')})"
_PROVIDER_KEY = f"CASE WHEN provider IN ({', '.join(repr(p[0]) for p in M.PROVIDERS)}) THEN provider ELSE 'none' END"


def texts_ctes() -> str:
    """``texts(page_id, url, provider, text, error)`` from raw responses."""
    ok = "CASE WHEN json_valid(raw) THEN raw END"
    found = " ".join(
        f"WHEN '{kind}' THEN json_extract_string({ok}, '{path}')" for kind, path in M.TEXT_PATHS.items()
    )
    excerpt = f"coalesce(substring(raw, 1, {M.ERROR_EXCERPT}), '')"
    return f"""{ANSWERS}, responses AS ({select(I.RESPONSES, 'answers')}), {REGISTRY},
      found AS (SELECT r.*, g.*, coalesce(CASE payload_kind {found} END, '') AS answer_text
        FROM responses r JOIN registry g ON provider_key = {_PROVIDER_KEY}),
      failed AS (SELECT *, CASE
        WHEN http_status >= 400 THEN 'API error ' || http_status || ': ' || {excerpt}
        WHEN payload_kind IN ('messages', 'chat') AND NOT coalesce(json_valid(raw), false) THEN 'response is not JSON'
        WHEN payload_kind = 'contents' AND {falsy('answer_text')} THEN 'empty answer: ' || {excerpt} END AS error FROM found),
      texts AS (SELECT page_id, url, provider, CASE WHEN error IS NULL THEN answer_text END AS text, error FROM failed)"""


def salvage(text: str) -> str:
    candidate = grab(text, r"(?s)\{.+\}", 0)
    return f"CASE WHEN {candidate} <> '' AND json_valid({candidate}) AND NOT regexp_matches({candidate}, '^\\{{\\s*\\}}$') THEN {candidate} END"


def prompt() -> str:
    hint = f"""CASE WHEN NOT {falsy('o_keywords')} THEN 'Keywords set by the user: ' || o_keywords
      WHEN NOT {falsy('existing_keywords')} THEN 'Keywords found on the page: ' || existing_keywords ELSE '' END"""
    return f"""{lit(M.PROMPT_TASK)} || chr(10) || chr(10) || 'URL: ' || url || chr(10) || 'Type: ' || page_type
      || chr(10) || 'Main heading: ' || h1 || chr(10) || 'Subheadings: ' || array_to_string(h2s[1:8], ', ')
      || chr(10) || {hint} || chr(10) || chr(10) || 'Text:' || chr(10) || substring(body_text, 1, 4000)
      || chr(10) || chr(10) || {lit(M.PROMPT_RULES)}"""


# ── Jobs ──────────────────────────────────────────────────────────────────────


def valid_url(x: str) -> str:
    return f"""(regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9]') AND NOT regexp_matches({x}, '[^!-~]'))"""


def gate(url: str, status: str, transport: str, html: str) -> str:
    return f"""CASE WHEN NOT {valid_url(url)} THEN 'invalid URL'
      WHEN {scheme(url)} NOT IN ('http', 'https') THEN 'only http and https are supported'
      WHEN NOT {falsy(transport)} THEN 'fetch failed: ' || {transport}
      WHEN {status} >= 400 THEN 'HTTP ' || {status} || ' on fetch'
      WHEN {falsy(html)} THEN 'empty response' END"""


def code(x: str) -> str:
    found = grab(x, r"\b(4[0-9]{2}|5[0-9]{2})\b")
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {found} = '' THEN 'error' ELSE {found} END"


def rows_ctes(source_sql: str, prefix: str = "") -> str:
    """``results``: one flat row per fetched page."""
    return f"""fetched AS ({source_sql}),
      gated AS (SELECT page_id, url, CASE WHEN error IS NULL THEN html ELSE '' END AS html, error
        FROM (SELECT *, {gate('url', 'http_status', 'fetch_error', 'html')} AS error FROM fetched)),
      {record_ctes('gated')}, {rules_ctes()},
      results AS (SELECT m.page_id, m.url, CASE WHEN error IS NULL THEN title END AS title,
        CASE WHEN error IS NULL THEN description END AS description,
        CASE WHEN error IS NULL THEN keywords END AS keywords,
        CASE WHEN error IS NULL THEN title END AS og_title,
        CASE WHEN error IS NULL THEN description END AS og_desc,
        CASE WHEN error IS NULL THEN '{R.ROBOTS_OPEN}' END AS robots,
        CASE WHEN error IS NULL THEN false END AS ai_powered,
        CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error, {code('error')} AS error_code
        FROM meta m JOIN gated g ON m.page_id = g.page_id)"""


_FIELDS = "title description keywords og_title og_desc robots ai_powered status error error_code".split()
FETCHED = select(I.PAGE_FETCH, "pages")
REFETCHED = select(I.PAGE_REFETCH, "pages")
_UNFETCHED = gate("f.url", "NULL::INT", "NULL::VARCHAR", "'-'")
JOB = f"""{rows_ctes(FETCHED)}, frontier AS ({select(I.FRONTIER, 'pages')}),
  job AS (SELECT f.job_id, f.pos, f.url, title, description, keywords, og_title, og_desc, robots, ai_powered,
    coalesce(status, 'error') AS status,
    CASE WHEN status IS NULL THEN coalesce({_UNFETCHED}, '{NOT_FETCHED}') ELSE error END AS error,
    CASE WHEN status IS NULL THEN {code(f"coalesce({_UNFETCHED}, '{NOT_FETCHED}')")} ELSE error_code END AS error_code
    FROM frontier f LEFT JOIN results r ON f.url = r.url)"""
SUMMARY = """SELECT job_id, count(*) AS total, count(*) AS done, count(*) FILTER (status = 'error') AS errors,
  count(*) FILTER (status <> 'error') AS success FROM job GROUP BY job_id"""

# A job of the same pages in which every url is fetched.
ALL_JOBS = f"""{rows_ctes(FETCHED)},
  job AS (SELECT 'job-' || page_id % 5 AS job_id, page_id AS pos, r.* FROM results r)"""


def events_of(job: str) -> str:
    """Events of the jobs in ``job``, a list of common table expressions."""
    row = ", ".join(f"'{f}': {f}" for f in _FIELDS if f not in ("error", "error_code"))
    head = "'current': k, 'total': n"
    return f"""WITH {job},
      placed AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY job_id) AS n FROM job)
      SELECT job_id, 0::BIGINT AS seq, 'urls_found' AS event,
        to_json({{'count': count(*), 'urls': list(url ORDER BY k)}})::VARCHAR AS data FROM placed GROUP BY job_id
      UNION ALL SELECT job_id, 16 * k, 'progress', to_json({{{head}, 'url': url, 'phase': 'crawling'}})::VARCHAR FROM placed
      UNION ALL SELECT job_id, 16 * k + 1, 'progress', to_json({{{head}, 'url': url, 'phase': 'generating'}})::VARCHAR
        FROM placed WHERE status = 'ok'
      UNION ALL SELECT job_id, 16 * k + 15, 'result', CASE status
        WHEN 'ok' THEN to_json({{{head}, 'row': {{'url': url, {row}}}}})::VARCHAR
        ELSE to_json({{{head}, 'row': {{'url': url, 'status': status, 'error': error, 'errorCode': error_code}}}})::VARCHAR END FROM placed
      UNION ALL SELECT job_id, 16 * (count(*) + 1), 'done', to_json({{'total': count(*),
        'success': count(*) FILTER (status <> 'error'), 'errors': count(*) FILTER (status = 'error')}})::VARCHAR FROM placed GROUP BY job_id"""


_TRANSIENT = "(coalesce(error LIKE '%503%', false) OR coalesce(error LIKE '%429%', false))"
RESOLVED = f"""WITH log AS ({select(I.ATTEMPTS, 'events')}),
  seen AS (SELECT *, coalesce(sum(CASE WHEN ok OR NOT {_TRANSIENT} THEN 1 ELSE 0 END) OVER (
    PARTITION BY url ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM log)
  SELECT url, max(n) AS attempts, arg_max(ok, n) AS ok,
    max(CASE WHEN NOT ok THEN error END) FILTER (n = last) AS error
  FROM (SELECT *, max(n) OVER (PARTITION BY url) AS last FROM seen WHERE ended = 0 AND n <= 3) GROUP BY url"""

STATES = f"""states AS (SELECT {columns(I.JOB_STATES)}, epoch(date_trunc('second', ts))::BIGINT AS updated FROM events)"""
LATEST = f"""WITH {STATES} SELECT job_id, max(updated) AS updated,
  arg_max(status, updated * 10000000 + done) AS status, arg_max(done, updated * 10000000 + done) AS done,
  arg_max(errors, updated * 10000000 + done) AS errors FROM states GROUP BY job_id"""

RATE_LIMIT = """WITH RECURSIVE hits AS (SELECT user_id, event_id, ts, epoch(date_trunc('second', ts))::BIGINT AS sec FROM events),
  starts AS (SELECT user_id, min(sec) AS start FROM hits GROUP BY user_id
    UNION ALL SELECT s.user_id, min(h.sec) FROM starts s JOIN hits h ON h.user_id = s.user_id
      WHERE h.sec > s.start + 86400 GROUP BY s.user_id),
  placed AS (SELECT h.user_id, h.event_id, h.ts, max(s.start) AS window_start FROM hits h
    JOIN starts s ON s.user_id = h.user_id AND s.start <= h.sec GROUP BY h.user_id, h.event_id, h.ts),
  counted AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) AS request_count FROM placed)
  SELECT cast(user_id AS VARCHAR) AS key, event_id AS id, window_start, request_count, request_count <= 2 AS allowed FROM counted"""


def oracle_sql() -> dict[str, str]:
    existing = ", ".join(P.EXISTING_FIELDS)
    scalars = f"""page_id, url, {existing}, h1, array_to_string(h2s, chr(10)) AS h2s,
      array_to_string(paragraphs, chr(10)) AS paragraphs, array_to_string(jsonld, chr(10)) AS jsonld,
      page_type, body_text, domain"""
    og_type = "CASE WHEN page_type = 'article' THEN 'article' ELSE 'website' END"
    meta_scalars = f"""page_id, url, '{R.RULES_PROVIDER}' AS provider, false AS ai_powered, title, description, keywords,
      {og_type} AS og_type, og_image, '{R.LOCALE}' AS og_locale, {json_ld()} AS jsonld, {llms()} AS llms_txt"""
    usable = "answer IS NOT NULL"
    field = "json_extract_string(answer, '$.{0}')".format
    applied = f"""salvaged AS (SELECT *, {salvage('text')} AS answer FROM texts),
      joined AS (SELECT m.*, s.answer, s.error, s.provider AS asked,
          {trimmed_to("coalesce(json_extract_string(s.answer, '$.title'), '')", 60)} AS ai_title,
          {trimmed_to("coalesce(json_extract_string(s.answer, '$.description'), '')", 160)} AS ai_description
        FROM meta m JOIN salvaged s ON m.url = s.url),
      final AS (SELECT * EXCLUDE (title, description, keywords), CASE WHEN {usable} THEN ai_title ELSE title END AS title,
          CASE WHEN {usable} THEN ai_description ELSE description END AS description,
          CASE WHEN {usable} THEN coalesce({field('keywords')}, '') ELSE keywords END AS keywords
        FROM joined)"""
    retry = f"""WITH {JOB}, fetched2 AS ({REFETCHED}),
      again AS (SELECT url, max({gate('url', 'http_status', 'fetch_error', 'html')}) AS e FROM fetched2 GROUP BY url)"""

    def documents(expr: str, name: str) -> str:
        return f"SELECT doc_id, {expr} AS {name} FROM documents"

    response_apply = f"""{META}, {texts_ctes()}, {applied}
          SELECT page_id, url, provider_name AS provider, {usable} AS ai_powered, title, description, keywords,
            {json_ld()} AS jsonld,
            CASE WHEN {usable} THEN coalesce({field('llms_txt')}, {llms()}) ELSE {llms()} END AS llms_txt,
            CASE WHEN {usable} THEN coalesce(array_to_string(cast(json_extract(answer, '$.suggestions') AS VARCHAR[]), chr(10)), '') END AS suggestions,
            CASE WHEN NOT ({usable}) AND error IS NULL THEN {lit(M.UNUSABLE_ANSWER)} END AS ai_error, error
          FROM final JOIN registry ON provider_key = {_PROVIDER_KEY.replace('provider IN', 'asked IN').replace('THEN provider', 'THEN asked')}"""
    return {
        "page_title_h1": f"{PLAIN_RECORDS} SELECT page_id, title, h1 FROM records",
        "page_body_text": f"{PLAIN_RECORDS} SELECT page_id, body_text, length(body_text)::BIGINT AS n_chars FROM records",
        "page_paragraphs": f"{PLAIN_RECORDS} SELECT page_id, len(paragraphs)::BIGINT AS n, array_to_string(paragraphs, chr(10)) AS paragraphs FROM records",
        "page_existing_tags": f"{RECORDS} SELECT page_id, {existing} FROM records",
        "page_h2s": f"{RECORDS} SELECT page_id, len(h2s)::BIGINT AS n, array_to_string(h2s, chr(10)) AS h2s FROM records",
        "page_jsonld_type": f"{RECORDS} SELECT page_id, len(jsonld)::BIGINT AS n, array_to_string(jsonld, chr(10)) AS jsonld, page_type FROM records",
        "page_domain": f"SELECT page_id, {host('url')} AS domain FROM pages",
        "page_record": f"{RECORDS} SELECT {scalars} FROM records",
        "page_links": f"WITH {links_ctes('pages')} SELECT page_id, pos::BIGINT AS pos, url FROM page_links",
        "link_frontier": f"""WITH {links_ctes('pages')},
          firsts AS (SELECT {host('p.url')} AS site, l.url AS url, min(l.page_id * 1000000 + pos) AS ord
            FROM page_links l JOIN pages p ON l.page_id = p.page_id WHERE {host('l.url')} = {host('p.url')} GROUP BY 1, 2),
          ranked AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY ord) - 1 AS pos FROM firsts)
          SELECT site, pos::BIGINT AS pos, url FROM ranked WHERE pos < 250""",
        "robots_sitemaps": f"""WITH named(pos, path) AS (VALUES (0, '/gone.xml'), (1, '/child-1.xml'))
          SELECT {I.SITE} || '/robots.txt' AS doc_url, pos::BIGINT AS pos, {I.SITE} || path AS target
          FROM pages, named WHERE page_id % 6 = 2""",
        "sitemap_urls": f"""WITH {site_urls_ctes()} SELECT site, ord, url FROM mapped""",
        "discover_urls": discovered(250),
        # Five urls reached (duplicates count): the last child is not read.
        "sitemap_index_cap": discovered(5, skip=((1, "3"),)),
        "title_optimized": f"{PLAIN_RECORDS} SELECT page_id, {optimized_title('h1', 'domain')} AS title FROM records",
        "sentence_pack": f"WITH {packed_ctes('documents', 'doc_id', 'text')} SELECT k AS doc_id, packed FROM packed",
        "trim_60": documents(trimmed_to("text", 60), "trimmed"),
        "trim_155": documents(trimmed_to("text", 155), "trimmed"),
        "trim_160": documents(trimmed_to("text", 160), "trimmed"),
        "meta_rules": f"{META} SELECT {meta_scalars} FROM meta",
        "overrides_apply": f"{META_OVERRIDDEN} SELECT {meta_scalars} FROM meta",
        "og_twitter": f"""{META} SELECT page_id, title AS og_title, description AS og_description, url AS og_url,
          {og_type} AS og_type, '{R.LOCALE}' AS og_locale, og_image, '{R.TWITTER_CARD}' AS tw_card,
          title AS tw_title, description AS tw_description FROM meta""",
        "jsonld_build": f"{META} SELECT page_id, {json_ld()} AS jsonld FROM meta",
        "robots_variants": f"""SELECT page_id, '{R.ROBOTS_OPEN}' AS standard, '{R.ROBOTS_OPEN}' AS ai_open,
          '{R.ROBOTS_NO_AI}' AS ai_block FROM pages""",
        "llms_txt": f"{META} SELECT page_id, {llms()} AS llms_txt FROM meta",
        "prompt_build": f"{META_OVERRIDDEN} SELECT page_id, {prompt()} AS prompt FROM meta",
        "provider_lookup": f"""WITH {ANSWERS}, {REGISTRY} SELECT page_id, provider, provider_name, label, default_model, payload_kind
          FROM answers JOIN registry ON provider_key = {_PROVIDER_KEY}""",
        "request_payload": f"""WITH {ANSWERS}, {REGISTRY} SELECT page_id, CASE payload_kind
            WHEN 'messages' THEN '{{"model":' || to_json(default_model) || ',"max_tokens":{M.MAX_TOKENS},"messages":[{{"role":"user","content":' || to_json(answer) || '}}]}}'
            WHEN 'chat' THEN '{{"model":' || to_json(default_model) || ',"messages":[{{"role":"user","content":' || to_json(answer) || '}}]}}'
            WHEN 'contents' THEN '{{"contents":[{{"parts":[{{"text":' || to_json(answer) || '}}]}}],"generationConfig":{{"responseMimeType":"application/json"}}}}'
            END AS request_json FROM answers JOIN registry ON provider_key = {_PROVIDER_KEY}""",
        "response_text": f"WITH {texts_ctes()} SELECT page_id, text, error FROM texts",
        "response_salvage": f"WITH {ANSWERS} SELECT page_id, {salvage('answer')} AS salvaged FROM answers",
        "response_apply": response_apply,
        "mode_dispatch": f"""SELECT 'none' AS mode, url, title, false AS ai_powered FROM ({META} SELECT url, title FROM meta)
          UNION ALL SELECT 'model', url, title, ai_powered FROM ({response_apply})""",
        "model_generate": f"""{META_OVERRIDDEN}, prompts AS (SELECT page_id, url, {prompt()} AS prompt FROM meta)
          SELECT url, CASE WHEN length(prompt) % 3 = 0 THEN NULL ELSE '{{"title":"' || length(prompt) || '"}}' END AS text,
            CASE WHEN length(prompt) % 3 = 0 THEN 'API error 400: rejected' END AS error FROM prompts""",
        "model_attempts": f"""{META_OVERRIDDEN}, prompts AS (SELECT url, length({prompt()}) AS k FROM meta),
          planned AS (SELECT *, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 5 = 0 THEN 2 WHEN k % 7 = 0 THEN 3 ELSE 1 END AS attempts FROM prompts),
          made AS (SELECT *, n = attempts AND k % 3 <> 0 AND (k % 5 = 0 OR k % 7 <> 0) AS ok
            FROM planned CROSS JOIN (VALUES (1), (2), (3)) m(n) WHERE n <= attempts)
          SELECT url, n, ok, n = attempts AS final, CASE WHEN ok THEN 'text' END AS text,
            CASE WHEN ok THEN NULL WHEN k % 3 = 0 THEN 'API error 400: rejected' WHEN k % 5 = 0 THEN 'API error 503: busy'
            ELSE 'API error 429: slow down' END AS error, attempts FROM made""",
        "fetch_gate": f"WITH f AS ({FETCHED}) SELECT page_id, {gate('url', 'http_status', 'fetch_error', 'html')} AS error, {code(gate('url', 'http_status', 'fetch_error', 'html'))} AS error_code FROM f",
        "job_rows": f"WITH {JOB} SELECT job_id, pos, url, {', '.join(_FIELDS)} FROM job",
        "job_summary": f"WITH {JOB} {SUMMARY}",
        "retry_set": f"WITH {JOB} SELECT job_id, url FROM job WHERE status = 'error'",
        "retry_merge": f"""{retry} SELECT job_id, j.url AS url,
            CASE WHEN status = 'ok' OR a.url IS NULL THEN status WHEN e IS NULL THEN 'ok' ELSE 'error' END AS status,
            CASE WHEN status = 'ok' OR a.url IS NULL THEN error ELSE e END AS error
          FROM job j LEFT JOIN again a ON j.url = a.url""",
        "attempts_resolved": RESOLVED,
        "job_latest": LATEST,
        "job_ttl": f"""WITH l AS ({LATEST}), m AS (SELECT max(updated) AS now FROM l)
          SELECT job_id, updated, now - updated > 3600 AS expired FROM l, m""",
        "length_compliance": f"""{META} SELECT page_type, count(*) AS n,
            count(*) FILTER (length(title) BETWEEN 50 AND 60) AS title_ok,
            count(*) FILTER (length(description) BETWEEN 150 AND 160) AS description_ok
          FROM meta GROUP BY page_type""",
        "rate_limit": RATE_LIMIT,
        "job_frontier": f"""WITH found AS (SELECT * FROM ({discovered(250)})),
          found_jobs AS (SELECT 'job-' || page_id || '-' || k AS job_id, f.pos, f.url
            FROM pages CROSS JOIN (VALUES (0), (1)) n(k) LEFT JOIN found f ON f.site = {I.SITES['site']})
          SELECT * FROM found_jobs UNION ALL
          SELECT 'job-' || page_id || '-2', pos::BIGINT, CASE pos WHEN 1 THEN 'https://x.example.com/' || page_id ELSE url END
          FROM pages CROSS JOIN (VALUES (0), (1), (2)) n(pos) WHERE page_id % 2 = 0""",
        "url_lists": """WITH listed AS (SELECT page_id, 0 AS pos, url AS u FROM pages WHERE page_id % 2 = 0
            UNION ALL SELECT page_id, 1, 'https://x.example.com/' || page_id FROM pages WHERE page_id % 2 = 0)
          SELECT 'job-' || page_id AS job_id, pos::BIGINT AS pos, u AS url, NULL::VARCHAR AS site FROM listed
          UNION ALL SELECT 'job-' || page_id, 0, NULL, url FROM pages WHERE page_id % 2 = 1""",
        "records_roundtrip": f"""SELECT * FROM ({META_OVERRIDDEN} SELECT url, title, description, keywords FROM meta)
          UNION ALL SELECT * FROM ({META} SELECT url, title, description, keywords FROM meta)""",
        "job_events": events_of(JOB),
        "stream_feed": events_of(ALL_JOBS),
        "address_key": f"""SELECT event_id, regexp_replace(coalesce({I.ADDRESS}, '0'), '[^a-fA-F0-9.:]', '', 'g') AS key FROM events""",
        "job_id_clean": f"""SELECT event_id, regexp_replace(coalesce({I.JOB_NAME}, ''), '[^a-zA-Z0-9_-]', '', 'g') AS job_id FROM events""",
        "csv_export": f"WITH {rows_ctes(FETCHED)} SELECT page_id, url, title, description, status, error FROM results",
        "job_document": f"WITH {JOB} {SUMMARY}",
        "stream_pages": f"WITH {rows_ctes('SELECT *, 200 AS http_status, NULL::VARCHAR AS fetch_error FROM pages')} SELECT page_id, url, {', '.join(_FIELDS)} FROM results",
        "stream_counters": """SELECT 'job-' || user_id AS job_id, count(*) AS done, count(*) FILTER (event_type = 'error') AS errors,
          count(*) FILTER (event_type <> 'error') AS success FROM events GROUP BY user_id""",
        "stream_rate_limit": RATE_LIMIT,
        "stream_rate_limit_restarted": RATE_LIMIT,
        "stream_latest_state": f"""WITH l AS ({LATEST}), m AS (SELECT max(updated) AS now FROM l)
          SELECT l.*, now - updated > 3600 AS expired FROM l, m""",
    }
