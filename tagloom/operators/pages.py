"""Page extraction: ``(url, html)`` rows to page records.

A narrow, shuffle-free job.  HTML is the heavy column, so it is cleaned once and
dropped as early as possible; each stage is its own projection because a stage's
result is referenced several times by the next one (Catalyst keeps a projection
apart when merging it would duplicate expensive expressions).  The output is
flat, so a consumer that needs two fields prunes the rest of the work away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.config import DEFAULTS, Options
from tagloom.functions import html as H
from tagloom.functions.json_text import has_json_value
from tagloom.functions.sql_text import quote, trim_sql
from tagloom.functions.urls import url_host

# Existing tags, as (field, meta name) and (field, property).
META_NAMES = {
    "description": "description",
    "robots": "robots",
    "keywords": "keywords",
    "author": "author",
}
META_PROPERTIES = {
    "og_title": "og:title",
    "og_desc": "og:description",
    "og_image": "og:image",
    "og_type": "og:type",
    "tw_card": "twitter:card",
    "tw_title": "twitter:title",
    "tw_desc": "twitter:description",
}
EXISTING_FIELDS = (
    "title description og_title og_desc og_image og_type tw_card "
    "tw_title tw_desc canonical robots keywords author"
).split()

# Structured-data types and URL patterns that decide the page type.
TYPES_BY_JSONLD = {
    "Article": "article",
    "BlogPosting": "article",
    "NewsArticle": "article",
    "Product": "product",
    "WebSite": "website",
    "LocalBusiness": "organization",
    "Organization": "organization",
}
ARTICLE_URL = "(?i)/blog/|/artikel/|/news/|/post/"
PRODUCT_URL = "(?i)/produkt|/product|/shop"
JSONLD_MEDIA_TYPE = "application/ld+json"

PAGE_FIELDS = (
    "url existing h1 h2s paragraphs jsonld page_type body_text domain".split()
)


def _page_type_sql(jsonld: str, url: str) -> str:
    cases = " ".join(f"WHEN {quote(name)} THEN '{kind}'" for name, kind in TYPES_BY_JSONLD.items())
    declared = f"""transform({jsonld}, x -> get_json_object(x, {quote("$['@type']")}))"""
    known = f"transform({declared}, t -> CASE t {cases} END)"
    return f"""coalesce(get(filter({known}, k -> k IS NOT NULL), 0), CASE
        WHEN {url} RLIKE {quote(ARTICLE_URL)} THEN 'article'
        WHEN {url} RLIKE {quote(PRODUCT_URL)} THEN 'product' ELSE 'website' END)"""


def page_type(jsonld: str, url: str) -> Column:
    """First recognised ``@type`` in document order, else by URL, else website.

    ``jsonld`` and ``url`` name columns.
    """
    return F.expr(_page_type_sql(jsonld, url))


def _wanted_metas(markup: str) -> str:
    """``name``, ``property``, ``content`` of the meta tags we look up."""
    metas = H.tag_attributes(markup, "meta", "content", ("name", "property", "content"))
    names = ", ".join(quote(n) for n in [*META_NAMES.values(), *META_PROPERTIES.values()])
    wanted = f"""filter({metas}, m -> m.content IS NOT NULL
        AND (coalesce(m.name IN ({names}), false) OR coalesce(m.property IN ({names}), false)))"""
    return f"""transform({wanted}, m -> struct(m.name AS name, m.property AS property,
        {trim_sql(H.decode_entities('m.content'))} AS content))"""


def _canonical_hrefs(markup: str) -> str:
    links = H.tag_attributes(markup, "link", "rel", ("rel", "href"))
    return f"filter({links}, x -> x.rel = 'canonical' AND x.href IS NOT NULL)"


def _existing(metas: str, title: str, links: str) -> str:
    def content(key: str, value: str) -> str:
        return f"get(filter({metas}, m -> m.{key} = {quote(value)}), 0).content"

    href = f"transform({links}, x -> {trim_sql(H.decode_entities('x.href'))})"
    fields = {
        "title": trim_sql(H.decode_entities(title)),
        "canonical": f"coalesce(get({href}, 0), '')",
    }
    for field, name in META_NAMES.items():
        fields[field] = f"coalesce({content('name', name)}, '')"
    for field, prop in META_PROPERTIES.items():
        fields[field] = f"coalesce({content('property', prop)}, {content('name', prop)}, '')"
    return "struct(" + ", ".join(f"{fields[f]} AS {f}" for f in EXISTING_FIELDS) + ")"


def extract_pages(
    pages: DataFrame, keep: tuple[str, ...] = (), options: Options = DEFAULTS
) -> DataFrame:
    """Page records of ``pages(url, html)``; ``keep`` names columns to carry.

    One row in, one row out, no exchange.
    """
    kept = [f"`{c}`" for c in keep if c != "url"]
    blocks = H.script_blocks("html", JSONLD_MEDIA_TYPE)
    cleaned = pages.selectExpr(
        *kept,
        "url",
        f"{H.markup_of('html')} AS _markup",
        f"filter(coalesce({blocks}, array()), x -> {has_json_value('x')}) AS jsonld",
    )
    paragraphs = H.paragraph_texts("_markup", options.paragraph_min_length)
    # The body refers to it several times: a projection of its own computes it once.
    plain = cleaned.select("*", F.expr(H.without_furniture("_markup")).alias("_plain"))
    parts = plain.selectExpr(
        *kept,
        "url",
        "jsonld",
        f"{H.element_text('_markup', 'title')} AS _title",
        f"{_wanted_metas('_markup')} AS _metas",
        f"{_canonical_hrefs('_markup')} AS _links",
        f"{H.element_text('_markup', 'h1')} AS _h1",
        f"slice({H.element_texts('_markup', 'h2')}, 1, {options.h2_limit or H.ALL}) AS h2s",
        f"slice({paragraphs}, 1, {options.paragraph_limit or H.ALL}) AS paragraphs",
        f"{H.drop_tags(H.body_markup('_plain'))} AS _body",
    )
    decoded = parts.selectExpr(
        *kept,
        "url",
        f"{_existing('_metas', '_title', '_links')} AS existing",
        f"{trim_sql(H.decode_entities('_h1'))} AS h1",
        "h2s",
        "paragraphs",
        f"transform(jsonld, x -> {trim_sql('x')}) AS jsonld",
        f"{_page_type_sql('jsonld', 'url')} AS page_type",
        f"{H.decode_entities('_body')} AS _text",
    )
    text = f"substring({H.flatten_text('_text')}, 1, {options.max_content_length})"
    computed = {
        "body_text": F.expr(text).alias("body_text"),
        "domain": url_host("url").alias("domain"),
    }
    return decoded.select(*kept, *[computed.get(f, F.col(f)) for f in PAGE_FIELDS])
