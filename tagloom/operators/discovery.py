"""URL discovery: site, sitemap and robots tables to an ordered frontier.

Order is data here: every step carries a sortable position, nothing relies on
row order.  Sitemap documents are parsed once into a table.  How many urls an index
brings is computed once per document, from its children up, whoever lists it; then
each site's first candidate with urls is walked down once, a document at the first
place that lists it.  Both directions join narrow edges, a round per nesting level,
and url arrays are exploded at the end for the documents that survived.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tagloom.config import DEFAULTS, Options
from tagloom.functions import html as H
from tagloom.functions.sql_text import present_sql, trim_sql
from tagloom.functions.text import falsy, trimmed
from tagloom.functions.urls import (
    canonical_url,
    is_followable,
    resolve_link,
    site_base,
    strip_trailing_slashes,
    url_host,
)
from tagloom.operators.joins import lookup
from tagloom.session import materialize

# Where a sitemap is looked for, in this order.
SITEMAP_CANDIDATES = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/")
ROBOTS_FILE = "/robots.txt"
# UNIX-lines mode: only \n ends a line, as \r is trimmed off the capture.
SITEMAP_DIRECTIVE = r"(?mid)^Sitemap:\s*(.+)$"

_CAP_PIECES = 64
_XML_SCHEMA = "url array<struct<loc:array<string>>>, sitemap array<struct<loc:array<string>>>"


def accepted_docs(site_docs: DataFrame) -> DataFrame:
    """Documents with a body and a status from 200 to 399."""
    return site_docs.filter(F.col("http_status").between(200, 399) & ~falsy("body"))


def parse_sitemaps(site_docs: DataFrame) -> DataFrame:
    """``(doc_url, is_index, children, urls)`` of every sitemap document.

    Malformed documents yield nothing.  A document with any ``<sitemap>`` is an
    index and its own urls do not count.
    """

    def locs(entries: str) -> str:
        first = f"transform({entries}, e -> {trim_sql('get(e.loc, 0)')})"
        return f"filter(coalesce({first}, array()), u -> {present_sql('u')})"

    candidates = accepted_docs(site_docs).filter(F.col("body").rlike(r"<(?:sitemap|url)[\s/>]"))
    parsed = candidates.select("doc_url", F.from_xml("body", _XML_SCHEMA).alias("_x")).select(
        "doc_url",
        (F.coalesce(F.size("_x.sitemap"), F.lit(0)) > 0).alias("is_index"),
        F.expr(locs("_x.sitemap")).alias("children"),
        F.expr(locs("_x.url")).alias("_urls"),
    )
    return parsed.select(
        "doc_url",
        "is_index",
        "children",
        F.when(~F.col("is_index"), F.col("_urls"))
        .otherwise(F.array().cast("array<string>"))
        .alias("urls"),
    ).filter(F.col("is_index") | (F.size("urls") > 0))


def robots_targets(site_docs: DataFrame) -> DataFrame:
    """``(doc_url, pos, target)``: sitemap addresses named by robots files."""
    robots = accepted_docs(site_docs).filter(F.col("doc_url").endswith(ROBOTS_FILE))
    found = H.extract_all_sql("body", SITEMAP_DIRECTIVE, 1)
    return robots.select("doc_url", F.posexplode(F.expr(found)).alias("pos", "_target")).select(
        "doc_url", "pos", trimmed("_target").alias("target")
    )


def normalize_sites(sites: DataFrame) -> DataFrame:
    """``(site, page, base)`` of ``sites(site)``."""
    page = strip_trailing_slashes("site")
    return sites.select("site").distinct().select(
        "site", page.alias("page"), site_base(page).alias("base")
    )


def sitemap_candidates(sites: DataFrame, site_docs: DataFrame) -> DataFrame:
    """``(site, rank, doc_url)``: well-known places, then robots directives."""
    known = sites.select(
        "site",
        F.posexplode(
            F.array(*[F.concat("base", F.lit(path)) for path in SITEMAP_CANDIDATES])
        ).alias("rank", "doc_url"),
    )
    by_robots = sites.select("site", F.concat("base", F.lit(ROBOTS_FILE)).alias("_robots")).join(
        robots_targets(site_docs).withColumnRenamed("doc_url", "_robots"), "_robots"
    )
    first = len(SITEMAP_CANDIDATES)
    return known.unionByName(
        by_robots.select("site", (F.col("pos") + first).alias("rank"), F.col("target").alias("doc_url"))
    )


# Sizes beyond any cap are alike; without a cap they would outgrow 64 bits in deep lattices.
_MOST = 1 << 40


def _node(doc: str, root: Column | None = None) -> Column:
    """A place in the walk: a document, or a document as seen from ``root`` if it leads into a circle."""
    return F.struct((F.lit("") if root is None else root).alias("root"), F.col(doc).alias("doc"))


def index_edges(parsed: DataFrame, cap: int) -> DataFrame:
    """``(node, pos, child, n, child_round)``: an index and its children that exist.

    ``n`` is the number of urls a child brings, null while unknown.  What follows
    ``cap`` urls of earlier url lists is never reached, whatever nested indexes
    between them bring, and is left out here.
    """
    children = parsed.select(
        F.col("doc_url").alias("_child"),
        F.when(~F.col("is_index"), F.size("urls").cast("bigint")).alias("n"),
    )
    listed = parsed.filter("is_index").select("doc_url", F.posexplode("children").alias("pos", "_child"))
    earlier = Window.partitionBy("doc_url").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = lookup(listed, children, "_child", "inner").withColumn("_before", F.sum("n").over(earlier))
    found = found.filter(F.coalesce("_before", F.lit(0)) < cap)
    # An index of nothing that exists brings nothing.
    inner = found.select(F.col("doc_url").alias("_child")).distinct().withColumn("_inner", F.lit(True))
    known = lookup(found.drop("_before"), inner, "_child", "left")
    n = F.when(F.col("n").isNull() & F.col("_inner").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n"))
    return known.select(
        _node("doc_url").alias("node"), "pos", _node("_child").alias("child"), n.alias("n"), F.lit(0).alias("child_round")
    )


def resolve_sizes(edges: DataFrame, cap: int, first_round: int = 1) -> tuple[list[DataFrame], DataFrame | None]:
    """Sizes of indexes, each computed once from its children's: one table per round, and the edges left over.

    Round by round the nodes are resolved whose children are known, as far as the
    cap lets them be reached; a node with a ``total`` keeps its edges in that
    round's table.  Edges that no round resolves lead into circles.
    """
    by_pos = Window.partitionBy("node").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("node")
    reached = F.col("before") < cap
    rounds, left = [], edges
    while True:
        number = first_round + len(rounds)
        seen = Observation()
        sized = (
            left.withColumn("before", F.coalesce(F.sum("n").over(by_pos), F.lit(0)))
            .withColumn("_unknown", F.max(reached & F.col("n").isNull()).over(whole))
            .withColumn("total", F.when(~F.col("_unknown"), F.least(F.sum(F.when(reached, F.col("n"))).over(whole), F.lit(_MOST))))
            .drop("_unknown")
            .observe(seen, F.count("total").alias("resolved"), F.count(F.lit(1)).alias("rows"))
        )
        table = materialize(sized, "sitemap-sizes")
        counted = seen.get
        if not counted["resolved"]:
            return rounds, table if counted["rows"] else None
        rounds.append(table.filter("total IS NOT NULL").withColumn("round", F.lit(number)))
        if counted["resolved"] == counted["rows"]:
            return rounds, None
        totals = rounds[-1].groupBy(F.col("node").alias("child")).agg(F.max("total").alias("_n"))
        rest = table.filter("total IS NULL").drop("before", "total")
        left = lookup(rest, totals, "child", "left").select(
            "node", "pos", "child", F.coalesce("n", "_n").alias("n"),
            F.when(F.col("_n").isNotNull(), F.lit(number)).otherwise(F.col("child_round")).alias("child_round"),
        )


def open_circles(stuck: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges without circles below each of ``roots(doc)``, documents that lead into one.

    Seen from a root, a document that leads into a circle is followed only from
    documents nearer to the root.  Nothing that can be reached is lost, as shortest
    paths remain, and every circle is open.
    """
    inner = stuck.select(F.col("node.doc").alias("doc")).distinct()
    among = stuck.select(F.col("node.doc").alias("doc"), F.col("child.doc").alias("_to"))
    among = materialize(among.join(inner.select(F.col("doc").alias("_to")), "_to", "left_semi"), "sitemap-circles")
    front = roots.join(inner, "doc", "left_semi").select(F.col("doc").alias("root"), "doc").distinct()
    levels = [materialize(front.withColumn("level", F.lit(0)), "sitemap-levels")]
    while True:
        beyond = levels[-1].select("root", "doc").join(among, "doc").select("root", F.col("_to").alias("doc")).distinct()
        for level in levels:
            beyond = beyond.join(level.select("root", "doc"), ["root", "doc"], "left_anti")
        seen = Observation()
        beyond = beyond.withColumn("level", F.lit(len(levels))).observe(seen, F.count(F.lit(1)).alias("rows"))
        beyond = materialize(beyond, "sitemap-levels")
        if not seen.get["rows"]:
            break
        # One table of all levels after some rounds: the plan stays short.
        levels = [*levels, beyond] if len(levels) % 8 else [materialize(reduce(DataFrame.unionByName, levels), "sitemap-levels"), beyond]
    reached = reduce(DataFrame.unionByName, levels)
    edges = stuck.select(F.col("node.doc").alias("doc"), "pos", F.col("child.doc").alias("_to"), "n", "child_round")
    own = reached.join(edges, "doc")
    targets = reached.select("root", F.col("doc").alias("_to"), F.col("level").alias("_level"))
    met = own.join(targets, ["root", "_to"], "left").filter(F.col("_level").isNull() | (F.col("_level") > F.col("level")))
    child = F.when(F.col("_level").isNotNull(), _node("_to", F.col("root"))).otherwise(_node("_to"))
    return met.select(_node("doc", F.col("root")).alias("node"), "pos", child.alias("child"), "n", "child_round")


def first_visits(tops: DataFrame, rounds: list[DataFrame], cap: int) -> DataFrame:
    """``(site, path, doc_url)``: the url documents below ``tops(site, node, round)``, each at its first place.

    Every document lists only documents of earlier rounds, so going through the
    rounds backwards meets a document after all that list it: its smallest path
    is known and it is passed on once.
    """
    start = tops.select("site", F.array().cast("array<int>").alias("path"), "node", "round")
    reached = [materialize(start, "sitemap-visits")]
    for number in range(len(rounds), 0, -1):
        edges = rounds[number - 1].filter((F.col("before") < cap) & (F.col("n") > 0)).select("node", "pos", "child", "child_round")
        now = reduce(DataFrame.unionByName, reached).filter(F.col("round") == number)
        now = now.groupBy("site", "node").agg(F.min("path").alias("path"))
        below = now.join(edges, "node").select(
            "site", F.concat("path", F.array("pos")).alias("path"), F.col("child").alias("node"), F.col("child_round").alias("round")
        )
        reached.append(materialize(below, "sitemap-visits"))
    lists = reduce(DataFrame.unionByName, reached).filter("round = 0")
    return lists.groupBy("site", F.col("node.doc").alias("doc_url")).agg(F.min("path").alias("path"))


def _sitemap_plan(
    sites: DataFrame, site_docs: DataFrame, options: Options
) -> tuple[DataFrame, DataFrame]:
    """``roots(site, …)`` of sites with sitemap urls, and those urls."""
    parsed = parse_sitemaps(site_docs)
    unique = parsed.groupBy("doc_url").agg(
        F.max(F.struct("is_index", "children", "urls")).alias("_d")
    )
    parsed = materialize(unique.select("doc_url", "_d.*"), "sitemaps")
    cap = options.max_urls_per_site or sys.maxsize
    heads = parsed.select(
        "doc_url", "is_index", F.when(~F.col("is_index"), F.size("urls").cast("bigint")).alias("n")
    )
    # A robots file may name one address twice; the first place counts.
    candidates = sitemap_candidates(sites, site_docs).groupBy("site", "doc_url").agg(F.min("rank").alias("rank"))
    candidates = materialize(candidates.join(heads, "doc_url"), "sitemap-candidates")
    rounds, stuck = resolve_sizes(index_edges(parsed, cap), cap)
    if stuck is not None:
        opened = open_circles(stuck, candidates.filter("is_index").select(F.col("doc_url").alias("doc")))
        more, _ = resolve_sizes(opened, cap, len(rounds) + 1)
        rounds = rounds + more
    # Sizes belong to documents, so the first candidate that brings urls is found without a walk.
    tops = candidates.filter("NOT is_index").select("site", "rank", _node("doc_url").alias("node"), "n", F.lit(0).alias("round"))
    if rounds:
        sizes = reduce(DataFrame.unionByName, [r.select("node", "round", "total") for r in rounds])
        sizes = sizes.groupBy("node").agg(F.max(F.struct("round", "total")).alias("_s"))
        sizes = sizes.filter((F.col("node.root") == "") | (F.col("node.root") == F.col("node.doc")))
        sizes = sizes.select(F.col("node.doc").alias("doc_url"), "node", F.col("_s.total").alias("_n"), F.col("_s.round").alias("round"))
        indexes = lookup(candidates.filter("is_index").drop("n"), sizes, "doc_url", "inner")
        tops = tops.unionByName(indexes.select("site", "rank", "node", F.col("_n").alias("n"), "round"))
    first = tops.filter("n > 0").groupBy("site").agg(F.min(F.struct("rank", "node", "round")).alias("_t"))
    roots = materialize(first.select("site", "_t.node", "_t.round"), "sitemap-roots")
    documents = first_visits(roots, rounds, cap)
    urls = documents.join(parsed.select("doc_url", "urls"), "doc_url").select(
        "site", "path", F.posexplode("urls").alias("_i", "url")
    )
    return roots, urls.select("site", F.concat("path", F.array("_i")).alias("order"), "url")


def sitemap_urls(
    sites: DataFrame, site_docs: DataFrame, options: Options = DEFAULTS
) -> DataFrame:
    """``(site, order, url)`` of the first sitemap of each site that has urls.

    A document that is listed again counts towards the cap again, but its urls
    appear at its first place only.  ``sites`` is the output of ``normalize_sites``.
    """
    return _sitemap_plan(sites, site_docs, options)[1]


def page_links(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(…, pos, url)`` of ``pages(url, html)``: the page, then its links.

    Position 0 is the page's own address as given; links are resolved,
    canonical and without mail, phone and fragment targets.
    """
    kept = [f"`{c}`" for c in keep]
    hrefs = H.tag_attributes("_markup", "a", "href", ("href",))
    decoded = f"transform({hrefs}, a -> coalesce({trim_sql(H.decode_entities('a.href'))}, ''))"
    own = pages.selectExpr(
        *kept, "trim(TRAILING '/' FROM url) AS _page", f"{H.markup_of('html')} AS _markup"
    ).selectExpr(*kept, "_page", f"posexplode(concat(array(_page), {decoded})) AS (pos, _href)")
    resolved = own.filter((F.col("pos") == 0) | is_followable("_href")).select(
        *keep,
        "pos",
        "_page",
        F.when(F.col("pos") > 0, resolve_link("_href", "_page", site_base("_page"))).alias("_abs"),
    )
    url = F.when(F.col("pos") == 0, F.col("_page")).otherwise(canonical_url("_abs"))
    return resolved.select(*keep, "pos", url.alias("url")).filter(F.col("url").isNotNull())


def cap_frontier(
    urls: DataFrame, site: str, host: Column, order: list[str], options: Options = DEFAULTS
) -> DataFrame:
    """Unique same-host urls per site in order, at most the cap: ``(site, pos, url)``.

    Duplicates are combined map-side keeping the first position.  Ranks are taken
    twice: inside hashed pieces of a site, each of which passes on at most the
    cap, then over what they passed on.  So a site with a third of all urls is
    ranked by many tasks, whatever the cap and the planner's own thresholds.
    """
    first = urls.filter(url_host("url") == host).groupBy(site, "url").agg(
        F.min(F.struct(*order)).alias("_order")
    )
    pieces = F.pmod(F.xxhash64("url"), F.lit(_CAP_PIECES))
    rank = lambda *by: F.row_number().over(Window.partitionBy(site, *by).orderBy("_order", "url"))
    cap = options.max_urls_per_site
    if cap is not None:
        first = first.withColumn("_piece", pieces).withColumn("_rank", rank("_piece")).filter(F.col("_rank") <= cap)
    ranked = first.withColumn("_rank", rank())
    if cap is not None:
        ranked = ranked.filter(F.col("_rank") <= cap)
    return ranked.select(site, (F.col("_rank") - 1).alias("pos"), "url")


def discover_urls(
    sites: DataFrame, site_docs: DataFrame, options: Options = DEFAULTS
) -> DataFrame:
    """Ordered frontier ``(site, pos, url)`` of ``sites(site)``.

    ``site_docs(doc_url, http_status, body)`` holds fetched sitemaps, robots
    files and start pages.  Links are used only for sites without any sitemap
    url, whatever host those point to.
    """
    known = normalize_sites(sites)
    roots, mapped = _sitemap_plan(known, site_docs, options)
    unmapped = known.join(roots, "site", "left_anti")
    # Links are extracted where the bodies are; only narrow rows meet the sites.
    bodies = accepted_docs(site_docs).select(
        F.col("doc_url").alias("_start"), F.col("doc_url").alias("url"), F.col("body").alias("html")
    )
    linked = (
        page_links(bodies, keep=("_start",))
        .join(unmapped.select("site", F.col("page").alias("_start")), "_start")
        .select("site", F.array("pos").alias("order"), "url")
    )
    host = url_host(strip_trailing_slashes("site"))
    return cap_frontier(mapped.unionByName(linked), "site", host, ["order"], options)
