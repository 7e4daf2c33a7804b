import random

import pytest
from dataclasses import replace

from pyspark.sql import functions as F

from tagloom import DEFAULTS, canonical_url, discover_urls
from tagloom.functions.urls import is_followable, is_valid_url, resolve_link, site_base
from tagloom.operators.discovery import page_links


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def found(spark, site, docs, **options):
    rows = [(url, 200, body) if isinstance(body, str) else (url, *body) for url, body in docs.items()]
    site_docs = spark.createDataFrame(rows, "doc_url string, http_status int, body string")
    sites = spark.createDataFrame([(site,)], "site string")
    out = discover_urls(sites, site_docs, replace(DEFAULTS, **options)).orderBy("pos").collect()
    assert [r.pos for r in out] == list(range(len(out)))
    return [r.url for r in out]


def test_link_functions(spark):
    base, page = F.lit("https://a.com"), F.lit("https://a.com/blog")
    cases = {
        "/a/b?x=1#f": "https://a.com/a/b",
        "//cdn.example.com/x": "https://a.com//cdn.example.com/x",
        "sub/page.html": "https://a.com/blog/sub/page.html",
        "javascript:void(0)": "https://a.com/blog/javascript:void(0)",
        "https://OTHER.com:8443/p/": "https://OTHER.com/p",
        "https://a.com/": "https://a.com",
        "/": "https://a.com",
        "http": None,
        "https://u:p@a.com?q": "https://a.com",
    }
    df = spark.createDataFrame(list(cases.items()), "href string, want string")
    for row in df.withColumn("got", canonical_url(resolve_link("href", page, base))).collect():
        assert row.got == row.want, row.href
    skipped = spark.createDataFrame([(x,) for x in ["#x", "tel:1", "mailto:a", "0", "", "TEL:1"]], "h string")
    assert [r[0] for r in skipped.select(is_followable("h")).collect()] == [False] * 5 + [True]


def test_url_checks(spark):
    good = ["https://a.com", "http://a-b.com:80/x?y#z", "ftp://h/x", "http://[::1]/", "http://u:p@h/", "http://a" + ".b" * 120 + ".", "mailto:x@y", "news:z", "http://" + "a" * 63 + ".b"]
    bad = ["a.com", "http://", "http://-a.com", "http://a_b.com", "http://ä.de", "http://a b", None, "http://a.com/ü", "http://a" + ".b" * 20_000, "mailto:", "http://" + "a" * 64 + ".b"]
    df = spark.createDataFrame([(x,) for x in good + bad], "u string")
    assert [r[0] for r in df.select(is_valid_url("u")).collect()] == [True] * len(good) + [False] * len(bad)
    sites = spark.createDataFrame([("https://a.com:81/x",), ("//a.com",)], "u string")
    assert [r[0] for r in sites.select(site_base("u")).collect()] == ["https://a.com", "https://"]


def test_sitemap_order_duplicates_and_hosts(spark):
    docs = {
        "https://a.com/sitemap.xml": urlset(
            "https://a.com/1", "https://b.com/", "https://a.com/1", "https://www.a.com/", " https://a.com/2 ", "0"
        ),
        "https://a.com/sitemap_index.xml": urlset("https://a.com/never"),
    }
    assert found(spark, "https://a.com/", docs) == ["https://a.com/1", "https://a.com/2"]


def test_first_non_empty_candidate_wins(spark):
    docs = {
        "https://a.com/sitemap.xml": (404, urlset("https://a.com/404")),
        "https://a.com/sitemap_index.xml": "<urlset><url>",
        "https://a.com/sitemap/": "<html><body>no</body></html>",
        "https://a.com/robots.txt": "sitemap: https://a.com/gone.xml\r\nSITEMAP:https://x.org/s.xml \r\n",
        "https://x.org/s.xml": urlset("https://a.com/via-robots"),
    }
    assert found(spark, "https://a.com", docs) == ["https://a.com/via-robots"]


def test_index_cap_counts_duplicates(spark):
    docs = {
        "https://a.com/sitemap.xml": index(*(f"https://a.com/{i}.xml" for i in range(4))),
        "https://a.com/0.xml": urlset("https://a.com/a", "https://a.com/b"),
        "https://a.com/2.xml": urlset("https://a.com/b", "https://a.com/c", "https://a.com/d"),
        "https://a.com/3.xml": urlset("https://a.com/e"),
    }
    letters = [f"https://a.com/{c}" for c in "abcde"]
    assert found(spark, "https://a.com", docs) == letters
    # 2 + 3 urls reach a cap of 5, so the last child is never read.
    assert found(spark, "https://a.com", docs, max_urls_per_site=5) == letters[:4]
    assert found(spark, "https://a.com", docs, max_urls_per_site=2) == letters[:2]


def test_nested_indexes_and_cycles_end(spark):
    docs = {
        "https://a.com/sitemap.xml": index("https://a.com/i1.xml", "https://a.com/u2.xml"),
        "https://a.com/i1.xml": index("https://a.com/i2.xml", "https://a.com/u1.xml"),
        "https://a.com/i2.xml": index("https://a.com/u3.xml", "https://a.com/i2.xml"),
        "https://a.com/u1.xml": urlset("https://a.com/1"),
        "https://a.com/u2.xml": urlset("https://a.com/2"),
        "https://a.com/u3.xml": urlset("https://a.com/3"),
    }
    want = ["https://a.com/3", "https://a.com/1", "https://a.com/2"]
    assert found(spark, "https://a.com", docs) == want


@pytest.mark.parametrize("n", [100, 300])
def test_deep_chains_and_self_references_lose_nothing(spark, n):
    urls = [f"https://a.com/p{i}" for i in range(n)]
    deep = {f"https://a.com/i{k}.xml": index(f"https://a.com/i{k + 1}.xml") for k in range(12)}
    deep |= {"https://a.com/sitemap.xml": index("https://a.com/i0.xml"), "https://a.com/i12.xml": urlset(*urls)}
    assert found(spark, "https://a.com", deep) == urls[:250]
    own = {
        "https://a.com/sitemap.xml": index("https://a.com/sitemap.xml", "https://a.com/u.xml"),
        "https://a.com/u.xml": urlset(*urls),
    }
    assert found(spark, "https://a.com", own) == urls[:250]
    assert found(spark, "https://a.com", own, max_urls_per_site=None) == urls


def test_links_only_without_any_sitemap_url(spark):
    page = '<a href="/x?q">x</a><a href="mailto:m">m</a><a href="#t">t</a><A HREF=y/>y</A><a href="https://b.com/">b</a><a href="/x">x</a>'
    docs = {"https://a.com/de?q=1": page}
    assert found(spark, "https://a.com/de?q=1", docs) == [
        "https://a.com/de?q=1", "https://a.com/x", "https://a.com/de",
    ]
    foreign = {**docs, "https://a.com/sitemap.xml": urlset("https://b.com/")}
    assert found(spark, "https://a.com/de?q=1", foreign) == []


def test_page_links_keep_order(spark):
    df = spark.createDataFrame([("https://a.com/", '<a href="/2">2</a><!-- <a href="/c"> --><a href="/1">1</a>')], "url string, html string")
    assert [r.url for r in page_links(df).orderBy("pos").collect()] == [
        "https://a.com", "https://a.com/2", "https://a.com/1",
    ]


def plain_walk(docs, root, cap):
    """Recursive reading of an index, children in order until the cap; no document lists itself over others."""
    kind, items = docs.get(root, ("list", []))
    if kind == "list":
        return list(items)
    urls = []
    for child in items:
        urls += plain_walk(docs, child, cap)
        if len(urls) >= cap:
            break
    return urls


def test_shared_indexes_equal_a_recursive_walk(spark):
    """Indexes that share children, at random; a document that is listed again counts again."""
    rng, bodies, want, sites = random.Random(8), [], {}, []
    for s in range(60):
        host, docs = f"https://s{s}.com", {}
        names = [f"{host}/d{i}.xml" for i in range(rng.randint(1, 14))]
        for i, name in enumerate(names):
            later = names[i + 1 :] + [f"{host}/gone.xml"]
            if rng.random() < 0.6:
                docs[name] = ("index", [rng.choice(later) for _ in range(rng.randint(1, 5))])
            else:
                docs[name] = ("list", [f"{host}/p{rng.randrange(30)}" for _ in range(rng.randint(0, 5))])
        docs[f"{host}/sitemap.xml"] = ("index", rng.sample(names, min(3, len(names))))
        bodies += [(u, 200, index(*x) if k == "index" else urlset(*x)) for u, (k, x) in docs.items()]
        urls = list(dict.fromkeys(plain_walk(docs, f"{host}/sitemap.xml", 7)))[:7]
        # Without any sitemap url the start page itself is the frontier; it is not in the table here.
        want |= {(f"{host}/", i): u for i, u in enumerate(urls)}
        sites.append((f"{host}/",))
    site_docs = spark.createDataFrame(bodies, "doc_url string, http_status int, body string")
    out = discover_urls(spark.createDataFrame(sites, "site string"), site_docs, replace(DEFAULTS, max_urls_per_site=7))
    assert {(r.site, r.pos): r.url for r in out.collect()} == want


def test_a_clique_of_indexes_and_a_lattice_end(spark):
    names = [f"https://a.com/i{k}.xml" for k in range(30)]
    clique = {n: index(*names, n.replace("/i", "/u")) for n in names}
    clique |= {n.replace("/i", "/u"): urlset(f"https://a.com/p{k}") for k, n in enumerate(names)}
    clique |= {"https://a.com/sitemap.xml": index(*names)}
    assert sorted(found(spark, "https://a.com", clique)) == sorted(f"https://a.com/p{k}" for k in range(30))
    two = ["l", "r"]
    lattice = {
        f"https://b.com/{s}{k}.xml": index(*[f"https://b.com/{t}{k + 1}.xml" for t in two]) for k in range(10) for s in two
    }
    lattice |= {f"https://b.com/{s}10.xml": urlset(f"https://b.com/{s}") for s in two}
    lattice |= {"https://b.com/sitemap.xml": index("https://b.com/l0.xml", "https://b.com/r0.xml")}
    assert found(spark, "https://b.com", lattice, max_urls_per_site=None) == ["https://b.com/l", "https://b.com/r"]
    # 2^10 repeated documents exceed the cap before the second half of the lattice; both urls stand in the first.
    assert found(spark, "https://b.com", lattice) == ["https://b.com/l", "https://b.com/r"]


def test_circles_lose_no_document_and_stop_where_the_cap_is_reached(spark):
    ring = {f"https://a.com/i{k}.xml": index(f"https://a.com/i{(k + 1) % 6}.xml", f"https://a.com/u{k}.xml") for k in range(6)}
    ring |= {f"https://a.com/u{k}.xml": urlset(f"https://a.com/p{k}") for k in range(6)}
    ring |= {"https://a.com/sitemap_index.xml": index("https://a.com/i2.xml")}
    assert found(spark, "https://a.com", ring) == [f"https://a.com/p{k}" for k in (1, 0, 5, 4, 3, 2)]
    # The cap is reached before the entry that closes the circle: no circle at all.
    early = {
        "https://a.com/sitemap.xml": index("https://a.com/u.xml", "https://a.com/sitemap.xml", "https://a.com/v.xml"),
        "https://a.com/u.xml": urlset(*[f"https://a.com/p{i}" for i in range(5)]),
        "https://a.com/v.xml": urlset("https://a.com/v"),
    }
    assert found(spark, "https://a.com", early, max_urls_per_site=5) == [f"https://a.com/p{i}" for i in range(5)]
    assert found(spark, "https://a.com", early, max_urls_per_site=6)[-1] == "https://a.com/v"
