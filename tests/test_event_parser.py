"""Body text and paragraphs against an independent event parser, on real rows."""

import html
import random
import re
from html.parser import HTMLParser

from tagloom import extract_pages
from tagloom.plans import inputs as I

FURNITURE = {"nav", "footer", "header"}
BLOCKS = set(
    "p div article section main aside ul ol li dl table h1 h2 h3 h4 h5 h6 nav footer header form "
    "body html blockquote pre".split()
)


class Model(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.skip, self.depth, self.raw, self.in_body = None, 0, False, False
        self.body, self.paragraphs, self.open = [], [], None

    def handle_starttag(self, tag, attrs):
        self.raw = tag in ("script", "style")
        if tag == "body":
            self.in_body = True
        if tag in FURNITURE and self.skip is None:
            self.skip = tag
        self.depth += tag == self.skip
        if tag in BLOCKS:
            self.close_paragraph()
        if tag == "p":
            self.open = []

    def handle_endtag(self, tag):
        self.raw = False
        if tag == self.skip:
            self.depth -= 1
            if not self.depth:
                self.skip = None
        if tag in BLOCKS:
            self.close_paragraph()
        if tag == "body":
            self.in_body = False

    def close_paragraph(self):
        if self.open is not None:
            self.paragraphs.append("".join(self.open))
            self.open = None

    def text(self, value):
        if self.raw:
            return
        if self.open is not None:
            self.open.append(value)
        if self.in_body and self.skip is None:
            self.body.append(value)

    handle_data = text

    def handle_entityref(self, name):
        self.text(html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.text(html.unescape(f"&#{name};"))


def nested(rng, depth):
    """Containers in containers, some never closed, some closed twice, with other markup between."""
    name = rng.choice(["nav", "NAV", "footer", "header"])
    inner = "".join(nested(rng, depth - 1) if rng.random() < 0.7 else f"<i>t{rng.randrange(99)}</i> " for _ in range(2)) if depth else "x"
    end = rng.choice([f"</{name}>"] * 12 + [f"</{name} >", "", f"</{name}></{name}>"])
    return f"a{depth} <{name} class='<nav>'>{inner}{end} b{depth} "


def test_text_agrees_with_event_parser(spark, sf_dir):
    rng = random.Random(6)
    shapes = [nested(rng, rng.randrange(7)) for _ in range(300)]
    shapes += ["<nav>" * n + "in" + "</nav>" * n + "out" + "<header>" * n + "</header>" * (n - 1) + "lost" for n in (1, 2, 50)]
    made = spark.createDataFrame(
        [(i, f"https://a.com/{i}", f"<html><body>{t}<p>end</p></body></html>") for i, t in enumerate(shapes)],
        "page_id long, url string, html string",
    )
    for pages in (I.pages(spark, sf_dir), I.pages_enriched(spark, sf_dir), made):
        source = {r.page_id: r.html for r in pages.collect()}
        for row in extract_pages(pages, keep=("page_id",)).collect():
            model = Model()
            model.feed(source[row.page_id])
            model.close()
            model.close_paragraph()
            text = re.sub(r"<(?:[^\s>][^>]*)?>|<[^\s>][^>]*\Z", "", "".join(model.body))
            assert row.body_text == re.sub(r"\s+", " ", text)
            long = [p.strip(" \t\n\r\0\x0b") for p in model.paragraphs if len(p) > 80]
            assert row.paragraphs == [p for p in long if p not in ("", "0")][:6]
