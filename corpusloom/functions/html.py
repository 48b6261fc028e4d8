"""HTML and XML: titles, links, volatile parts, text, sitemaps, headers."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import DOCUMENT_TYPES
from corpusloom.functions.text import clean_python

# The patterns the results depend on.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HREF = r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']+)[\"']"
LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"
URL_BLOCK = r"(?is)<url\b[^>]*>(.*?)</url>"
STATE_FIELD = r"(?i)(<input\b[^>]*\bname=\"(?:__[A-Za-z]+|[^\"]*Token[^\"]*)\"[^>]*\bvalue=\")[^\"]*(\")"
STATE_FIELD_REVERSED = r"(?i)(<input\b[^>]*\bvalue=\")[^\"]*(\"[^>]*\bname=\"(?:__[A-Za-z]+|[^\"]*Token[^\"]*)\")"
RANDOM_ID = r"(?i)\b(anch|row)[0-9a-f]{6,}\b"
SLIDES = r'<div class="widget slideShow\b'
CHROME = frozenset("script style noscript template svg nav header footer aside form iframe button".split())
BLOCKS = frozenset("address article blockquote br dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table tbody td th thead tr ul".split())


def page_title(html: Column) -> Column:
    """The first title with white space collapsed; null if there is none or it is empty. Entities stay."""
    return F.nullif(F.btrim(F.regexp_replace(F.regexp_extract(html, TITLE, 1), r"\s+", " ")), F.lit(""))


def raw_links(html: Column) -> Column:
    """The quoted targets of anchors in order, repeated ones too, without mail, phone, script and fragment links."""
    found = F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda x: F.btrim(x))
    return F.filter(found, lambda x: (x != "") & ~x.rlike("(?i)^(mailto:|tel:|javascript:|#)"))


def sitemap_locations(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(LOC), F.lit(1))


def sitemap_entries(xml: Column) -> Column:
    """array<struct<loc, lastmod, changefreq>> of the url blocks, or of bare locations where there is no block."""

    def tag(block: Column, name: str) -> Column:
        return F.nullif(F.regexp_extract(block, rf"(?i)<{name}>\s*([^<\s]+)\s*</{name}>", 1), F.lit(""))

    blocks = F.transform(F.regexp_extract_all(xml, F.lit(URL_BLOCK), F.lit(1)), lambda b: F.struct(tag(b, "loc").alias("loc"), tag(b, "lastmod").alias("lastmod"), tag(b, "changefreq").alias("changefreq")))
    full = F.filter(blocks, lambda e: e["loc"].isNotNull())
    none = F.lit(None).cast("string")
    bare = F.transform(sitemap_locations(xml), lambda x: F.struct(x.alias("loc"), none.alias("lastmod"), none.alias("changefreq")))
    return F.when(F.size(full) > 0, full).otherwise(bare)


def is_sitemap(url: Column, body: Column) -> Column:
    head = F.substring(body, 1, 500)
    return F.coalesce(url.endswith("sitemap.xml") | head.contains("<urlset") | head.contains("<sitemapindex"), F.lit(False))


def without_blocks(html: str, opening: str = SLIDES) -> str:
    """``html`` without the balanced div blocks that start with ``opening``; an unbalanced one stays with what follows."""
    out, at = [], 0
    start = re.compile(opening, re.I)
    tags = re.compile(r"<(/?)div(?:\b|>)", re.I)
    while found := start.search(html, at):
        depth, end = 0, None
        for tag in tags.finditer(html, found.start()):
            depth += -1 if tag[1] else 1
            if depth == 0:
                end = html.find(">", tag.start()) + 1
                break
        if not end:
            break
        out.append(html[at : found.start()])
        at = end
    return "".join(out) + html[at:]


@F.pandas_udf(T.StringType())
def _without_slides(html: pd.Series) -> pd.Series:
    return html.map(lambda h: without_blocks(h) if isinstance(h, str) else None)


def normalize_html(html: Column) -> Column:
    """``html`` without what changes at every request: slide shows, state and token values, random ids."""
    steady = F.when(html.rlike("(?i)" + SLIDES), _without_slides(html)).otherwise(html)
    steady = F.regexp_replace(steady, STATE_FIELD, "$1$2")
    steady = F.regexp_replace(steady, STATE_FIELD_REVERSED, "$1$2")
    return F.regexp_replace(steady, RANDOM_ID, "$1_")


class _Reader(HTMLParser):
    """Collects text by block with its share of link text; chrome elements are skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = [["", 0]]
        self.skipping: list[str] = []
        self.links = 0

    def handle_starttag(self, tag, attrs):
        if tag in CHROME:
            self.skipping.append(tag)
        elif tag == "a":
            self.links += 1
        elif tag in BLOCKS:
            self.blocks.append(["", 0])

    def handle_endtag(self, tag):
        if self.skipping and tag == self.skipping[-1]:
            self.skipping.pop()
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCKS:
            self.blocks.append(["", 0])

    def handle_data(self, data):
        if not self.skipping:
            self.blocks[-1][0] += data
            self.blocks[-1][1] += len(data) if self.links else 0


def html_text(html: str | None) -> tuple[str, str]:
    """(text, extractor) of a page: blocks that are mostly no links from the densest stretch, else all but chrome."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    kept = [(clean_python(t), links) for t, links in reader.blocks if t.strip()]
    dense = [t for t, links in kept if links <= 0.5 * len(t)]
    main = clean_python("\n".join(dense))
    if len(main) >= 200:
        return main, "density"
    return clean_python("\n".join(t for t, _ in kept)), "body"


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("text", "extractor", "status")]))
def extract_html(html: pd.Series) -> pd.DataFrame:
    rows = [html_text(h if isinstance(h, str) else None) for h in html]
    return pd.DataFrame([(t, e, "ok" if re.search(r"[^\W_]", t) else "empty") for t, e in rows], columns=["text", "extractor", "status"])


def content_type(header: Column) -> Column:
    """A content type without parameters, in lower case."""
    return F.lower(F.btrim(F.split_part(header, F.lit(";"), F.lit(1))))


def document_extension(kind: Column) -> Column:
    """The file extension of a document's content type, null for other types."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in DOCUMENT_TYPES.items() for x in pair]), kind)


def filename_hint(disposition: Column) -> Column:
    """The file name of a Content-Disposition header, null without one."""
    return F.nullif(F.btrim(F.regexp_extract(disposition, r"(?i)filename\*?=(?:UTF-8'')?\"?([^\";]+)\"?", 1)), F.lit(""))


def text_route(kind: Column) -> Column:
    """How a body of a content type becomes text: pdf, html or unsupported."""
    html = kind.isin("text/html", "text/xml", "application/xml") | kind.endswith("+xml")
    return F.when(kind == "application/pdf", "pdf").when(html, "html").otherwise("unsupported")
