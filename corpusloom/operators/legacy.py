"""The older pipeline over pages in Markdown files: manifest, files with a header, state, terms and sources of an answer."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.answer import cited_numbers

# Characters below which a body is not written, and characters a page below which it was likely scanned.
LEAST_BODY, SCANNED_BELOW = 80, 100


def fetched_pages(manifest: DataFrame) -> DataFrame:
    """Rows of the manifest that were fetched and stored."""
    return manifest.where((F.col("status") == 200) & (F.coalesce("local_path", F.lit("")) != ""))


def to_extract(manifest: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """``manifest`` (url, sha256, ...) without what ``state`` (url, sha256) shows extracted with the same content."""
    return manifest if force else manifest.join(state.select("url", "sha256").distinct(), ["url", "sha256"], "left_anti")


def next_state(state: DataFrame, done: DataFrame) -> DataFrame:
    """``state`` (url, sha256) with the content of ``done``, one row a URL."""
    new = done.select("url", "sha256").dropDuplicates(["url"])
    return state.join(new.select("url"), "url", "left_anti").unionByName(new)


def markdown_file(meta: dict[str, Column], body: Column) -> Column:
    """A Markdown file with a header of the values that are not null; null for a body of fewer than LEAST_BODY characters."""
    lines = F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f'{name}: "'), F.regexp_replace(v, '"', "'"), F.lit('"'))) for name, v in meta.items()]))
    text = F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), F.btrim(body), F.lit("\n"))
    return F.when(F.char_length(F.btrim(body)) >= LEAST_BODY, text)


def chars_a_page(chars: Column, pages: Column) -> Column:
    """The mean number of characters a page, 0 without pages."""
    return F.when(pages > 0, chars / pages).otherwise(0.0)


def needs_ocr(documents: DataFrame) -> DataFrame:
    """``documents`` (url, chars, pages) that were likely scanned, as rows (url, chars_per_page)."""
    rate = chars_a_page(F.col("chars"), F.col("pages"))
    return documents.withColumn("chars_per_page", rate).where(F.col("chars_per_page") < SCANNED_BELOW).select("url", "chars_per_page")


@F.udf(T.StringType())
def sorted_url(url: str | None) -> str | None:
    """A URL without fragment and tracking parameters, its parameters sorted by name and value, blank ones kept."""
    from corpusloom.config import TRACKING_PREFIXES

    if url is None:
        return None
    parts = urlsplit(url)
    pairs = sorted(p for p in parse_qsl(parts.query, keep_blank_values=True) if not p[0].lower().startswith(TRACKING_PREFIXES))
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), parts.path or "/", urlencode(pairs), ""))


def query_terms(question: Column) -> Column:
    """The terms of a question, runs of ASCII letters, digits and apostrophes."""
    return F.regexp_extract_all(question, F.lit(r"[A-Za-z0-9']+"), F.lit(0))


def match_expression(question: Column) -> Column:
    return F.array_join(query_terms(question), " OR ")


def source_footer(answer: Column, sources: Column) -> Column:
    """The lines "[n] url" of the sources (array of URLs, numbered from 1) that an answer cites; '' if it cites none."""
    used = F.filter(cited_numbers(answer), lambda n: (n >= 1) & (n <= F.size(sources)))
    return F.array_join(F.transform(used, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.element_at(sources, n))), "\n")
