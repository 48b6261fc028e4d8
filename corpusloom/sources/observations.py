"""Where observations of pages come from: stored bodies, Markdown corpora, a pluggable live source."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.functions.text import frontmatter

RETRY_STATUS = (429, 503)


def fetch_politely(get: Callable[[str, dict], tuple[int, dict, bytes]], url: str, headers: dict, tries: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> tuple[int, dict, bytes]:
    """``get`` up to ``tries`` times: on 429 or 503 after the server's Retry-After, else after a doubling wait.

    Any other status comes back as it is; an error of the last try is raised.
    """
    for n in range(tries):
        last = n == tries - 1
        try:
            status, found, body = get(url, headers)
        except OSError:
            if last:
                raise
            sleep(wait * 2**n)
            continue
        if status not in RETRY_STATUS or last:
            return status, found, body
        after = {k.lower(): v for k, v in found.items()}.get("retry-after", "")
        sleep(float(after) if after.isdigit() else wait * 2**n)
    raise AssertionError("tries must be positive")


def fetched(requests: DataFrame, get: Callable[[str, dict], tuple[int, dict, bytes]]) -> DataFrame:
    """Observations of ``requests`` (url, headers map) through ``get``; a failed request has a null status."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, headers in zip(batch["url"], batch["headers"], strict=True):
                try:
                    status, found, body = fetch_politely(get, url, dict(headers or {}))
                    rows.append((url, status, {k.lower(): v for k, v in found.items()}.get("content-type"), found, body.decode("utf-8", "replace")))
                except OSError:
                    rows.append((url, None, None, {}, None))
            yield pd.DataFrame(rows, columns=["url", "status", "content_type", "headers", "body"])

    return requests.select("url", "headers").mapInPandas(run, "url string, status int, content_type string, headers map<string,string>, body string")


def stored_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (sha256, body) of content-addressed files under ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1).alias("sha256"), F.col("content").alias("body")).where("sha256 != ''")


def bodies(spark: SparkSession, manifest: DataFrame, first: str, second: str) -> DataFrame:
    """``manifest`` (sha256, ...) with each body from the ``first`` store, else the ``second``, else null."""
    a = stored_bodies(spark, first).withColumnRenamed("body", "a")
    b = stored_bodies(spark, second).withColumnRenamed("body", "b")
    return manifest.join(a, "sha256", "left").join(b, "sha256", "left").withColumn("body", F.coalesce("a", "b")).drop("a", "b")


def markdown_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, meta, body) of the Markdown files under ``folder``."""
    files = spark.read.text(f"{folder}/*.md", wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), frontmatter(F.col("value")).alias("f")).select("path", "f.meta", "f.body")


class _Part(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], each: int) -> None:
        self.urls, self.each = urls, each

    def partitions(self):
        return [_Part(self.urls[k : k + self.each]) for k in range(0, len(self.urls), self.each)]

    def read(self, partition):
        import urllib.error
        import urllib.request

        def get(url: str, headers: dict) -> tuple[int, dict, bytes]:
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as reply:  # noqa: S310
                    return reply.status, dict(reply.headers), reply.read()
            except urllib.error.HTTPError as reply:
                return reply.code, dict(reply.headers), reply.read()

        for url in partition.urls:
            status, headers, body = fetch_politely(get, url, {})
            yield url, status, {k.lower(): v for k, v in headers.items()}.get("content-type"), body.decode("utf-8", "replace")


class HttpSource(DataSource):
    """``spark.read.format("http_pages").option("urls", "u1 u2")``: ``each`` (100) URLs a partition."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, status int, content_type string, body string"

    def reader(self, schema):
        return _Reader(self.options.get("urls", "").split(), max(1, int(self.options.get("each", "100"))))
