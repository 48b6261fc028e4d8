"""What is due: for fetching, extraction, embedding."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions.urls import ttl_days


def is_due(as_of: datetime) -> Column:
    return (F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= F.lit(as_of))) & (F.col("state") != "gone")


def due_batch(resource: DataFrame, as_of: datetime, limit: int = DEFAULT.frontier_batch) -> DataFrame:
    """The next resources to fetch: never fetched first, then by tier and due time; a top-k, no full sort."""
    order = [F.col("last_fetched_at").isNull().desc(), "priority", "next_fetch_at", "url"]
    return resource.where(is_due(as_of)).orderBy(*order).limit(limit).select("id", "url", "priority", F.unix_millis("next_fetch_at").alias("due_ms"))


def reschedule(resource: DataFrame, as_of: datetime, error_hours: int = DEFAULT.error_hours, gone_days: int = DEFAULT.gone_days) -> DataFrame:
    """Rows (id, next_ms): when each resource is due after a fetch at ``as_of`` with the outcome its state shows."""
    now = F.lit(as_of)
    after = F.when(F.col("state") == "error", now + F.expr(f"interval {error_hours} hours")).when(F.col("state") == "gone", now + F.expr(f"interval {gone_days} days"))
    return resource.select("id", F.unix_millis(after.otherwise(now + F.make_dt_interval(ttl_days(F.col("priority"))))).alias("next_ms"))


def request_headers(resource: DataFrame) -> DataFrame:
    """Rows (id, url, if_none_match, if_modified_since): conditional requests, null where nothing is known."""
    return resource.select("id", "url", F.col("etag").alias("if_none_match"), F.col("last_modified").alias("if_modified_since"))


def http_date(text: Column) -> Column:
    """A date in a header's or ISO form as a timestamp, null if it is neither."""
    header = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(header, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text)))


def modified_since(entries: DataFrame, resource: DataFrame) -> DataFrame:
    """Rows (id): resources whose listed modification date (url, lastmod) is after their last change; null is long ago."""
    dated = entries.select("url", http_date(F.col("lastmod")).alias("modified")).where(F.col("modified").isNotNull())
    return resource.join(dated, "url").where(F.col("modified") > F.coalesce("last_changed_at", F.timestamp_seconds(F.lit(0)))).select("id").distinct()


def needs_extract(resource: DataFrame, text: DataFrame) -> DataFrame:
    """Resources with a body of which no text was made: anti join on id and sha."""
    have = text.select(F.col("resource_id").alias("id"), F.lower("sha256").alias("sha"))
    return resource.where(F.col("sha256").isNotNull()).select("id", F.lower("sha256").alias("sha")).distinct().join(have, ["id", "sha"], "left_anti")


def needs_embed(text: DataFrame, chunk: DataFrame) -> DataFrame:
    """Resources whose ok text has no chunk of its content."""
    have = chunk.select("resource_id", F.lower("source_sha").alias("sha"))
    return text.where(F.col("status") == "ok").select("resource_id", F.lower("sha256").alias("sha")).distinct().join(have, ["resource_id", "sha"], "left_anti")


def needs_clear(text: DataFrame, chunk: DataFrame) -> DataFrame:
    """Resources whose text is no longer ok but that have chunks."""
    return text.where(F.col("status") != "ok").select("resource_id").distinct().join(chunk.select("resource_id"), "resource_id", "left_semi")
