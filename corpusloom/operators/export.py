"""Objects for an outside index: one Markdown body a resource with three metadata values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions.text import meta_value


def index_objects(texts: DataFrame, resource: DataFrame, limit: int = DEFAULT.export_bytes) -> DataFrame:
    """Rows (key, body, url, title, kind, skip_reason) of every text; a skipped one has no body.

    Skipped are texts that are not ok, blank, or above ``limit`` bytes of UTF-8 (exactly that many are kept).
    """
    both = texts.select("resource_id", "status", "text").dropDuplicates(["resource_id"]).join(resource.select(F.col("id").alias("resource_id"), "url", "title", "kind").dropDuplicates(["resource_id"]), "resource_id")
    reason = F.when(F.col("status") != "ok", "not_ok").when(F.coalesce(F.btrim("text"), F.lit("")) == "", "blank").when(F.octet_length("text") > limit, "too_large")
    return both.select(
        F.concat(F.lit("index/"), F.col("resource_id"), F.lit(".md")).alias("key"), F.when(reason.isNull(), F.col("text")).alias("body"),
        meta_value(F.col("url")).alias("url"), meta_value(F.coalesce("title", "url")).alias("title"), meta_value(F.coalesce("kind", F.lit("page"))).alias("kind"), reason.alias("skip_reason"),
    )


def outcomes(objects: DataFrame) -> DataFrame:
    return objects.groupBy(F.coalesce("skip_reason", F.lit("exported")).alias("outcome")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).cast("bigint").alias("bytes"))


def write_objects(objects: DataFrame, path: str) -> None:
    """The exported objects as Parquet (key, body, metadata), one directory for a reader to pick up."""
    objects.where(F.col("skip_reason").isNull()).select("key", "body", F.struct("url", "title", "kind").alias("metadata")).write.mode("overwrite").parquet(path)
