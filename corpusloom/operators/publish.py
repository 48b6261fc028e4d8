"""Blobs between a local and a remote store: where they are, which are held, copying and stamping."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize
from corpusloom.sources.blobs import listing, put_if_absent

#: Keys of an older layout, which are never published.
LOCAL_PREFIX = "local/"


def unpublished(blob: DataFrame) -> DataFrame:
    """One row (n): the blobs without a mark of publication."""
    return blob.where(F.col("synced_at").isNull()).agg(F.count("*").alias("n"))


def held(blob: DataFrame) -> DataFrame:
    """The blobs to publish: without a mark, and with a key that is not of the older layout."""
    return blob.where(F.col("synced_at").isNull() & (F.coalesce("storage_key", F.lit("")) != "") & ~F.col("storage_key").startswith(LOCAL_PREFIX))


def located(blob: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """``blob`` with the columns in_local and in_remote: whether the listings (sha256) of the stores have it."""
    out = blob
    for listing, name in ((local, "in_local"), (remote, "in_remote")):
        out = out.join(listing.select("sha256", F.lit(True).alias(name)).distinct(), "sha256", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def push_plan(blob: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows (sha256, storage_key, size_bytes, outcome) of the held blobs: stamped (already there), copied, or missing at the source."""
    outcome = F.when(F.col("in_remote"), "stamped").when(F.col("in_local"), "copied").otherwise("missing")
    return located(held(blob), local, remote).select("sha256", "storage_key", "size_bytes", outcome.alias("outcome"))


def stamped(blob: DataFrame, plan: DataFrame, as_of: datetime) -> DataFrame:
    """The next snapshot of ``blob``: those that the plan found or copied are marked as published at ``as_of``."""
    done = plan.where(F.col("outcome").isin("stamped", "copied")).select("sha256", F.lit(True).alias("_done"))
    return blob.join(done, "sha256", "left").withColumn("synced_at", F.when(F.col("_done"), F.lit(as_of)).otherwise(F.col("synced_at"))).select(*blob.columns)


def push(blob: DataFrame, bodies: DataFrame, remote_path: str, as_of: datetime, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(plan, next snapshot of ``blob``): copy the held ``bodies`` (sha256, body) that the store at ``remote_path`` lacks.

    A blob is marked only once its body is there. With ``dry_run`` nothing is copied or marked. Running again copies nothing.
    """
    held_there = listing(blob.sparkSession, remote_path)
    remote = bodies.select("sha256").limit(0) if held_there is None else held_there
    plan = materialize(push_plan(blob, bodies.select("sha256"), remote))
    if dry_run:
        return plan, blob
    put_if_absent(bodies.join(plan.where("outcome = 'copied'").select("sha256"), "sha256", "left_semi"), remote_path)
    return plan, stamped(blob, plan, as_of)


def push_counts(plan: DataFrame) -> DataFrame:
    """One row (held, copied, bytes, stamped, missing): what is copied is stamped too."""
    copied = F.col("outcome") == "copied"
    return plan.agg(F.count("*").alias("held"), F.count_if(copied).alias("copied"), F.coalesce(F.sum(F.when(copied, F.col("size_bytes"))), F.lit(0)).cast("bigint").alias("bytes"), F.count_if(F.col("outcome") != "missing").alias("stamped"), F.count_if(F.col("outcome") == "missing").alias("missing"))


def blob_view(resource: DataFrame, blob: DataFrame) -> DataFrame:
    """Rows (id, url, title, sha256, storage_key, content_type, size_bytes): each resource with the archived copy it can be shown by."""
    kept = blob.select(F.lower("sha256").alias("sha256"), "storage_key", F.col("content_type").alias("blob_type"), F.col("size_bytes").alias("blob_size")).dropDuplicates(["sha256"])
    rows = resource.select("id", "url", "title", F.lower("sha256").alias("sha256"), "content_type").join(kept, "sha256", "left")
    return rows.select("id", "url", "title", "sha256", "storage_key", F.coalesce("blob_type", "content_type").alias("content_type"), F.col("blob_size").alias("size_bytes"))


def cascade(removed: DataFrame, resource: DataFrame, owned: dict[str, DataFrame], link: DataFrame) -> dict[str, DataFrame]:
    """The next snapshots after the resources ``removed`` (id) are deleted: what they own goes with them.

    ``owned`` tables have a resource_id; links from a removed resource go, links to it lose their target's id.
    """
    ids = removed.select("id").distinct()
    out = {"resource": resource.join(ids, "id", "left_anti")}
    out |= {name: df.join(ids.select(F.col("id").alias("resource_id")), "resource_id", "left_anti").select(*df.columns) for name, df in owned.items()}
    kept = link.join(ids.select(F.col("id").alias("from_resource_id")), "from_resource_id", "left_anti")
    lost = ids.select(F.col("id").alias("to_resource_id"), F.lit(True).alias("_gone"))
    out["link"] = kept.join(lost, "to_resource_id", "left").withColumn("to_resource_id", F.when(F.col("_gone"), None).otherwise(F.col("to_resource_id"))).select(*link.columns)
    return out
