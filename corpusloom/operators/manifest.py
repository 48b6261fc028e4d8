"""Changes and snapshots. Mutable tables are snapshots: each operator joins old rows and new ones to the next snapshot."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def classify(versions: DataFrame) -> DataFrame:
    """Each observation with its kind by the content before it: new, changed, unchanged, probed, or its failure.

    A missing sha keeps the one before; without sha an observation is probed if it is the first or its size differs.
    """
    order = Window.partitionBy("resource_id").orderBy("observed_at", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = versions.dropDuplicates(["id"])
    seen = seen.withColumn("sha_before", F.last("sha256", ignorenulls=True).over(before)).withColumn("size_before", F.last("size_bytes", ignorenulls=True).over(before)).withColumn("n_before", F.row_number().over(order) - 1)
    failed = F.col("change_kind").isin("gone", "error")
    by_sha = F.when(F.col("sha_before").isNull(), "new").when(F.col("sha_before") == F.col("sha256"), "unchanged").otherwise("changed")
    by_size = F.when((F.col("n_before") == 0) | ~F.col("size_bytes").eqNullSafe(F.col("size_before")), "probed").otherwise("unchanged")
    kind = F.when(failed, F.col("change_kind")).when(F.col("sha256").isNotNull(), by_sha).otherwise(by_size)
    return seen.select("id", "resource_id", kind.alias("kind"))


def latest(versions: DataFrame, key: str = "resource_id", at: str = "observed_at") -> DataFrame:
    """The newest row of each key; of equal times the greatest id. One aggregate, no sort of a hot key."""
    columns = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, "id")).alias("r")).select(key, "r.*")


def upsert_resources(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next snapshot of resources (id, url, sha256, size_bytes, state, first_seen_at, last_seen_at) keyed by url.

    First sights stay, a null sha keeps the old one, a row seen again is active.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.url").eqNullSafe(F.col("n.url")) & F.col("o.url").isNotNull(), "full_outer")
    found = F.col("n.url").isNotNull()

    def newer(c: str):
        return F.coalesce(f"n.{c}", f"o.{c}").alias(c)

    def older(c: str):
        return F.coalesce(f"o.{c}", f"n.{c}").alias(c)

    return both.select(older("id"), older("url"), newer("sha256"), newer("size_bytes"), F.when(found, "active").otherwise(F.col("o.state")).alias("state"), older("first_seen_at"), newer("last_seen_at"))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows and those of ``new`` whose key is not there, one a key."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def replace_groups(old: DataFrame, new: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """All rows of the ``rebuilt`` keys replaced by ``new``: both happen in the one new snapshot."""
    return old.join(rebuilt.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def add_references(blob: DataFrame, shas: DataFrame) -> DataFrame:
    """``blob`` (sha256, ref_count, ...) with the references of ``shas`` (sha256) added; unknown blobs are new rows."""
    more = shas.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.count("*").alias("more"))
    both = blob.join(more, "sha256", "full_outer")
    return both.withColumn("ref_count", F.coalesce("ref_count", F.lit(0)) + F.coalesce("more", F.lit(0))).drop("more")


def missing_copies(source: DataFrame, target: DataFrame, key: str = "sha256") -> DataFrame:
    """What ``source`` lists and ``target`` does not."""
    return source.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def push_outcomes(blob: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Counts by outcome of promoting held blobs (no sync mark): already there, copied, or missing at the source."""
    held = blob.where(F.col("synced_at").isNull()).select("sha256")
    seen = held.join(target.select("sha256", F.lit(True).alias("there")).distinct(), "sha256", "left").join(source.select("sha256", F.lit(True).alias("have")).distinct(), "sha256", "left")
    outcome = F.when(F.col("there"), "stamped").when(F.col("have"), "copied").otherwise("missing")
    return seen.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def sweep(workers: DataFrame, as_of: datetime, minutes: int, at: str = "heartbeat_at") -> DataFrame:
    """``workers`` without those whose last sign of life is older than ``minutes``."""
    return workers.where(F.col(at) >= F.lit(as_of) - F.expr(f"interval {minutes} minutes"))
