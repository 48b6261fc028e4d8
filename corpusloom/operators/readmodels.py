"""Read models over the manifest: counts, sums, health, lists. ``as_of`` is always a parameter, never the clock."""

from __future__ import annotations

import string
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.config import DEFAULT, KINDS


def n_if(condition: Column) -> Column:
    return F.count_if(condition)


def total(column: str) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def blobs(versions: DataFrame) -> DataFrame:
    """The content-addressed bodies of a change log: one row a blob with its first sight and number of references."""
    seen = versions.where(F.col("blob_sha256").isNotNull()).dropDuplicates(["id"])
    return seen.groupBy(F.lower("blob_sha256").alias("sha256")).agg(F.max("size_bytes").alias("size_bytes"), F.min("content_type").alias("content_type"), F.count("*").alias("ref_count"), F.min("observed_at").alias("created_at"))


def overview(resource: DataFrame, versions: DataFrame, blob: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: how many resources of which sort, versions, bytes stored and downloaded, runs. Four one-row aggregates."""
    r = resource.agg(F.count("*").alias("resources"), n_if(F.col("kind") == "document").alias("documents"), n_if(F.col("kind") == "page").alias("pages"), n_if(F.col("state") == "gone").alias("gone"))
    v = versions.agg(F.count_distinct("id").alias("versions"))
    b = blob.agg(F.count("*").alias("blobs"), total("size_bytes").alias("stored_bytes"))
    s = runs.agg(F.count("*").alias("runs"), total("bytes_downloaded").alias("downloaded_bytes"))
    return r.crossJoin(v).crossJoin(b).crossJoin(s)  # one row each


def storage_health(blob: DataFrame, resource: DataFrame, as_of: datetime) -> DataFrame:
    """One row: age extremes and half-open age classes of the blobs, and the backlog of the resources."""
    now = F.lit(as_of)

    def older(days: int) -> Column:
        return F.col("created_at") < now - F.expr(f"interval {days} days")

    ages = blob.agg(
        F.count("*").alias("objects"), total("size_bytes").alias("stored_bytes"), F.min(F.unix_millis("created_at")).alias("oldest_ms"), F.max(F.unix_millis("created_at")).alias("newest_ms"),
        n_if(~older(1)).alias("under_1d"), n_if(older(1) & ~older(7)).alias("d1_to_7"), n_if(older(7) & ~older(30)).alias("d7_to_30"), n_if(older(30)).alias("over_30d"),
    )
    health = resource.agg(
        n_if((F.col("state") == "active") & (F.col("next_fetch_at") <= now)).alias("stale_past_due"), n_if(F.col("state") == "error").alias("errors"), n_if(F.col("state") == "gone").alias("gone"),
    )
    return ages.crossJoin(health)  # one row each


def sync_progress(resource: DataFrame, as_of: datetime) -> DataFrame:
    """One row: fetched, due, and the core and document tiers, with the share fetched in percent."""
    due = (F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= F.lit(as_of))) & (F.col("state") != "gone")
    one = resource.agg(F.count("*").alias("total"), n_if(F.col("last_fetched_at").isNotNull()).alias("fetched"), n_if(due).alias("due"), n_if(F.col("priority") == 0).alias("core"), n_if(F.col("priority") >= 2).alias("docs"))
    return one.withColumn("percent", F.round(100 * F.col("fetched") / F.nullif(F.col("total"), F.lit(0)), 1))


def coverage_by_kind(resource: DataFrame) -> DataFrame:
    """Per kind, in display order: total, fetched, fetched share; kinds without order come last by name."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    out = resource.groupBy("kind").agg(F.count("*").alias("total"), n_if(F.col("last_fetched_at").isNotNull()).alias("fetched"))
    return out.withColumn("rank", F.when(rank == 0, len(KINDS) + 1).otherwise(rank)).orderBy("rank", "kind")


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def storage_by_type(blob: DataFrame, limit: int = 8) -> DataFrame:
    """The ``limit`` content types with most bytes."""
    return blob.groupBy(F.coalesce("content_type", F.lit("unknown")).alias("content_type")).agg(F.count("*").alias("objects"), total("size_bytes").alias("bytes")).orderBy(F.desc("bytes"), "content_type").limit(limit)


def matching(resource: DataFrame, text: str | None = None, kind: str | None = None, state: str | None = None) -> DataFrame:
    """Resources by optional conditions; ``text`` is a pattern within url or title, the case of ASCII letters has no meaning."""
    if text:
        upper, lower = string.ascii_uppercase, string.ascii_lowercase
        pattern = "%" + text.translate(str.maketrans(upper, lower)) + "%"
        resource = resource.where(F.translate("url", upper, lower).like(pattern) | F.translate("title", upper, lower).like(pattern))
    if kind:
        resource = resource.where(F.col("kind") == kind)
    if state:
        resource = resource.where(F.col("state") == state)
    return resource


def content_page(resource: DataFrame, page: int = 0, size: int = DEFAULT.page_size, **conditions: str) -> DataFrame:
    """One page of the matching resources, last changed first, null dates last."""
    found = matching(resource, **conditions).select("id", "url", "title", "kind", "state", F.unix_millis("last_changed_at").alias("changed_ms"), F.unix_millis("last_seen_at").alias("seen_ms"))
    return found.orderBy(F.desc("changed_ms"), F.desc("seen_ms"), "id").offset(page * size).limit(size)


def newest(df: DataFrame, at: str, key: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(at), key).limit(limit)


def change_feed(versions: DataFrame, resource: DataFrame, kinds: tuple[str, ...] = ("new", "changed", "gone"), limit: int = 25) -> DataFrame:
    """The newest changes with their resources: the top rows are taken before they meet the resources' columns."""
    seen = versions.where(F.col("change_kind").isin(*kinds)).dropDuplicates(["id"]).join(resource.select(F.col("id").alias("resource_id")), "resource_id", "left_semi")
    top = newest(seen.select("id", "resource_id", "change_kind", F.unix_millis("observed_at").alias("at_ms")), "at_ms", "id", limit)
    return top.join(resource.select(F.col("id").alias("resource_id"), "url", F.col("title")), "resource_id").select("id", "resource_id", "change_kind", "at_ms", "url", "title")


def last_two_versions(resource: DataFrame, versions: DataFrame) -> DataFrame:
    """Each resource with sha and size of its newest and previous version; null where there is none."""
    order = Window.partitionBy("resource_id").orderBy(F.desc("observed_at"), F.desc("id"))
    ranked = versions.dropDuplicates(["id"]).select("resource_id", "id", "observed_at", "sha256", "size_bytes").withColumn("k", F.row_number().over(order)).where("k <= 2")
    wide = ranked.groupBy("resource_id").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{name}_{c}") for k, name in ((1, "newest"), (2, "previous")) for c in ("sha256", "size_bytes")])
    return resource.select(F.col("id").alias("resource_id"), "url").join(wide, "resource_id", "left").withColumn("size_delta", F.col("newest_size_bytes") - F.col("previous_size_bytes"))


def more_after(df: DataFrame, at: str, key: str, limit: int) -> DataFrame:
    """One row: how many of the ``limit`` newest there are, and whether there are more."""
    return newest(df, at, key, limit + 1).agg(F.least(F.count("*"), F.lit(limit)).cast("bigint").alias("shown"), (F.count("*") > limit).alias("has_more"))


def run_list(runs: DataFrame, limit: int = 10) -> DataFrame:
    shown = runs.select("id", "mode", "status", F.unix_millis("requested_at").alias("requested_ms"), (F.unix_millis("finished_at") - F.unix_millis("started_at")).alias("took_ms"), "fetched", "error_count")
    return newest(shown, "requested_ms", "id", limit)


def last_of(runs: DataFrame, status: str) -> DataFrame:
    return runs.where(F.col("status") == status).agg(F.max_by("id", F.struct("finished_at", "id")).alias("id"), F.unix_millis(F.max("finished_at")).alias("finished_ms"))


def worker_health(runs: DataFrame, as_of: datetime, stale_minutes: int = DEFAULT.stale_minutes, stall_minutes: int = DEFAULT.stall_minutes) -> DataFrame:
    """Per worker: its newest sign of life, its runs, and whether a running run of it is stale or stalled."""
    now = F.lit(as_of)
    stale = (F.col("status") == "running") & (F.col("heartbeat_at") < now - F.expr(f"interval {stale_minutes} minutes"))
    stalled = (F.col("status") == "running") & (F.col("progress_at") < now - F.expr(f"interval {stall_minutes} minutes"))
    return runs.where(F.col("worker_id").isNotNull()).groupBy("worker_id").agg(F.unix_millis(F.max("heartbeat_at")).alias("seen_ms"), F.count("*").alias("runs"), n_if(stale).alias("stale"), n_if(stalled).alias("stalled"))


def dedup_savings(versions: DataFrame, blob: DataFrame) -> DataFrame:
    """One row: bytes of all versions with a body, bytes of the blobs, and what storing each body once saves."""
    logical = versions.where(F.col("blob_sha256").isNotNull()).dropDuplicates(["id"]).agg(total("size_bytes").alias("logical_bytes"))
    stored = blob.agg(total("size_bytes").alias("stored_bytes"))
    return logical.crossJoin(stored).withColumn("saved_bytes", F.greatest(F.lit(0), F.col("logical_bytes") - F.col("stored_bytes")))  # one row each


def run_rollup(versions: DataFrame) -> DataFrame:
    """Per run the counts of its observations by outcome, recomputed from the log; partial sums make a large run cheap."""
    kinds = ["new", "changed", "probed", "gone", "error"]
    return versions.dropDuplicates(["id"]).groupBy("run_id").agg(F.count("*").alias("n"), *[n_if(F.col("change_kind") == k).alias(f"{k}_count") for k in kinds], total("size_bytes").alias("bytes"), F.unix_millis(F.min("observed_at")).alias("first_ms"), F.unix_millis(F.max("observed_at")).alias("last_ms"))


def progress_marks(runs: DataFrame) -> DataFrame:
    """Each run with the running maximum of pages fetched per worker and whether it advanced."""
    before = Window.partitionBy("worker_id").orderBy("requested_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    out = runs.where(F.col("worker_id").isNotNull()).withColumn("high", F.coalesce(F.max("fetched").over(before), F.lit(0)))
    return out.select("id", "worker_id", F.greatest("high", F.coalesce("fetched", F.lit(0))).cast("bigint").alias("mark"), (F.coalesce("fetched", F.lit(0)) > F.col("high")).alias("advanced"))


def estimate(resource: DataFrame) -> DataFrame:
    """Per file extension: how many, known bytes, and bytes with unknown sizes taken as the mean of the known."""
    extension = F.lower(F.nullif(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1), F.lit("")))
    out = resource.groupBy(F.coalesce(extension, F.lit("none")).alias("extension")).agg(F.count("*").alias("n"), total("size_bytes").alias("known_bytes"), F.avg("size_bytes").alias("mean"), n_if(F.col("size_bytes").isNull()).alias("unknown"))
    return out.select("extension", "n", "known_bytes", F.round(F.col("known_bytes") + F.coalesce("mean", F.lit(0.0)) * F.col("unknown")).cast("bigint").alias("estimated_bytes"))


def run_counters(versions: DataFrame, resource: DataFrame) -> DataFrame:
    """Per run the counters that the log gives: observations, pages, documents and outcomes, bytes stored once and in all.

    A blob counts for the first run that stored it. Aggregates only: a run that holds most rows is combined early.
    """
    one = versions.dropDuplicates(["id"]).join(resource.select(F.col("id").alias("resource_id"), F.col("kind").alias("of")).dropDuplicates(["resource_id"]), "resource_id", "left")
    kinds = ["new", "changed", "probed", "gone", "error"]
    main = one.groupBy("run_id").agg(
        F.count("*").alias("observations"), n_if(F.col("of") == "page").alias("pages"), n_if(F.col("of") == "document").alias("documents"), *[n_if(F.col("change_kind") == k).alias(f"{k}_count") for k in kinds],
        F.coalesce(F.sum(F.when(F.col("sha256").isNotNull(), F.col("size_bytes"))), F.lit(0)).cast("bigint").alias("bytes_downloaded"), F.coalesce(F.sum(F.when(F.col("sha256").isNull(), F.col("size_bytes"))), F.lit(0)).cast("bigint").alias("bytes_estimated"),
    )
    first = one.where(F.col("blob_sha256").isNotNull()).groupBy(F.lower("blob_sha256").alias("sha")).agg(F.min_by(F.struct("run_id", "size_bytes"), F.struct("observed_at", "id")).alias("f"))
    stored = first.groupBy(F.col("f.run_id").alias("run_id")).agg(F.coalesce(F.sum("f.size_bytes"), F.lit(0)).cast("bigint").alias("bytes_stored"))
    return main.join(stored, "run_id", "left").withColumn("bytes_stored", F.coalesce("bytes_stored", F.lit(0)))


#: The SQL of :func:`run_counters` over the test tables.
RUN_COUNTERS_SQL = """with v as (select v.*, r.kind as "of" from (select distinct * from resource_version) v left join resource r on r.id = v.resource_id),
f as (select lower(blob_sha256) as sha, min_by(struct_pack(r := run_id, s := size_bytes), struct_pack(a := observed_at, b := id)) as x from v where blob_sha256 is not null group by 1),
s as (select x.r as run_id, cast(coalesce(sum(x.s), 0) as bigint) as bytes_stored from f group by 1)
select v.run_id, count(*) as observations, count(*) filter (where "of" = 'page') as pages, count(*) filter (where "of" = 'document') as documents,
count(*) filter (where change_kind = 'new') as new_count, count(*) filter (where change_kind = 'changed') as changed_count, count(*) filter (where change_kind = 'probed') as probed_count, count(*) filter (where change_kind = 'gone') as gone_count, count(*) filter (where change_kind = 'error') as error_count,
cast(coalesce(sum(size_bytes) filter (where sha256 is not null), 0) as bigint) as bytes_downloaded, cast(coalesce(sum(size_bytes) filter (where sha256 is null), 0) as bigint) as bytes_estimated, coalesce(any_value(bytes_stored), 0) as bytes_stored
from v left join s using (run_id) group by 1"""
