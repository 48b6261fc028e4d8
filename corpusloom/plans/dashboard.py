"""Read models over the crawler's tables, as queries with SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from corpusloom.operators import readmodels as R
from corpusloom.session import table
from corpusloom.streaming import changes

AS_OF = datetime(2025, 12, 28, 6, tzinfo=timezone.utc)
_NOW = "timestamptz '2025-12-28 06:00:00+00'"
_BLOB = "b as (select lower(blob_sha256) as sha256, max(size_bytes) as size_bytes, min(content_type) as content_type, count(*) as ref_count, min(observed_at) as created_at from (select distinct * from resource_version) where blob_sha256 is not null group by 1)"
_RV = "(select distinct * from resource_version)"


def _events(spark, folder):
    """The events, their times without zone read as UTC."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def queries():
    def t(name):
        return lambda spark, folder: table(spark, folder, name)

    resource, version, run, event = t("resource"), t("resource_version"), t("sync_run"), _events

    def blob(s, d):
        return R.blobs(version(s, d))

    return {
        "overview": lambda s, d: R.overview(resource(s, d), version(s, d), blob(s, d), run(s, d)),
        "storage_health": lambda s, d: R.storage_health(blob(s, d), resource(s, d), AS_OF),
        "sync_progress": lambda s, d: R.sync_progress(resource(s, d), AS_OF),
        "coverage_by_kind": lambda s, d: R.coverage_by_kind(resource(s, d)),
        "event_counts": lambda s, d: R.counts_by(event(s, d), "event_type"),
        "change_counts": lambda s, d: R.counts_by(version(s, d).dropDuplicates(["id"]), "change_kind"),
        "storage_by_type": lambda s, d: R.storage_by_type(blob(s, d)),
        "content_list": lambda s, d: R.content_page(resource(s, d), 0, text="permit", kind="page"),
        "content_total": lambda s, d: R.matching(resource(s, d), text="permit", kind="page").groupBy().count().withColumnRenamed("count", "n"),
        "events_recent": lambda s, d: R.newest(event(s, d).selectExpr("event_id", "unix_millis(ts) as at_ms", "event_type", "get_json_object(props, '$.k') as k"), "at_ms", "event_id", 50),
        "change_feed": lambda s, d: R.change_feed(version(s, d), resource(s, d)),
        "last_two_versions": lambda s, d: R.last_two_versions(resource(s, d), version(s, d)),
        "recent_has_more": lambda s, d: R.more_after(resource(s, d).where("last_fetched_at is not null"), "last_fetched_at", "id", 100),
        "recent_runs": lambda s, d: R.run_list(run(s, d)),
        "last_completed_run": lambda s, d: R.last_of(run(s, d), "completed"),
        "worker_health": lambda s, d: R.worker_health(run(s, d), AS_OF),
        "dedup_savings": lambda s, d: R.dedup_savings(version(s, d), blob(s, d)),
        "run_rollup": lambda s, d: R.run_rollup(version(s, d)),
        "progress_marks": lambda s, d: R.progress_marks(run(s, d)),
        "size_estimate": lambda s, d: R.estimate(resource(s, d)),
        "stale_runs": lambda s, d: changes.stale_runs(run(s, d), AS_OF, 5),
        "windowed_events": lambda s, d: changes.windowed_counts(event(s, d)),
        "event_sessions": lambda s, d: changes.sessions(event(s, d)),
    }


def oracle_sql():
    match = "kind = 'page' and (url ilike '%permit%' or title ilike '%permit%')"
    return {
        "overview": f"""with {_BLOB} select (select count(*) from resource) as resources, (select count(*) from resource where kind = 'document') as documents,
            (select count(*) from resource where kind = 'page') as pages, (select count(*) from resource where state = 'gone') as gone, (select count(distinct id) from resource_version) as versions,
            (select count(*) from b) as blobs, (select cast(coalesce(sum(size_bytes), 0) as bigint) from b) as stored_bytes, (select count(*) from sync_run) as runs,
            (select cast(coalesce(sum(bytes_downloaded), 0) as bigint) from sync_run) as downloaded_bytes""",
        "storage_health": f"""with {_BLOB}, a as (select count(*) as objects, cast(coalesce(sum(size_bytes), 0) as bigint) as stored_bytes, min(epoch_ms(created_at)) as oldest_ms, max(epoch_ms(created_at)) as newest_ms,
            count(*) filter (where created_at >= {_NOW} - interval 1 day) as under_1d, count(*) filter (where created_at < {_NOW} - interval 1 day and created_at >= {_NOW} - interval 7 day) as d1_to_7,
            count(*) filter (where created_at < {_NOW} - interval 7 day and created_at >= {_NOW} - interval 30 day) as d7_to_30, count(*) filter (where created_at < {_NOW} - interval 30 day) as over_30d from b),
            h as (select count(*) filter (where state = 'active' and next_fetch_at <= {_NOW}) as stale_past_due, count(*) filter (where state = 'error') as errors, count(*) filter (where state = 'gone') as gone from resource)
            select * from a, h""",
        "sync_progress": f"""select count(*) as total, count(last_fetched_at) as fetched, count(*) filter (where (next_fetch_at is null or next_fetch_at <= {_NOW}) and state <> 'gone') as due,
            count(*) filter (where priority = 0) as core, count(*) filter (where priority >= 2) as docs, round(100 * count(last_fetched_at) / count(*), 1) as percent from resource""",
        "coverage_by_kind": "select kind, count(*) as total, count(last_fetched_at) as fetched, case kind when 'page' then 1 when 'document' then 2 when 'sitemap' then 3 when 'other' then 4 else 5 end as rank from resource group by kind",
        "event_counts": "select event_type, count(*) as n from events group by 1",
        "change_counts": f"select change_kind, count(*) as n from {_RV} group by 1",
        "storage_by_type": f"with {_BLOB} select coalesce(content_type, 'unknown') as content_type, count(*) as objects, cast(coalesce(sum(size_bytes), 0) as bigint) as bytes from b group by 1 order by bytes desc, 1 limit 8",
        "content_list": f"select id, url, title, kind, state, epoch_ms(last_changed_at) as changed_ms, epoch_ms(last_seen_at) as seen_ms from resource where {match} order by changed_ms desc nulls last, seen_ms desc nulls last, id limit 50 offset 0",
        "content_total": f"select count(*) as n from resource where {match}",
        "events_recent": "select event_id, epoch_ms(ts) as at_ms, event_type, props ->> '$.k' as k from events order by at_ms desc, event_id limit 50",
        "change_feed": f"select v.id, v.resource_id, v.change_kind, epoch_ms(v.observed_at) as at_ms, r.url, r.title from {_RV} v join resource r on r.id = v.resource_id where v.change_kind in ('new', 'changed', 'gone') order by at_ms desc, v.id limit 25",
        "last_two_versions": f"""with k as (select *, row_number() over (partition by resource_id order by observed_at desc, id desc) as k from {_RV})
            select r.id as resource_id, r.url, a.sha256 as newest_sha256, a.size_bytes as newest_size_bytes, b.sha256 as previous_sha256, b.size_bytes as previous_size_bytes, a.size_bytes - b.size_bytes as size_delta
            from resource r left join k a on a.resource_id = r.id and a.k = 1 left join k b on b.resource_id = r.id and b.k = 2""",
        "recent_has_more": "select least(count(last_fetched_at), 100) as shown, count(last_fetched_at) > 100 as has_more from resource",
        "recent_runs": "select id, mode, status, epoch_ms(requested_at) as requested_ms, epoch_ms(finished_at) - epoch_ms(started_at) as took_ms, fetched, error_count from sync_run order by requested_ms desc, id limit 10",
        "last_completed_run": "select id, epoch_ms(finished_at) as finished_ms from sync_run where status = 'completed' order by finished_at desc nulls last, id desc limit 1",
        "worker_health": f"""select worker_id, epoch_ms(max(heartbeat_at)) as seen_ms, count(*) as runs, count(*) filter (where status = 'running' and heartbeat_at < {_NOW} - interval 5 minute) as stale,
            count(*) filter (where status = 'running' and progress_at < {_NOW} - interval 3 minute) as stalled from sync_run where worker_id is not null group by 1""",
        "dedup_savings": f"""with {_BLOB}, l as (select cast(coalesce(sum(size_bytes), 0) as bigint) as logical_bytes from {_RV} where blob_sha256 is not null), s as (select cast(coalesce(sum(size_bytes), 0) as bigint) as stored_bytes from b)
            select *, greatest(0, logical_bytes - stored_bytes) as saved_bytes from l, s""",
        "run_rollup": f"""select run_id, count(*) as n, {", ".join(f"count(*) filter (where change_kind = '{k}') as {k}_count" for k in ("new", "changed", "probed", "gone", "error"))},
            cast(coalesce(sum(size_bytes), 0) as bigint) as bytes, epoch_ms(min(observed_at)) as first_ms, epoch_ms(max(observed_at)) as last_ms from {_RV} group by 1""",
        "progress_marks": """with h as (select *, coalesce(max(fetched) over (partition by worker_id order by requested_at, id rows between unbounded preceding and 1 preceding), 0) as high from sync_run where worker_id is not null)
            select id, worker_id, greatest(high, coalesce(fetched, 0)) as mark, coalesce(fetched, 0) > high as advanced from h""",
        "size_estimate": r"""select coalesce(lower(nullif(regexp_extract(path, '\.([A-Za-z0-9]{1,5})$', 1), '')), 'none') as extension, count(*) as n, cast(coalesce(sum(size_bytes), 0) as bigint) as known_bytes,
            cast(round(coalesce(sum(size_bytes), 0) + coalesce(avg(size_bytes), 0) * count(*) filter (where size_bytes is null)) as bigint) as estimated_bytes from resource group by 1""",
        "stale_runs": f"select id, epoch_ms({_NOW}) - epoch_ms(heartbeat_at) as silent_ms from sync_run where status = 'running' and epoch_ms({_NOW}) - epoch_ms(heartbeat_at) > 300000",
        "windowed_events": "select epoch_ms(date_trunc('day', ts)) as start_ms, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
        "event_sessions": """with g as (select *, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
            s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
            select user_id, epoch_ms(min(ts)) as start_ms, epoch_ms(max(ts)) + 1800000 as end_ms, count(*) as n from s group by user_id, k""",
    }
