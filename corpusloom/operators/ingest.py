"""From a batch of observations to the next snapshots: resources, version log, blobs, links, events and counters.

Every output is computed from one classified batch, a table in the shared folder, so the bodies are read once.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions import html, urls
from corpusloom.operators import links as link_ops
from corpusloom.operators import manifest
from corpusloom.session import materialize, maybe_broadcast
from corpusloom.sources.blobs import blob_key

ESTIMATE = "estimate"


def header(name: str) -> Column:
    """A header of an observation by its name in lower case, null without it."""
    found = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name)
    return F.when(F.size(found) > 0, found[0]["value"])


def skipped_body(size: Column, mode: str, limit: int | None) -> Column:
    """Whether a document's body is not taken: in an estimate, with a limit of 0 or less, or if it is known to be larger."""
    if mode == ESTIMATE or (limit is not None and limit <= 0):
        return F.lit(True)
    return F.lit(False) if limit is None else F.coalesce(size > limit, F.lit(False))


def not_fetched(requests: DataFrame, resource: DataFrame) -> DataFrame:
    """``requests`` (url) whose URL has never been fetched."""
    return requests.join(resource.where(F.col("last_fetched_at").isNotNull()).select("url"), "url", "left_anti")


def classify(observations: DataFrame, resource: DataFrame, mode: str = "crawl", limit: int | None = None) -> DataFrame:
    """Observations with their outcome beside what the manifest knew; written to the shared folder.

    ``observations`` has (url, status, content_type, headers, body), one row a URL; ``resource`` the manifest's columns.
    ``outcome``: touched (304), gone (404, 410), failed (any other status or none), document, page, sitemap, ignored
    (another content type). ``change`` is new, changed, unchanged or probed for documents and pages. Rows of a null URL
    are left out.
    """
    one = observations.where(F.col("url").isNotNull()).dropDuplicates(["url"])
    known = resource.select("url", F.col("id").alias("prev_id"), F.lower("sha256").alias("prev_sha"), F.col("size_bytes").alias("prev_size"), F.lit(True).alias("known")).dropDuplicates(["url"])
    rows = one.join(known, "url", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    kind = html.content_type(F.coalesce("content_type", F.lit("")))
    markup = kind.contains("html") | kind.contains("xml")
    sort = F.when(html.document_extension(kind).isNotNull(), "document").when(markup & html.is_sitemap(F.col("url"), F.coalesce("body", F.lit(""))), "sitemap").when(markup, "page").otherwise("ignored")
    outcome = F.when(F.col("status") == 304, "touched").when(F.col("status").isin(404, 410), "gone").when(F.col("status") == 200, sort).otherwise("failed")
    rows = rows.withColumns({"kind_": kind, "outcome": outcome})
    listed = F.expr("try_cast(declared as bigint)")
    rows = rows.withColumn("declared", header("content-length")).withColumn("declared", F.when(listed > 0, listed))
    page, document = F.col("outcome") == "page", F.col("outcome") == "document"
    taken = (page & F.lit(mode != ESTIMATE)) | (document & ~skipped_body(F.col("declared"), mode, limit))
    steady = F.when(page, html.normalize_html(F.coalesce("body", F.lit("")))).otherwise(F.coalesce("body", F.lit("")))
    rows = rows.withColumn("stored", F.when(taken, steady)).withColumn("sha", F.sha2("stored", 256))
    size = F.when(page | (document & taken), F.octet_length(F.coalesce("body", F.lit("")))).when(document, F.coalesce("declared", F.lit(0))).cast("bigint")
    rows = rows.withColumn("size", size)
    by_sha = F.when(F.col("prev_sha").isNull(), "new").when(F.col("prev_sha") == F.col("sha"), "unchanged").otherwise("changed")
    probed = ~F.col("known") | ~F.col("size").eqNullSafe(F.col("prev_size"))
    change = F.when(page | document, F.when(F.col("sha").isNotNull(), by_sha).when(probed, "probed").otherwise("unchanged"))
    title = F.when(page, html.page_title(F.coalesce("body", F.lit("")))).when(document, html.filename_hint(header("content-disposition")))
    return materialize(
        rows.withColumns({"change": change, "title": title, "etag": header("etag"), "last_modified": header("last-modified"), "id": F.coalesce("prev_id", F.substring(F.sha2("url", 256), 1, 32))})
        .select("url", "id", "known", "status", F.col("kind_").alias("content_type"), "outcome", "change", "sha", "size", "stored", "body", "title", "etag", "last_modified")
    )


def versions(found: DataFrame, run_id: str, as_of: datetime) -> DataFrame:
    """The rows to append to the version log: changed content, and every gone or failed fetch, of a known URL if it failed."""
    changed = F.col("change").isin("new", "changed", "probed")
    lost = (F.col("outcome") == "gone") | ((F.col("outcome") == "failed") & F.col("known"))
    kind = F.when(changed, F.col("change")).when(F.col("outcome") == "gone", "gone").otherwise("error")
    rows = found.where(F.coalesce(changed, F.lit(False)) | lost)
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(run_id), "url"), 256).alias("id"), F.col("id").alias("resource_id"), F.lit(run_id).alias("run_id"), F.lit(as_of).alias("observed_at"), kind.alias("change_kind"), F.coalesce("status", F.lit(0)).alias("http_status"),
        F.when(changed, F.col("content_type")).alias("content_type"), F.col("size").alias("size_bytes"), F.col("sha").alias("sha256"), F.when(changed, F.col("etag")).alias("etag"), F.when(changed, F.col("last_modified")).alias("last_modified"), F.col("sha").alias("blob_sha256"), F.when(changed, F.col("title")).alias("title"),
    )


def resources(found: DataFrame, old: DataFrame, run_id: str, as_of: datetime, error_hours: int = DEFAULT.error_hours, gone_days: int = DEFAULT.gone_days) -> DataFrame:
    """The next snapshot of the resources, in the columns of ``old``: first sights and ids stay, a null sha keeps the old one.

    What was touched is only seen and fetched; gone and failed resources change state and keep their content; a failure
    of an unknown URL, a sitemap and an ignored type write no row, but a known one is scheduled anew.
    """
    n = found.where(~F.col("outcome").isin("sitemap", "ignored", "failed", "touched") | F.col("known"))
    n = n.select(F.col("url"), *[F.col(c).alias(f"n_{c}") for c in ("id", "status", "content_type", "outcome", "change", "sha", "size", "title", "etag", "last_modified")])
    both = old.join(n, "url", "full_outer")
    now, outcome = F.lit(as_of), F.col("n_outcome")
    seen = outcome.isNotNull()
    content = outcome.isin("page", "document")
    priority = F.coalesce("priority", urls.priority(F.col("url")))
    after = F.when(outcome == "failed", now + F.expr(f"interval {error_hours} hours")).when(outcome == "gone", now + F.expr(f"interval {gone_days} days")).otherwise(now + F.make_dt_interval(urls.ttl_days(priority)))

    def fresh(name: str, value: Column) -> Column:
        return F.when(content, F.coalesce(value, F.col(name))).otherwise(F.col(name))

    changed = F.col("n_change").isin("new", "changed", "probed")
    new = {
        "id": F.coalesce("id", "n_id"), "url_hash": F.coalesce("url_hash", F.sha2("url", 256)), "host": F.coalesce("host", urls.host_of(F.col("url"))), "path": F.coalesce("path", urls.path_of(F.col("url"))),
        "kind": F.when(content, outcome).otherwise(F.coalesce("kind", F.lit("page"))), "content_type": fresh("content_type", F.col("n_content_type")), "title": fresh("title", F.col("n_title")),
        "http_status": F.when(content, 200).when(outcome.isin("gone", "failed"), F.coalesce("n_status", F.lit(0))).otherwise(F.col("http_status")),
        "state": F.when(content, "active").when(outcome == "gone", "gone").when(outcome == "failed", "error").otherwise(F.coalesce("state", F.lit("active"))),
        "priority": priority, "next_fetch_at": F.when(seen, after).otherwise(F.col("next_fetch_at")), "sha256": fresh("sha256", F.col("n_sha")), "etag": fresh("etag", F.col("n_etag")), "last_modified": fresh("last_modified", F.col("n_last_modified")),
        "size_bytes": fresh("size_bytes", F.col("n_size")), "latest_version_id": F.when(changed, F.sha2(F.concat_ws("|", F.lit(run_id), "url"), 256)).otherwise(F.col("latest_version_id")),
        "first_seen_at": F.coalesce("first_seen_at", now), "last_seen_at": F.when(content | (outcome == "touched"), now).otherwise(F.coalesce("last_seen_at", now)),
        "last_fetched_at": F.when(content | outcome.isin("touched", "gone", "failed"), now).otherwise(F.col("last_fetched_at")), "last_changed_at": F.when(changed, now).otherwise(F.col("last_changed_at")),
        "first_run_id": F.coalesce("first_run_id", F.lit(run_id)), "last_run_id": F.when(content | (outcome == "touched"), F.lit(run_id)).otherwise(F.coalesce("last_run_id", F.lit(run_id))),
    }
    return both.select("url", *[value.alias(name) for name, value in new.items()]).select(*old.columns)


def blobs(found: DataFrame, old: DataFrame, as_of: datetime) -> DataFrame:
    """The next snapshot of the blobs: one reference more for every version that stored a body, new ones held locally."""
    stored = found.where(F.col("change").isin("new", "changed") & F.col("sha").isNotNull())
    extension = F.when(F.col("outcome") == "page", ".html").otherwise(html.document_extension(F.col("content_type")))
    new = stored.groupBy(F.col("sha").alias("sha256")).agg(F.count("*").alias("more"), F.max(F.octet_length("stored")).cast("bigint").alias("n_size"), F.min("content_type").alias("n_type"), F.min(extension).alias("n_ext"))
    both = old.join(new, "sha256", "full_outer")
    return both.select(
        "sha256", F.coalesce("size_bytes", "n_size").alias("size_bytes"), F.coalesce("content_type", "n_type").alias("content_type"), F.coalesce("storage_key", blob_key(F.col("sha256"), F.col("n_ext"))).alias("storage_key"),
        (F.coalesce("ref_count", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("ref_count"), "synced_at", F.coalesce("created_at", F.lit(as_of)).alias("created_at"),
    )


def targets(found: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows (from_resource_id, to_url): the distinct targets in scope of each page; ``hosts`` (host) are those in scope.

    The locations of a sitemap have a null source: they are enqueued, but no links.
    """
    pages = link_ops.page_links(found.where("outcome = 'page'").select("id", "url", F.col("body").alias("html")))
    listed = found.where("outcome = 'sitemap'").select(F.lit(None).cast("string").alias("from_resource_id"), F.explode(html.sitemap_locations(F.col("body"))).alias("href"), "url").select("from_resource_id", urls.normalize_against(F.col("href"), F.col("url")).alias("to_url"))
    few = maybe_broadcast(materialize(hosts.select(F.col("host").alias("_host")).where("_host is not null").distinct()))
    rows = pages.unionByName(listed).join(few, urls.host_of(F.col("to_url")) == F.col("_host"), "left")
    return rows.where(urls.in_scope(F.col("to_url"), F.col("_host").isNotNull())).select("from_resource_id", "to_url").distinct()


def enqueued(found: DataFrame, resource: DataFrame, run_id: str, as_of: datetime, discovery: bool = True) -> DataFrame:
    """``resource`` with a row, due now, for each target (to_url) that it lacks; nothing but ``resource`` without discovery.

    Targets that are sitemaps themselves are not enqueued. Existing rows keep their schedule.
    """
    if not discovery:
        return resource
    url, now = F.col("to_url"), F.lit(as_of)
    fresh = found.select("to_url").distinct().where(~url.endswith("sitemap.xml"))
    rows = fresh.select(
        F.substring(F.sha2(url, 256), 1, 32).alias("id"), url.alias("url"), F.sha2(url, 256).alias("url_hash"), urls.host_of(url).alias("host"), urls.path_of(url).alias("path"), F.lit("page").alias("kind"), F.lit("active").alias("state"),
        urls.priority(url).alias("priority"), now.alias("next_fetch_at"), now.alias("first_seen_at"), now.alias("last_seen_at"), F.lit(run_id).alias("first_run_id"), F.lit(run_id).alias("last_run_id"),
    )
    return manifest.insert_absent(resource, rows, "url")


def seeded(resource: DataFrame, entries: DataFrame, run_id: str, as_of: datetime) -> DataFrame:
    """``resource`` after a sitemap (url, lastmod): its URLs are tier 0, new ones due now, and so those modified since their last change."""
    from corpusloom.operators.frontier import modified_since

    listed = entries.select("url").distinct()
    both = enqueued(listed.withColumnRenamed("url", "to_url"), resource, run_id, as_of)
    core = listed.withColumn("_core", F.lit(True))
    due = modified_since(entries, resource).withColumn("_due", F.lit(True))
    marked = both.join(core, "url", "left").join(due, "id", "left")
    changed = {"priority": F.when(F.col("_core"), 0).otherwise(F.col("priority")), "next_fetch_at": F.when(F.col("_due"), F.lit(as_of)).otherwise(F.col("next_fetch_at"))}
    return marked.withColumns(changed).select(*resource.columns)


def core_coverage(entries: DataFrame, resource: DataFrame) -> DataFrame:
    """Rows (url, known, fetched): each listed URL, whether a resource has it, whatever its case, and whether it was fetched."""
    have = resource.groupBy(F.lower("url").alias("_url")).agg(F.max(F.col("last_fetched_at").isNotNull()).alias("fetched"))
    rows = entries.select("url").distinct().join(have, F.lower("url") == F.col("_url"), "left")
    return rows.select("url", F.col("_url").isNotNull().alias("known"), F.coalesce("fetched", F.lit(False)).alias("fetched"))


def events(found: DataFrame, run_id: str, as_of: datetime) -> DataFrame:
    """Rows for the event log: one for every gone and failed fetch."""
    lost = found.where(F.col("outcome").isin("gone", "failed"))
    return lost.select(F.sha2(F.concat_ws("|", F.lit(run_id), "url", "outcome"), 256).alias("id"), F.lit(run_id).alias("run_id"), F.when(F.col("known"), F.col("id")).alias("resource_id"), "url", F.when(F.col("outcome") == "gone", "gone").otherwise("fetch_error").alias("kind"), F.col("status").alias("http_status"), F.lit(None).cast("string").alias("message"), F.lit(as_of).alias("at"))


def counters(found: DataFrame, links: DataFrame, held: DataFrame, mode: str = "crawl") -> DataFrame:
    """One row: the counters of a run over its classified batch, its targets (to_url) and the blobs there were before it."""
    content, estimate = F.col("outcome").isin("page", "document"), F.lit(mode == ESTIMATE)

    def n(condition: Column) -> Column:
        return F.count_if(condition)

    def bytes_of(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("size"))), F.lit(0)).cast("bigint")

    taken = F.col("stored").isNotNull()
    one = found.agg(
        F.count("*").alias("requests_made"), n(F.col("outcome") == "page").alias("pages"), n(F.col("outcome") == "document").alias("documents"), n(content).alias("fetched"), n(F.col("change") == "new").alias("new_count"), n(F.col("change") == "changed").alias("changed_count"),
        n((F.col("change") == "unchanged") | (F.col("outcome") == "touched")).alias("unchanged_count"), n(F.col("outcome") == "gone").alias("gone_count"), n(F.col("outcome").isin("gone", "failed")).alias("error_count"),
        bytes_of(content & taken).alias("bytes_downloaded"), bytes_of(content & ~taken & (estimate | (F.col("outcome") == "document"))).alias("bytes_estimated"),
    )
    new = found.where(F.col("change").isin("new", "changed") & taken).groupBy("sha").agg(F.max(F.octet_length("stored")).alias("n")).join(held.select(F.col("sha256").alias("sha")), "sha", "left_anti")
    stored = new.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("bytes_stored"))
    return one.crossJoin(stored).crossJoin(links.agg(F.count("*").alias("discovered")))  # one row each


@dataclass(frozen=True)
class Ingested:
    """What a batch makes of the manifest."""

    resource: DataFrame
    versions: DataFrame
    blob: DataFrame
    link: DataFrame
    events: DataFrame
    counters: DataFrame


def ingest(observations: DataFrame, resource: DataFrame, blob: DataFrame, link: DataFrame, run_id: str, as_of: datetime, mode: str = "crawl", limit: int | None = None, discovery: bool = True) -> Ingested:
    """All outputs of a batch. ``versions`` and ``events`` are to be appended, the others are the next snapshots.

    Running the same batch again writes no version: its content is that of the manifest by then.
    """
    found = classify(observations, resource, mode, limit)
    hosts = resource.select("host").unionByName(found.select(urls.host_of(F.col("url")).alias("host")))
    aimed = materialize(targets(found, hosts))
    after = enqueued(aimed, resources(found, resource, run_id, as_of), run_id, as_of, discovery)
    edges = link_ops.merge_links(link, aimed.where(F.col("from_resource_id").isNotNull()), run_id)
    return Ingested(after, versions(found, run_id, as_of), blobs(found, blob, as_of), link_ops.resolve(edges, after), events(found, run_id, as_of), counters(found, aimed, blob, mode))
