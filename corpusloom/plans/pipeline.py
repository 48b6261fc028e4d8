"""Change detection, snapshots, URLs, HTML, links, frontier, text and export, as queries with SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions import chunking, html, text, urls
from corpusloom.operators import export, frontier, links, manifest, readmodels
from corpusloom.plans.dashboard import _BLOB, _NOW, _RV, AS_OF
from corpusloom.session import materialize, maybe_broadcast, spread, table
from corpusloom.sources import blobs, robots

#: Of two snapshots of one log, the older one holds what was seen before this time.
CUT = datetime(2025, 6, 1, tzinfo=timezone.utc)
_CUT = "timestamptz '2025-06-01 00:00:00+00'"

# A rendering of each page resource, made alike here and in SQL: the tables hold no HTML.
_HTML = """concat('<html><head><title> ', coalesce(title, ''), '\n </title></head><body><a class="x" href="', url, case when url like '%?%' then '&' else '?' end, 'utm_source=feed&b=2&a=1#top">self</a>',
 '<a href="https://', host, '/index">home</a><A HREF=''https://', host, '/index''>again</A><a href="mailto:clerk@example.org">mail</a><a href="#top">top</a>',
 '<a href="https://', host, '/login">in</a><input name="__VIEWSTATE" value="', url_hash, '"><div id="row', substring(url_hash, 1, 8), '">', coalesce(title, ''), '</div></body></html>')"""

ROBOTS = """
User-agent: otherbot
Disallow: /
User-agent: *
Disallow: /files/
Allow: /files/2024/
Disallow: /*-1$
Disallow:
"""


def _with_scope(spark, folder, rows, url):
    """``rows`` with in_scope: whether ``url`` is in scope, with the hosts of the resources as those known."""
    known = table(spark, folder, "resource").select(F.col("host").alias("_host")).where("_host is not null").distinct()
    return rows.join(maybe_broadcast(materialize(known)), urls.host_of(url) == F.col("_host"), "left").withColumn("in_scope", urls.in_scope(url, F.col("_host").isNotNull())).drop("_host")


def _pages(spark, folder):
    return table(spark, folder, "resource").where("kind = 'page'").selectExpr("id", "url", "host", f"{_HTML} as html")


def _links(spark, folder):
    return links.page_links(_pages(spark, folder))


def _versions(spark, folder):
    return table(spark, folder, "resource_version").dropDuplicates(["id"])


def url_normalize(spark, folder):
    dirty = F.concat(F.regexp_replace("url", "^https://", "HTTPS://"), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=x&b=2&a=1&FBCLID=9#frag"))
    return table(spark, folder, "resource").select("id", urls.normalize(dirty).alias("url"))


def url_parts(spark, folder):
    c = F.col("url")
    return table(spark, folder, "resource").select("id", urls.host_of(c).alias("host"), urls.path_of(c).alias("path"), urls.priority(c).alias("tier"), urls.ttl_days(F.col("priority")).alias("ttl"), urls.source_label(c).alias("label"))


def url_in_scope(spark, folder):
    url = F.concat("url", F.when(F.col("kind") == "sitemap", "?month=3").otherwise(""))
    rows = table(spark, folder, "resource").select("id", url.alias("url"))
    return _with_scope(spark, folder, rows, F.col("url")).select("id", "in_scope")


def robots_decision(spark, folder):
    return table(spark, folder, "resource").select("id", robots.allowed(F.col("path"), robots.rules(ROBOTS, "corpusloom/0.1")).alias("allowed"))


def sitemap_entries(spark, folder):
    page = F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc><lastmod>"), F.coalesce("last_modified", F.lit(" ")), F.lit("</lastmod></url><url><changefreq>daily</changefreq></url></urlset>"))
    return table(spark, folder, "resource").select("id", F.explode(html.sitemap_entries(page)).alias("e")).select("id", "e.*")


def resource_upsert(spark, folder):
    def snapshot(v):
        v = v.select("resource_id", "id", "sha256", "size_bytes", "observed_at")
        last = manifest.latest(v)
        first = v.groupBy("resource_id").agg(F.min("observed_at").alias("first_seen_at"))
        return last.join(first, "resource_id").select(F.col("resource_id").alias("id"), F.col("resource_id").alias("url"), "sha256", "size_bytes", F.lit("active").alias("state"), "first_seen_at", F.col("observed_at").alias("last_seen_at"))

    v = _versions(spark, folder)
    out = manifest.upsert_resources(snapshot(v.where(F.col("observed_at") < F.lit(CUT))), snapshot(v.where(F.col("observed_at") >= F.lit(CUT))))
    return out.withColumn("first_seen_at", F.unix_millis("first_seen_at")).withColumn("last_seen_at", F.unix_millis("last_seen_at"))


def ref_counts(spark, folder):
    v = _versions(spark, folder).where("blob_sha256 is not null").withColumn("sha256", F.lower("blob_sha256"))
    old = readmodels.blobs(v.where(F.col("observed_at") < F.lit(CUT))).select("sha256", "ref_count")
    return manifest.add_references(old, v.where(F.col("observed_at") >= F.lit(CUT)).select("sha256"))


def frontier_insert(spark, folder):
    r = table(spark, folder, "resource")
    return manifest.insert_absent(r.where(F.col("first_seen_at") < F.lit(CUT)).select("url", F.lit("kept").alias("origin")), r.select("url", F.lit("new").alias("origin")), "url")


def chunk_replace(spark, folder):
    chunk = table(spark, folder, "chunk").select("id", "resource_id", "chunk_index").distinct()
    stale = frontier.needs_embed(table(spark, folder, "resource_text"), table(spark, folder, "chunk"))
    new = stale.select(F.concat("resource_id", F.lit("#0")).alias("id"), "resource_id", F.lit(0).alias("chunk_index"))
    return manifest.replace_groups(chunk, new, stale, "resource_id")


def sitemap_lastmod_due(spark, folder):
    r = table(spark, folder, "resource").where("kind = 'page'")
    return frontier.modified_since(r.select("url", F.col("last_modified").alias("lastmod")), r)


def blob_keys(spark, folder):
    b = readmodels.blobs(table(spark, folder, "resource_version"))
    kind = html.content_type(F.col("content_type"))
    return b.select("sha256", blobs.blob_key(F.col("sha256"), html.document_extension(kind)).alias("key"), html.text_route(kind).alias("route"))


def _held(spark, folder):
    b = readmodels.blobs(table(spark, folder, "resource_version"))
    return b, b.where(F.col("created_at") < F.lit(CUT))


def blob_copy_missing(spark, folder):
    source, target = _held(spark, folder)
    return manifest.missing_copies(source, target).select("sha256", "size_bytes")


def publish_backlog(spark, folder):
    source, target = _held(spark, folder)
    return manifest.push_outcomes(source.withColumn("synced_at", F.lit(None).cast("timestamp")), source.where("size_bytes > 20000"), target)


def page_title(spark, folder):
    return _pages(spark, folder).select("id", html.page_title(F.col("html")).alias("title"))


def html_normalize(spark, folder):
    return _pages(spark, folder).select("id", F.sha2(html.normalize_html(F.col("html")), 256).alias("sha256"))


def html_text(spark, folder):
    return _pages(spark, folder).select("id", html.extract_html(F.col("html")).alias("x")).select("id", "x.text", "x.extractor", "x.status")


def link_targets(spark, folder):
    return _links(spark, folder).groupBy("from_resource_id").agg(F.count("*").alias("n"), F.count_distinct("to_url").alias("targets"))


def link_backfill(spark, folder):
    return links.resolve(_links(spark, folder).distinct(), table(spark, folder, "resource"))


def frontier_undiscovered(spark, folder):
    found = _with_scope(spark, folder, _links(spark, folder), F.col("to_url"))
    return links.undiscovered(found, table(spark, folder, "resource"), F.col("in_scope"))


def orphan_pages(spark, folder):
    r = table(spark, folder, "resource")
    return links.orphans(links.resolve(_links(spark, folder), r), r)


def link_reach(spark, folder):
    """Breadth-first over a graph of the paths' parents: from each host's root down."""
    r = table(spark, folder, "resource").select("host", F.split("path", "/").alias("p"))
    steps = r.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.struct(F.array_join(F.slice("p", 1, k), "/").alias("a"), F.array_join(F.slice("p", 1, k + 1), "/").alias("b")))).alias("e"))
    edges = steps.select(F.concat("host", "e.a").alias("from_url"), F.concat("host", "e.b").alias("to_url")).distinct()
    return links.reachable(edges, r.select(F.col("host").alias("url")))


def clean_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2(text.clean_text(F.concat(F.lit("\r\n\t "), "text", F.lit("  \n\n\n\n z\r"))), 256).alias("sha256"), text.has_words(F.col("text")).alias("has_words"))


def content_density(spark, folder):
    """One ratio a document; whether it is boilerplate follows from it."""
    rated = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", text.stopword_ratio(F.col("text")).alias("ratio"))
    return rated.select("doc_id", F.round("ratio", 6).alias("ratio"), (F.col("ratio") < DEFAULT.boilerplate_floor).alias("boilerplate"))


def extraction_status(spark, folder):
    d = table(spark, folder, "documents")
    status = F.when(text.has_words(F.col("text")), "ok").when(F.col("text").isNull(), "unsupported").otherwise("empty")
    return d.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def chunk_text(spark, folder):
    return chunking.chunk_table(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text").select(F.col("key").alias("doc_id"), "piece_index", "char_start", "char_end")


def chunk_markdown(spark, folder):
    return text.markdown_chunk_table(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text").withColumnRenamed("key", "doc_id")


def chunk_checked(spark, folder):
    """Stored chunks against their text: is each the stretch from char_start to char_end?"""
    t = table(spark, folder, "resource_text").where("status = 'ok'").select("resource_id", F.lower("sha256").alias("sha"), F.col("text").alias("whole")).dropDuplicates(["resource_id"])
    c = table(spark, folder, "chunk").select("id", "resource_id", F.lower("source_sha").alias("sha"), "text", "char_start", "char_end").distinct()
    same = F.substring(F.col("whole"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")
    return c.join(t, ["resource_id", "sha"]).select("id", same.alias("same"))


def index_export(spark, folder):
    return export.index_objects(table(spark, folder, "resource_text"), table(spark, folder, "resource"))


def queries():
    def t(name):
        return lambda spark, folder: table(spark, folder, name)

    r, x, k = t("resource"), t("resource_text"), t("chunk")
    named = [
        url_normalize, url_parts, url_in_scope, robots_decision, sitemap_entries, resource_upsert, ref_counts, frontier_insert, chunk_replace, sitemap_lastmod_due, blob_keys, blob_copy_missing,
        publish_backlog, page_title, html_normalize, html_text, link_targets, link_backfill, frontier_undiscovered, orphan_pages, link_reach, clean_text, content_density, extraction_status,
        chunk_text, chunk_markdown, chunk_checked, index_export,
    ]
    return {f.__name__: f for f in named} | {
        "change_kind": lambda s, d: manifest.classify(t("resource_version")(s, d)),
        "latest_version": lambda s, d: manifest.latest(_versions(s, d).select("id", "resource_id", "observed_at", "change_kind", "sha256")).withColumn("observed_at", F.unix_millis("observed_at")),
        "blob_manifest": lambda s, d: readmodels.blobs(t("resource_version")(s, d)).withColumn("created_at", F.unix_millis("created_at")),
        "frontier_due": lambda s, d: frontier.due_batch(r(s, d), AS_OF),
        "frontier_reschedule": lambda s, d: frontier.reschedule(r(s, d), AS_OF),
        "request_headers": lambda s, d: frontier.request_headers(r(s, d)),
        "needs_extract": lambda s, d: frontier.needs_extract(r(s, d), x(s, d)),
        "needs_embed": lambda s, d: frontier.needs_embed(x(s, d), k(s, d)),
        "needs_clear": lambda s, d: frontier.needs_clear(x(s, d), k(s, d)),
        "content_hash": lambda s, d: t("documents")(s, d).select("doc_id", F.sha2("text", 256).alias("sha256")),
        "export_outcomes": lambda s, d: export.outcomes(index_export(s, d)),
        "worker_sweep": lambda s, d: manifest.sweep(t("sync_run")(s, d), AS_OF, 60 * 24 * 30).select("id", "worker_id"),
        "display_sizes": lambda s, d: r(s, d).select("id", text.human_bytes(F.col("size_bytes")).alias("size"), text.human_number(F.col("size_bytes")).alias("number"), text.kind_label(F.col("kind")).alias("label"), text.human_time(F.col("first_seen_at")).alias("seen")),
        "display_durations": lambda s, d: t("sync_run")(s, d).select("id", text.human_duration(F.unix_millis("finished_at") - F.unix_millis("started_at")).alias("took"), text.human_age(F.unix_millis("requested_at"), int(AS_OF.timestamp() * 1000)).alias("age")),
    }


def oracle_sql():
    sorted_url = "split_part(url, '?', 1) || '?a=1&b=2' || case when contains(url, '?') then '&' || split_part(url, '?', 2) else '' end"
    stop = ", ".join(f"'{w}'" for w in sorted(text.STOPWORDS))
    tokens = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+', 0)"
    html_page = f"h as (select id, url, host, {_HTML} as html from resource where kind = 'page')"
    raw = r"""(select id, url, host, unnest(list_filter(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']+)["'']', 1), lambda x: trim(x)), lambda x: not regexp_matches(x, '(?i)^(mailto:|tel:|javascript:|#)'))) as href from h)"""
    to_links = rf"""{html_page}, l as (select id as from_resource_id, host, case when contains(href, 'utm_source') then {sorted_url} else href end as to_url from {raw})"""
    types = "case split_part(content_type, ';', 1) when 'application/pdf' then '.pdf' when 'application/msword' then '.doc' else '' end"
    density = f"case when len({tokens}) > 0 then len(list_filter({tokens}, lambda x: x in ({stop}))) / len({tokens}) else 0 end"
    before = f"b as (select resource_id, max_by(struct_pack(a := sha256, b := size_bytes, c := observed_at), struct_pack(x := observed_at, y := id)) as r, min(observed_at) as first_at from {_RV} where observed_at < {_CUT} group by 1)"
    after = f"n as (select resource_id, max_by(struct_pack(a := sha256, b := size_bytes, c := observed_at), struct_pack(x := observed_at, y := id)) as r, min(observed_at) as first_at from {_RV} where observed_at >= {_CUT} group by 1)"
    meta = r"substring(trim(regexp_replace(regexp_replace({}, '[\r\n\t]+', ' ', 'g'), '[^\x20-\x7e]', '', 'g')), 1, 500)"
    reason = "case when status <> 'ok' then 'not_ok' when coalesce(trim(text), '') = '' then 'blank' when octet_length(encode(text)) > 4194304 then 'too_large' end"
    objects = f"o as (select distinct 'index/' || t.resource_id || '.md' as key, case when ({reason}) is null then t.text end as body, {meta.format('r.url')} as url, {meta.format('coalesce(r.title, r.url)')} as title, {meta.format('r.kind')} as kind, {reason} as skip_reason from resource_text t join resource r on r.id = t.resource_id)"
    return {
        "url_normalize": f"select id, {sorted_url} as url from resource",
        "url_parts": "select id, host, path, case when regexp_matches(url, '(?i)/DocumentCenter/View/') then 3 when regexp_matches(url, '(?i)/AgendaCenter/ViewFile/') then 2 else 1 end as tier, case priority when 2 then 30 when 3 then 180 else 7 end as ttl, regexp_replace(host || split_part(path, '?', 1), '/$', '') as label from resource",
        "url_in_scope": r"select id, kind <> 'sitemap' and not regexp_matches(url, '(?i)/Search|/rss\.aspx|/List\.aspx|/MyAccount|/Admin|login|logout|/Facilities|translate\.google|\.(css|js|ico|woff2?|ttf|eot|map)(\?|$)') as in_scope from resource",
        "robots_decision": "select id, case when path like '/files/2024/%' then true when path like '/files/%' then false when path like '%-1' then false else true end as allowed from resource",
        "sitemap_entries": r"select id, url as loc, nullif(regexp_extract('<lastmod>' || coalesce(last_modified, ' ') || '</lastmod>', '<lastmod>\s*([^<\s]+)\s*</lastmod>', 1), '') as lastmod, null::varchar as changefreq from resource",
        "resource_upsert": f"with {before}, {after} select coalesce(b.resource_id, n.resource_id) as id, coalesce(b.resource_id, n.resource_id) as url, coalesce(n.r.a, b.r.a) as sha256, coalesce(n.r.b, b.r.b) as size_bytes, 'active' as state, epoch_ms(coalesce(b.first_at, n.first_at)) as first_seen_at, epoch_ms(coalesce(n.r.c, b.r.c)) as last_seen_at from b full join n using (resource_id)",
        "ref_counts": f"with {_BLOB} select sha256, ref_count from b",
        "frontier_insert": f"select url, case when first_seen_at < {_CUT} then 'kept' else 'new' end as origin from resource",
        "chunk_replace": """with e as (select distinct resource_id from resource_text t where status = 'ok' and not exists (select 1 from chunk c where c.resource_id = t.resource_id and lower(c.source_sha) = lower(t.sha256)))
            select distinct id, resource_id, chunk_index from chunk where resource_id not in (select resource_id from e) union all select resource_id || '#0', resource_id, 0 from e""",
        "blob_keys": f"with {_BLOB} select sha256, 'blobs/' || substring(sha256, 1, 2) || '/' || substring(sha256, 3, 2) || '/' || sha256 || {types} as key, case when split_part(content_type, ';', 1) = 'application/pdf' then 'pdf' when split_part(content_type, ';', 1) in ('text/html', 'text/xml', 'application/xml') or split_part(content_type, ';', 1) like '%+xml' then 'html' else 'unsupported' end as route from b",
        "blob_copy_missing": f"with {_BLOB} select sha256, size_bytes from b where created_at >= {_CUT}",
        "publish_backlog": f"with {_BLOB} select case when created_at < {_CUT} then 'stamped' when size_bytes > 20000 then 'copied' else 'missing' end as outcome, count(*) as n from b group by 1",
        "page_title": r"select id, nullif(trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')), '') as title from resource where kind = 'page'",
        "html_normalize": f"with {html_page} select id, sha256(regexp_replace(regexp_replace(html, 'value=\"[^\"]*\"', 'value=\"\"'), '\\brow[0-9a-f]{{6,}}', 'row_')) as sha256 from h",
        "link_targets": f"with {to_links} select from_resource_id, count(*) as n, count(distinct to_url) as targets from l group by 1",
        "link_backfill": f"with {to_links} select distinct from_resource_id, to_url, r.id as to_resource_id from l left join resource r on r.url = l.to_url",
        "frontier_undiscovered": f"with {to_links} select to_url, count(distinct from_resource_id) as n from l where not regexp_matches(to_url, '(?i)login') and to_url not in (select url from resource) group by 1",
        "orphan_pages": f"with {to_links} select id from resource r where not exists (select 1 from l where l.to_url = r.url and l.from_resource_id <> r.id)",
        "link_reach": "with p as (select host, string_split(path, '/') as p from resource), n as (select host, p, unnest(range(1, len(p) + 1)) as k from p) select distinct host || array_to_string(p[1:k], '/') as url, k - 1 as level from n",
        "clean_text": r"select doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(chr(13) || chr(10) || chr(9) || ' ' || text || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || ' z' || chr(13), '\r\n?', chr(10), 'g'), '[\t\x0b\x0c \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ')) as sha256, coalesce(regexp_matches(text, '[\p{L}\p{N}]'), false) as has_words from documents",
        "content_density": f"select doc_id, round({density}, 6) as ratio, ({density}) < 0.2 as boilerplate from documents",
        "extraction_status": r"select case when regexp_matches(text, '[\p{L}\p{N}]') then 'ok' when text is null then 'unsupported' else 'empty' end as status, count(*) as n from documents group by 1",
        "chunk_checked": "select distinct c.id, substring(t.text, c.char_start + 1, c.char_end - c.char_start) = c.text as same from chunk c join resource_text t on t.resource_id = c.resource_id and lower(t.sha256) = lower(c.source_sha) where t.status = 'ok'",
        "index_export": f"with {objects} select * from o",
        "export_outcomes": f"with {objects} select coalesce(skip_reason, 'exported') as outcome, count(*) as n, cast(coalesce(sum(octet_length(encode(body))), 0) as bigint) as bytes from o group by 1",
        "change_kind": f"""with s as (select *, last_value(sha256 ignore nulls) over w as sha_before, last_value(size_bytes ignore nulls) over w as size_before, row_number() over (partition by resource_id order by observed_at, id) as k from {_RV}
            window w as (partition by resource_id order by observed_at, id rows between unbounded preceding and 1 preceding))
            select id, resource_id, case when change_kind in ('gone', 'error') then change_kind when sha256 is not null then case when sha_before is null then 'new' when sha_before = sha256 then 'unchanged' else 'changed' end
            when k = 1 or size_bytes is distinct from size_before then 'probed' else 'unchanged' end as kind from s""",
        "latest_version": f"select resource_id, id, epoch_ms(observed_at) as observed_at, change_kind, sha256 from (select *, row_number() over (partition by resource_id order by observed_at desc, id desc) as k from {_RV}) where k = 1",
        "blob_manifest": f"with {_BLOB} select * replace (epoch_ms(created_at) as created_at) from b",
        "frontier_due": f"select id, url, priority, epoch_ms(next_fetch_at) as due_ms from resource where (next_fetch_at is null or next_fetch_at <= {_NOW}) and state <> 'gone' order by last_fetched_at is null desc, priority nulls first, next_fetch_at nulls first, url limit 200",
        "frontier_reschedule": f"select id, epoch_ms({_NOW} + case state when 'error' then interval 6 hour when 'gone' then interval 365 day else case priority when 2 then interval 30 day when 3 then interval 180 day else interval 7 day end end) as next_ms from resource",
        "request_headers": "select id, url, etag as if_none_match, last_modified as if_modified_since from resource",
        "needs_extract": "select distinct id, lower(sha256) as sha from resource r where sha256 is not null and not exists (select 1 from resource_text t where t.resource_id = r.id and lower(t.sha256) = lower(r.sha256))",
        "needs_embed": "select distinct resource_id, lower(sha256) as sha from resource_text t where status = 'ok' and not exists (select 1 from chunk c where c.resource_id = t.resource_id and lower(c.source_sha) = lower(t.sha256))",
        "needs_clear": "select distinct resource_id from resource_text t where status <> 'ok' and exists (select 1 from chunk c where c.resource_id = t.resource_id)",
        "content_hash": "select doc_id, sha256(text) as sha256 from documents",
        "worker_sweep": f"select id, worker_id from sync_run where heartbeat_at >= {_NOW} - interval 30 day",
        "sitemap_lastmod_due": r"""with d as (select id, last_changed_at, coalesce(try_strptime(last_modified, '%a, %d %b %Y %H:%M:%S GMT'), case when regexp_matches(last_modified, '^\d{4}-\d{2}-\d{2}') then try_cast(replace(last_modified, 'Z', '') as timestamp) end) as m from resource where kind = 'page')
            select id from d where m is not null and m > coalesce(last_changed_at at time zone 'UTC', timestamp '1970-01-01')""",
        "display_sizes": """with s as (select *, case when size_bytes >= 1073741824 then struct_pack(v := size_bytes / 1073741824, u := 'GB') when size_bytes >= 1048576 then struct_pack(v := size_bytes / 1048576, u := 'MB') when size_bytes >= 1024 then struct_pack(v := size_bytes / 1024, u := 'KB') end as x from resource)
            select id, case when coalesce(size_bytes, 0) <= 0 then '0 B' when x is null then size_bytes || ' B' when x.v >= 100 then printf('%.0f ', x.v) || x.u else printf('%.1f ', x.v) || x.u end as size, format('{:,}', coalesce(size_bytes, 0)) as number,
            case kind when 'page' then 'Pages' when 'document' then 'Documents' when 'sitemap' then 'Sitemaps' else 'Other' end as label, coalesce(strftime(first_seen_at at time zone 'UTC', '%b %-d, %Y, %-I:%M %p'), '–') as seen from s""",
        "display_durations": f"""with s as (select id, case when finished_at is not null and started_at is not null then cast(round(greatest(0, epoch_ms(finished_at) - epoch_ms(started_at)) / 1000) as bigint) end as s, (epoch_ms({_NOW}) - epoch_ms(requested_at)) / 1000 as a from sync_run),
            u as (select *, case when a < 60 then struct_pack(n := cast(round(a) as bigint), w := 'second') when a < 3600 then struct_pack(n := cast(round(a / 60) as bigint), w := 'minute') when a < 86400 then struct_pack(n := cast(round(a / 3600) as bigint), w := 'hour') when a < 604800 then struct_pack(n := cast(round(a / 86400) as bigint), w := 'day')
                  when a < 2628000 then struct_pack(n := cast(round(a / 604800) as bigint), w := 'week') when a < 31536000 then struct_pack(n := cast(round(a / 2628000) as bigint), w := 'month') else struct_pack(n := cast(round(a / 31536000) as bigint), w := 'year') end as x from s)
            select id, case when s is null then '–' when s >= 3600 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' when s >= 60 then (s // 60) || 'm ' || (s % 60) || 's' else s || 's' end as took, case when a is null then '–' when x.n = 0 then 'now' else x.n || ' ' || x.w || case when x.n = 1 then '' else 's' end || ' ago' end as age from u""",
    }
