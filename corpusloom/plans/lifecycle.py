"""The jobs from observations to texts and chunks, publishing, runs and search over chunks, as queries with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import html, urls
from corpusloom.operators import answer, derive, ingest, legacy, publish, readmodels, retrieve, runs
from corpusloom.operators import links as link_ops
from corpusloom.plans.dashboard import _BLOB, _NOW, AS_OF
from corpusloom.plans.pipeline import _CUT, _HTML, CUT
from corpusloom.plans.retrieval import _documents, _questions
from corpusloom.providers import search_items
from corpusloom.session import materialize, shared_dir, table

_EMPTY_BLOB = "sha256 string, size_bytes bigint, content_type string, storage_key string, ref_count bigint, synced_at timestamp, created_at timestamp"
_EMPTY_LINK = "from_resource_id string, to_url string, first_run_id string, last_run_id string"

# A batch of observations of all resources, made alike here and in SQL, and the manifest it meets: what was first seen
# before CUT; documents with a size divisible by 3 are there with the content they have in the batch.
_STATUS = "case when state = 'gone' then 404 when state = 'error' then 500 when etag is not null and size_bytes % 5 = 0 then 304 else 200 end"
_BODY = f"case when kind = 'page' then {_HTML} else concat('body of ', url) end"


def _batch(spark, folder):
    r = table(spark, folder, "resource")
    headers = F.map_from_arrays(F.array(F.lit("ETag"), F.lit("Content-Length")), F.array(F.coalesce("etag", F.lit("")), F.coalesce(F.col("size_bytes").cast("string"), F.lit("x"))))
    seen = r.select("url", F.expr(_STATUS).cast("int").alias("status"), "content_type", headers.alias("headers"), F.expr(_BODY).alias("body"))
    same = (F.col("kind") == "document") & (F.col("size_bytes") % 3 == 0)
    return seen, r.where(F.col("first_seen_at") < F.lit(CUT)).withColumn("sha256", F.when(same, F.sha2(F.concat(F.lit("body of "), "url"), 256)).otherwise(F.col("sha256")))


def _ingested(spark, folder, **more):
    seen, known = _batch(spark, folder)
    return ingest.ingest(seen, known, spark.createDataFrame([], _EMPTY_BLOB), spark.createDataFrame([], _EMPTY_LINK), "run-9", AS_OF, **more)


def ingest_outcomes(spark, folder):
    seen, known = _batch(spark, folder)
    return ingest.classify(seen, known).select("url", "outcome", "change", F.col("sha").alias("sha256"), F.col("size").alias("size_bytes"))


def ingest_estimate(spark, folder):
    """Nothing is downloaded: sizes are probed."""
    seen, known = _batch(spark, folder)
    return ingest.classify(seen, known, ingest.ESTIMATE).groupBy("outcome", "change").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def ingest_size_limit(spark, folder):
    seen, known = _batch(spark, folder)
    return ingest.classify(seen, known, limit=60_000).where("outcome = 'document'").select("url", F.col("stored").isNull().alias("skipped"), "change")


def ingest_versions(spark, folder):
    return _ingested(spark, folder).versions.select("resource_id", "change_kind", "http_status", "sha256", "title")


def ingest_resources(spark, folder):
    out = _ingested(spark, folder, discovery=False).resource
    return out.select("url", "kind", "state", "http_status", "sha256", F.unix_millis("next_fetch_at").alias("next_ms"), F.unix_millis("last_changed_at").alias("changed_ms"), "last_run_id")


def ingest_blobs(spark, folder):
    return _ingested(spark, folder).blob.select("sha256", "size_bytes", "storage_key", "ref_count")


def ingest_links(spark, folder):
    return _ingested(spark, folder).link.select("from_resource_id", "to_url", "to_resource_id", "first_run_id", "last_run_id")


def ingest_enqueued(spark, folder):
    """What discovery adds to the frontier beside the resources of the batch."""
    seen, known = _batch(spark, folder)
    return _ingested(spark, folder).resource.join(seen.select("url"), "url", "left_anti").join(known.select("url"), "url", "left_anti").select("url", "kind", "priority", F.unix_millis("next_fetch_at").alias("next_ms"))


def ingest_events(spark, folder):
    return _ingested(spark, folder).events.select("url", "kind", "http_status", F.col("resource_id").isNotNull().alias("known"))


def ingest_counters(spark, folder):
    return _ingested(spark, folder).counters.select("requests_made", "pages", "documents", "fetched", "new_count", "changed_count", "unchanged_count", "gone_count", "error_count")


def ingest_again(spark, folder):
    """The same batch on the manifest it made: no new version of any content."""
    seen, _ = _batch(spark, folder)
    first = _ingested(spark, folder)
    again = ingest.classify(seen, materialize(first.resource))
    return again.groupBy("outcome", "change").agg(F.count("*").alias("n")).where("change in ('new', 'changed', 'probed')")


def hub_pages(spark, folder):
    """Pages by the number of different URLs they link to."""
    return link_ops.out_degree(_ingested(spark, folder).link)


def not_fetched(spark, folder):
    r = table(spark, folder, "resource")
    return ingest.not_fetched(r.select("url"), r)


def _sitemap(spark, folder):
    return table(spark, folder, "resource").where("kind = 'page'").select(F.when(F.col("priority") == 1, F.upper("url")).otherwise(F.col("url")).alias("url"), F.col("last_modified").alias("lastmod"))


def sitemap_seeded(spark, folder):
    listed = table(spark, folder, "resource").where("kind = 'page'").select("url", F.col("last_modified").alias("lastmod"))
    known = table(spark, folder, "resource").where(F.col("first_seen_at") < F.lit(CUT))
    return ingest.seeded(known, listed, "run-9", AS_OF).select("url", "priority", F.unix_millis("next_fetch_at").alias("next_ms"))


def core_coverage(spark, folder):
    return ingest.core_coverage(_sitemap(spark, folder), table(spark, folder, "resource").where("kind = 'page' and priority < 2"))


def sitemap_detect(spark, folder):
    r = table(spark, folder, "resource")
    body = F.when(F.col("kind") == "sitemap", F.concat(F.lit("<urlset>"), "url")).otherwise(F.col("title"))
    return r.select("id", html.is_sitemap(F.col("url"), body).alias("is_sitemap"))


def priority_backfill(spark, folder):
    """Only rows of tier 1 get the tier of their URL."""
    return table(spark, folder, "resource").select("id", F.when(F.col("priority") == 1, urls.priority(F.col("url"))).otherwise(F.col("priority")).alias("priority"))


def resource_lookup(spark, folder):
    """Point lookups in bulk: every twentieth URL, and some that are not there."""
    r = table(spark, folder, "resource").select("url", "id", "state")
    asked = r.where(F.pmod(F.conv(F.substring(F.sha2("url", 256), 1, 6), 16, 10).cast("long"), F.lit(20)) == 0).select("url").unionByName(r.limit(1).select(F.lit("https://nowhere.example/").alias("url")))
    return asked.join(r, "url", "left")


def _stored(spark, folder):
    """Bodies of the resources with a sha256, made alike here and in SQL: HTML of pages, a line of text for documents."""
    r = table(spark, folder, "resource").where("sha256 is not null")
    return r.select(F.col("id").alias("resource_id"), F.lower("sha256").alias("sha256"), "content_type", F.encode(F.when(F.col("kind") == "page", F.concat(F.lit("<html><body><nav>Menu</nav><p>"), F.coalesce("title", F.lit("")), F.lit("</p></body></html>"))).when(F.col("size_bytes") % 2 == 0, F.concat(F.lit("text of "), "url")).otherwise(F.lit("--")), "utf-8").alias("body"))


def extract_bodies(spark, folder):
    """Extraction by content type; a PDF of this query is its own text."""
    return derive.extract(_stored(spark, folder), lambda b: b.decode()).select("resource_id", "status", "text")


def extract_due(spark, folder):
    r = table(spark, folder, "resource")
    held = readmodels.blobs(table(spark, folder, "resource_version")).select("sha256", "content_type", F.lit("k").alias("storage_key"))
    return derive.due_bodies(r, held, table(spark, folder, "resource_text")).select("resource_id", "sha256")


def text_upsert(spark, folder):
    old = table(spark, folder, "resource_text").where(F.col("created_at") < F.lit(CUT))
    new = derive.extract(_stored(spark, folder), lambda b: b.decode())
    return derive.upsert_texts(old, new, AS_OF).select("resource_id", F.lower("sha256").alias("sha256"), "status", "char_count", (F.col("created_at") < F.lit(CUT)).alias("kept"))


def embed_chunks(spark, folder):
    """The embedding job over every text without chunks of its content: how each resource's chunks come out."""
    chunk = table(spark, folder, "chunk")
    after = derive.embed_job(table(spark, folder, "resource_text"), table(spark, folder, "resource"), chunk, derive.HashEmbedder(64), AS_OF, 0)
    return after.groupBy("resource_id").agg(F.count_if(F.col("embedder") == "hash-64").alias("made"), F.count("*").alias("n"))


def blob_unpublished(spark, folder):
    return publish.unpublished(_marked(spark, folder))


def _marked(spark, folder):
    b = readmodels.blobs(table(spark, folder, "resource_version"))
    key = F.when(F.col("size_bytes") % 7 == 0, F.concat(F.lit("local/"), "sha256")).otherwise(F.concat(F.lit("blobs/"), "sha256"))
    return b.withColumns({"storage_key": key, "synced_at": F.when(F.col("size_bytes") % 5 == 0, F.col("created_at"))})


def blob_push(spark, folder):
    b = _marked(spark, folder)
    return publish.push_counts(publish.push_plan(b, b.where("size_bytes > 20000"), b.where(F.col("created_at") < F.lit(CUT))))


def blob_stamped(spark, folder):
    b = materialize(_marked(spark, folder))
    plan = publish.push_plan(b, b.where("size_bytes > 20000"), b.where(F.col("created_at") < F.lit(CUT)))
    return publish.stamped(b, plan, AS_OF).select("sha256", F.unix_millis("synced_at").alias("synced_ms"))


def blob_located(spark, folder):
    b = _marked(spark, folder)
    return publish.located(b, b.where("size_bytes > 20000"), b.where(F.col("created_at") < F.lit(CUT))).select("sha256", "in_local", "in_remote")


def blob_view(spark, folder):
    return publish.blob_view(table(spark, folder, "resource"), _marked(spark, folder))


def cascade_delete(spark, folder):
    r = table(spark, folder, "resource")
    link = r.select(F.col("id").alias("from_resource_id"), F.col("latest_version_id").alias("to_url"), F.col("id").alias("to_resource_id"))
    out = publish.cascade(r.where("state = 'gone'"), r, {"text": table(spark, folder, "resource_text"), "chunk": table(spark, folder, "chunk").select("id", "resource_id").distinct()}, link)
    return out["resource"].agg(F.count("*").alias("resources")).crossJoin(out["text"].agg(F.count("*").alias("texts"))).crossJoin(out["chunk"].agg(F.count("*").alias("chunks"))).crossJoin(out["link"].agg(F.count("*").alias("links")))  # one row each


def _queue(spark, folder):
    """The runs with every failed one queued again and the running one ended, so that the queue is not empty."""
    r = table(spark, folder, "sync_run")
    return r.withColumn("status", F.when(F.col("status") == "failed", "queued").when(F.col("status") == "running", "completed").otherwise(F.col("status")))


def run_next(spark, folder):
    return runs.next_queued(_queue(spark, folder)).select("id", "mode")


def run_claimed(spark, folder):
    q = _queue(spark, folder)
    first = q.where("status = 'queued'").agg(F.min("id")).first()[0]
    return runs.claim(q, first, "w-claim", AS_OF).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("worker_id") == "w-claim").alias("mine"))


def run_reaped(spark, folder):
    return runs.reap(table(spark, folder, "sync_run"), AS_OF).select("id", "status", F.unix_millis("finished_at").alias("finished_ms"))


def run_schedule(spark, folder):
    return runs.schedule_due(_queue(spark, folder).where("status <> 'queued'"), AS_OF, 24)


def run_chip(spark, folder):
    return runs.status_chip(table(spark, folder, "sync_run"), AS_OF)


def run_pace(spark, folder):
    return runs.pace(table(spark, folder, "sync_run"), 1000, AS_OF)


def run_ticks(spark, folder):
    r = table(spark, folder, "sync_run").where("requested_at is not null").select("id", "requested_at", F.coalesce("fetched", F.lit(0)).alias("total"))
    return runs.tick_delta(r, "requested_at", "total").select("id", "delta")


def worker_tallies(spark, folder):
    r = table(spark, folder, "sync_run").where("worker_id is not null")
    seen = r.select(F.col("worker_id").alias("id"), F.when(F.col("status") == "running", "active").otherwise("standby").alias("role"), F.col("heartbeat_at").alias("last_seen_at"))
    return runs.live_tallies(runs.upsert_worker(seen.limit(0), seen.where("last_seen_at is not null").dropDuplicates(["id", "last_seen_at"])), AS_OF, 60 * 24 * 30)


def run_counters(spark, folder):
    """Every counter that the log can give, recomputed for each run."""
    return readmodels.run_counters(table(spark, folder, "resource_version"), table(spark, folder, "resource"))


def chunk_search(spark, folder):
    """Every twentieth usable chunk, by its id as a number, against all chunks."""
    c = table(spark, folder, "chunk").select("id", "resource_id", "embedder", "embedding")
    asked = c.where(F.pmod(F.conv(F.substring("id", 1, 6), 16, 10).cast("long"), F.lit(20)) == 0).dropDuplicates(["id"])
    return retrieve.chunk_search(c, table(spark, folder, "resource"), asked.select(F.col("id").alias("query_id"), "embedder", "embedding")).select("query_id", "id", "resource_id", "score", "rank", "ordinal")


def bm25_from_index(spark, folder):
    path = f"{shared_dir(spark)}/corpusloom/{uuid.uuid4().hex}"
    retrieve.build_index(_documents(spark, folder), path)
    return retrieve.bm25_from(spark, path, _questions(spark), 50)


def search_reply(spark, folder):
    """Replies of a managed search in both shapes, made of the chunks of each resource."""
    c = table(spark, folder, "chunk").where("chunk_index < 5").select("resource_id", "chunk_index", "url", F.col("title").alias("t"), F.substring("text", 1, 40).alias("text")).distinct()
    none = F.lit(None)
    item = F.struct(F.col("chunk_index").alias("at"), F.to_json(F.struct(F.when(F.col("chunk_index") % 2 == 0, F.col("resource_id")).alias("file_id"), F.lit(0.5).alias("score"), F.when(F.col("chunk_index") % 2 == 1, F.col("text")).alias("text"), F.when(F.col("chunk_index") % 2 == 0, F.array(F.struct(F.col("text").alias("text")))).alias("content"), F.when(F.col("chunk_index") % 2 == 0, F.map_from_arrays(F.array(F.lit("x-amz-meta-source-url")), F.array("url"))).alias("attributes"), F.when(F.col("chunk_index") % 2 == 1, F.struct(F.col("resource_id").alias("key"), F.map_from_arrays(F.array(F.lit("source_url")), F.array("url")).alias("metadata"))).otherwise(none).alias("item"))).alias("x"))
    items = c.groupBy(F.col("resource_id").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(item.alias("i"))), lambda i: i["x"]).alias("chunks"))
    return search_items(items.select("query_id", F.concat(F.lit('{"chunks": ['), F.array_join("chunks", ", "), F.lit("]}")).alias("body")), 4, 3).select("query_id", "rank", "url", "ordinal", "text")


def cited_sources(spark, folder):
    """The numbers an answer cites, and the lines of their sources."""
    d = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("It is so [2], and so [1][2], not ["), F.pmod(F.col("doc_id"), F.lit(4)).cast("string"), F.lit("].")).alias("a"))
    return d.select("doc_id", F.array_join(F.transform(answer.cited_numbers(F.col("a")), lambda n: n.cast("string")), " ").alias("cited"), legacy.source_footer(F.col("a"), F.array(F.lit("u1"), F.lit("u2"))).alias("footer"))


def prompt_messages(spark, folder):
    return table(spark, folder, "resource").select("id", F.sha2(answer.user_message(F.coalesce("title", F.lit("")), F.col("path"), F.array("url", "host")), 256).alias("sha256"))


def legacy_files(spark, folder):
    r = table(spark, folder, "resource").select(F.col("id").alias("resource_id"), "url", "title")
    t = table(spark, folder, "resource_text").where("status = 'ok'").dropDuplicates(["resource_id"]).join(r, "resource_id")
    return t.select("resource_id", F.sha2(legacy.markdown_file({"url": F.col("url"), "title": F.col("title")}, F.col("text")), 256).alias("sha256"))


def legacy_due(spark, folder):
    r = table(spark, folder, "resource").where("sha256 is not null").select("url", "sha256", F.col("http_status").alias("status"), F.col("path").alias("local_path"), "size_bytes")
    return legacy.to_extract(legacy.fetched_pages(r), r.where("size_bytes % 2 = 0")).select("url", "sha256")


def legacy_needs_ocr(spark, folder):
    t = table(spark, folder, "resource_text").dropDuplicates(["resource_id"]).select(F.col("resource_id").alias("url"), F.coalesce("char_count", F.lit(0)).alias("chars"), (1 + F.coalesce("char_count", F.lit(0)) % 30).alias("pages"))
    return legacy.needs_ocr(t).select("url", F.round("chars_per_page", 4).alias("chars_per_page"))


def legacy_terms(spark, folder):
    return table(spark, folder, "resource").select("id", legacy.match_expression(F.coalesce("title", F.lit(""))).alias("terms"))


_NAMED = [
    ingest_outcomes, ingest_estimate, ingest_size_limit, ingest_versions, ingest_resources, ingest_blobs, ingest_links, ingest_enqueued, ingest_events, ingest_counters, ingest_again, hub_pages, not_fetched, sitemap_seeded, core_coverage, sitemap_detect,
    priority_backfill, resource_lookup, extract_bodies, extract_due, text_upsert, embed_chunks, blob_unpublished, blob_push, blob_stamped, blob_located, blob_view, cascade_delete, run_next, run_claimed, run_reaped, run_schedule, run_chip, run_pace,
    run_ticks, worker_tallies, run_counters, chunk_search, bm25_from_index, search_reply, cited_sources, prompt_messages, legacy_files, legacy_due, legacy_needs_ocr, legacy_terms,
]


def queries():
    return {f.__name__: f for f in _NAMED}


def oracle_sql():
    from corpusloom.plans import pipeline, retrieval

    steady = "sha256(regexp_replace(regexp_replace(body, 'value=\"[^\"]*\"', 'value=\"\"'), '\\brow[0-9a-f]{6,}', 'row_'))"
    document = "split_part(lower(content_type), ';', 1) in ('application/pdf', 'application/msword')"
    base = f"""s as (select *, {_STATUS} as status, {_BODY} as body, first_seen_at < {_CUT} as known from resource),
        o as (select *, case when status = 304 then 'touched' when status = 404 then 'gone' when status <> 200 then 'failed' when {document} then 'document' when kind = 'sitemap' then case when url like '%sitemap.xml' then 'sitemap' else 'page' end
              when contains(content_type, 'html') or contains(content_type, 'xml') then 'page' else 'ignored' end as outcome,
              case when not known then null when kind = 'document' and size_bytes % 3 = 0 then sha256('body of ' || url) else lower(sha256) end as prev_sha from s),
        h as (select *, case outcome when 'page' then {steady} when 'document' then sha256(body) end as sha, case when outcome in ('page', 'document') then octet_length(encode(body)) end as size from o),
        c as (select *, case when outcome in ('page', 'document') then case when prev_sha is null then 'new' when prev_sha = sha then 'unchanged' else 'changed' end end as change,
              case when known then id else substring(sha256(url), 1, 32) end as rid from h)"""
    probed = "case when outcome in ('page', 'document') then case when not known or (case outcome when 'page' then octet_length(encode(body)) else coalesce(size_bytes, 0) end) is distinct from size_bytes then 'probed' else 'unchanged' end end"
    title = r"case when outcome = 'page' and kind = 'page' then nullif(trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')), '') end"
    ext = "case when outcome = 'page' then '.html' when content_type like 'application/pdf%' then '.pdf' else '.doc' end"
    old_ttl = "case priority when 2 then 30 when 3 then 180 else 7 end"
    new_ttl = "case when regexp_matches(url, '(?i)/DocumentCenter/View/') then 180 when regexp_matches(url, '(?i)/AgendaCenter/ViewFile/') then 30 else 7 end"
    next_fetch = f"case when outcome = 'failed' then {_NOW} + interval 6 hour when outcome = 'gone' then {_NOW} + interval 365 day else {_NOW} + to_days(case when known then {old_ttl} else {new_ttl} end) end"
    links = pipeline.oracle_sql()["link_targets"].split("select from_resource_id, count(*)")[0]
    edges = f"""{base}, {links[len("with ") :].replace("h as (", "hh as (").replace("from h)", "from hh)")}, t as (select distinct c.rid as from_resource_id, l.to_url from l join c on c.id = l.from_resource_id where c.outcome = 'page' and not regexp_matches(to_url, '(?i)login'))"""
    marked = f"with {_BLOB}, m as (select *, case when size_bytes % 7 = 0 then 'local/' else 'blobs/' end || sha256 as storage_key, case when size_bytes % 5 = 0 then created_at end as synced_at, size_bytes > 20000 as in_local, created_at < {_CUT} as in_remote from b)"
    pushed = "p as (select *, case when in_remote then 'stamped' when coalesce(in_local, false) then 'copied' else 'missing' end as outcome from m where synced_at is null and storage_key not like 'local/%')"
    queue = "q as (select * replace (case status when 'failed' then 'queued' when 'running' then 'completed' else status end as status) from sync_run)"
    stored = """e as (select id as resource_id, lower(sha256) as sha256, case when kind = 'page' then title when content_type like 'application/pdf%' then case when size_bytes % 2 = 0 then 'text of ' || url else '--' end end as found,
        case when kind = 'page' then 'html' when content_type like 'application/pdf%' then 'pdf' else 'none' end as route from resource where sha256 is not null),
        x as (select *, case when route = 'none' then 'unsupported' when regexp_matches(coalesce(found, ''), '[\\p{L}\\p{N}]') then 'ok' when route = 'pdf' then 'scanned' else 'empty' end as status from e)"""
    good = "k as (select distinct on (id) id, resource_id, embedder, embedding::double[] as v from chunk where embedding is not null and list_inner_product(embedding::double[], embedding::double[]) > 0)"
    score = "round(list_cosine_similarity(a.v, b.v), 6)"
    modified = "coalesce(try_strptime(last_modified, '%a, %d %b %Y %H:%M:%S GMT'), case when regexp_matches(last_modified, '^\\d{4}-\\d{2}-\\d{2}') then try_cast(replace(last_modified, 'Z', '') as timestamp) end)"
    return {
        "ingest_outcomes": f"with {base} select url, outcome, change, sha as sha256, size as size_bytes from c",
        "ingest_estimate": f"with {base} select outcome, {probed} as change, count(*) as n, cast(coalesce(sum(case outcome when 'page' then octet_length(encode(body)) when 'document' then coalesce(size_bytes, 0) end), 0) as bigint) as bytes from h group by 1, 2",
        "ingest_size_limit": f"with {base} select url, coalesce(size_bytes > 60000, false) as skipped, case when coalesce(size_bytes > 60000, false) then {probed} else change end as change from c where outcome = 'document'",
        "ingest_versions": f"with {base} select rid as resource_id, case when change in ('new', 'changed') then change when outcome = 'gone' then 'gone' else 'error' end as change_kind, status as http_status, sha as sha256, case when change in ('new', 'changed') then {title} end as title from c where change in ('new', 'changed') or outcome = 'gone' or (outcome = 'failed' and known)",
        "ingest_resources": f"""with {base} select url, case when outcome in ('page', 'document') then outcome when known then kind else 'page' end as kind, case when outcome in ('page', 'document') then 'active' when outcome = 'gone' then 'gone' when outcome = 'failed' then 'error' else state end as state,
            case when outcome in ('page', 'document') then 200 when outcome in ('gone', 'failed') then status when known then http_status end as http_status, case when sha is not null then sha when known then case when kind = 'document' and size_bytes % 3 = 0 then prev_sha else sha256 end end as sha256, epoch_ms({next_fetch}) as next_ms,
            epoch_ms(case when change in ('new', 'changed') then {_NOW} when known then last_changed_at end) as changed_ms, case when outcome in ('page', 'document', 'touched') or not known then 'run-9' else coalesce(last_run_id, 'run-9') end as last_run_id
            from c where known or outcome not in ('sitemap', 'ignored', 'failed', 'touched')""",
        "ingest_blobs": f"with {base} select sha as sha256, max(case when outcome = 'page' then octet_length(encode(regexp_replace(regexp_replace(body, 'value=\"[^\"]*\"', 'value=\"\"'), '\\brow[0-9a-f]{{6,}}', 'row_'))) else size end) as size_bytes, 'blobs/' || substring(sha, 1, 2) || '/' || substring(sha, 3, 2) || '/' || sha || min({ext}) as storage_key, count(*) as ref_count from c where change in ('new', 'changed') group by sha",
        "ingest_links": f"with {edges} select from_resource_id, to_url, coalesce(k.rid, case when t.to_url is not null and k.url is null then substring(sha256(t.to_url), 1, 32) end) as to_resource_id, 'run-9' as first_run_id, 'run-9' as last_run_id from t left join (select url, rid from c where known or outcome not in ('sitemap', 'ignored', 'failed', 'touched')) k on k.url = t.to_url",
        "ingest_enqueued": f"with {edges} select distinct to_url as url, 'page' as kind, 1 as priority, epoch_ms({_NOW}) as next_ms from t where to_url not in (select url from resource)",
        "ingest_events": f"with {base} select url, case outcome when 'gone' then 'gone' else 'fetch_error' end as kind, status as http_status, known from c where outcome in ('gone', 'failed')",
        "ingest_counters": f"""with {base} select count(*) as requests_made, count(*) filter (where outcome = 'page') as pages, count(*) filter (where outcome = 'document') as documents, count(*) filter (where outcome in ('page', 'document')) as fetched, count(*) filter (where change = 'new') as new_count,
            count(*) filter (where change = 'changed') as changed_count, count(*) filter (where change = 'unchanged' or outcome = 'touched') as unchanged_count, count(*) filter (where outcome = 'gone') as gone_count, count(*) filter (where outcome in ('gone', 'failed')) as error_count from c""",
        "ingest_again": "select ''::varchar as outcome, ''::varchar as change, 0::bigint as n where false",
        "hub_pages": f"with {edges} select from_resource_id, count(distinct to_url) as links from t group by 1",
        "not_fetched": "select url from resource where last_fetched_at is null",
        "sitemap_seeded": f"""select url, case when kind = 'page' then 0 when first_seen_at < {_CUT} then priority end as priority, epoch_ms(case when first_seen_at >= {_CUT} then {_NOW} when kind = 'page' and {modified} > coalesce(last_changed_at at time zone 'UTC', timestamp '1970-01-01') then {_NOW} else next_fetch_at end) as next_ms
            from resource where kind = 'page' or first_seen_at < {_CUT}""",
        "core_coverage": "select case when priority = 1 then upper(url) else url end as url, priority < 2 or exists (select 1 from resource q where q.kind = 'page' and q.priority < 2 and lower(q.url) = lower(r.url)) as known, priority < 2 and last_fetched_at is not null as fetched from resource r where kind = 'page'",
        "sitemap_detect": "select id, kind = 'sitemap' or ends_with(url, 'sitemap.xml') as is_sitemap from resource",
        "priority_backfill": "select id, case when priority <> 1 then priority when url ilike '%/DocumentCenter/View/%' then 3 when url ilike '%/AgendaCenter/ViewFile/%' then 2 else 1 end as priority from resource",
        "resource_lookup": "select url, id, state from resource where cast('0x' || substring(sha256(url), 1, 6) as bigint) % 20 = 0 union all select 'https://nowhere.example/', null, null",
        "extract_bodies": f"with {stored} select resource_id, status, case when status = 'ok' then found end as text from x",
        "extract_due": f"with {_BLOB} select distinct id as resource_id, lower(r.sha256) as sha256 from resource r join b on b.sha256 = lower(r.sha256) where not exists (select 1 from resource_text t where t.resource_id = r.id and lower(t.sha256) = lower(r.sha256))",
        "text_upsert": f"""with {stored}, d as (select distinct resource_id, lower(sha256) as sha256, status, char_count from resource_text where created_at < {_CUT})
            select coalesce(x.resource_id, d.resource_id) as resource_id, coalesce(x.sha256, d.sha256) as sha256, coalesce(x.status, d.status) as status, case when x.resource_id is not null then case when x.status = 'ok' then length(found) else 0 end else d.char_count end as char_count, d.resource_id is not null as kept from x full join d on d.resource_id = x.resource_id""",
        "blob_unpublished": f"{marked} select count(*) as n from m where synced_at is null",
        "blob_push": f"{marked}, {pushed} select count(*) as held, count(*) filter (where outcome = 'copied') as copied, cast(coalesce(sum(size_bytes) filter (where outcome = 'copied'), 0) as bigint) as bytes, count(*) filter (where outcome <> 'missing') as stamped, count(*) filter (where outcome = 'missing') as missing from p",
        "blob_stamped": f"{marked}, {pushed} select m.sha256, epoch_ms(case when p.outcome in ('stamped', 'copied') then {_NOW} else m.synced_at end) as synced_ms from m left join p using (sha256)",
        "blob_located": f"{marked} select sha256, coalesce(in_local, false) as in_local, in_remote from m",
        "blob_view": f"{marked} select r.id, r.url, r.title, lower(r.sha256) as sha256, m.storage_key, coalesce(m.content_type, r.content_type) as content_type, m.size_bytes from resource r left join m on m.sha256 = lower(r.sha256)",
        "cascade_delete": "with g as (select id from resource where state = 'gone') select (select count(*) from resource where state is distinct from 'gone') as resources, (select count(*) from resource_text where resource_id not in (select id from g)) as texts, (select count(*) from (select distinct id, resource_id from chunk) where resource_id not in (select id from g)) as chunks, (select count(*) from resource where id not in (select id from g)) as links",
        "run_next": f"with {queue} select id, mode from q where status = 'queued' and not exists (select 1 from q where status in ('running', 'paused')) order by requested_at, id limit 1",
        "run_claimed": f"with {queue}, f as (select min(id) as id from q where status = 'queued') select case when q.id = f.id then 'running' else status end as status, count(*) as n, count(*) filter (where q.id = f.id) as mine from q, f group by 1",
        "run_reaped": f"select id, case when status in ('running', 'paused') and heartbeat_at < {_NOW} - interval 5 minute then 'failed' else status end as status, epoch_ms(case when status in ('running', 'paused') and heartbeat_at < {_NOW} - interval 5 minute then {_NOW} else finished_at end) as finished_ms from sync_run",
        "run_schedule": f"with {queue} select count(*) filter (where status in ('running', 'paused')) = 0 and coalesce(max(requested_at) filter (where mode = 'sync') <= {_NOW} - interval 24 hour, true) as due from q where status <> 'queued'",
        "run_chip": f"""with a as (select * from sync_run where status in ('queued', 'running', 'paused') order by requested_at desc, id desc limit 1) select case when a.id is null then 'idle' when (status = 'queued' and requested_at < {_NOW} - interval 12 second) or (status in ('running', 'paused') and (heartbeat_at is null or heartbeat_at < {_NOW} - interval 30 second)) then 'stale'
            when status = 'paused' then 'paused' else 'live' end as chip, a.id, a.status from (select 1) left join a on true""",
        "run_pace": f"with p as (select id, coalesce(case when (epoch_ms({_NOW}) - epoch_ms(started_at)) / 60000 > 0.05 then cast(round(requests_made / ((epoch_ms({_NOW}) - epoch_ms(started_at)) / 60000)) as bigint) else 0 end, 0) as rate from sync_run where status = 'running') select id, rate, case when rate > 0 then cast(ceil(1000 / rate) as bigint) end as minutes_left from p",
        "run_ticks": "select id, greatest(0, coalesce(fetched, 0) - coalesce(lag(coalesce(fetched, 0)) over (order by requested_at), coalesce(fetched, 0))) as delta from sync_run where requested_at is not null",
        "worker_tallies": f"with w as (select worker_id, max(heartbeat_at) as seen from sync_run where worker_id is not null group by 1), l as (select w.worker_id, max(case when s.status = 'running' then 1 else 0 end) as active from w join sync_run s on s.worker_id = w.worker_id and s.heartbeat_at = w.seen where seen >= {_NOW} - interval 30 day group by 1) select count(*) filter (where active = 1) as active, count(*) filter (where active = 0) as standby, count(*) filter (where active = 1) > 1 as multiple from l",
        "run_counters": readmodels.RUN_COUNTERS_SQL,
        "chunk_search": f"""with {good}, h as (select a.id as query_id, b.id, b.resource_id, {score} as score, row_number() over (partition by a.id order by {score} desc, b.id) as rank from k a join k b on b.embedder = a.embedder and len(b.v) = len(a.v) where cast('0x' || substring(a.id, 1, 6) as bigint) % 20 = 0),
            l as (select h.*, row_number() over (partition by query_id, resource_id order by rank) as per from h join resource r on r.id = h.resource_id where rank <= 40 and r.state not in ('gone', 'error')), m as (select query_id, id, resource_id, score, row_number() over (partition by query_id order by rank) as rank from l where per <= 3)
            select *, row_number() over (partition by query_id, resource_id order by rank) - 1 as ordinal from m where rank <= 8""",
        "bm25_from_index": retrieval.oracle_sql()["bm25_top_k"],
        "search_reply": r"with c as (select distinct resource_id, chunk_index, url, regexp_replace(substring(text, 1, 40), '^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$', '', 'g') as text from chunk where chunk_index < 5), d as (select *, row_number() over (partition by resource_id order by chunk_index) as rank from c where text <> ''), e as (select * from d where rank <= 3) select resource_id as query_id, rank, url, rank - 1 as ordinal, text from e",
        "cited_sources": "select doc_id, case when doc_id % 4 = 0 then '0 1 2' when doc_id % 4 = 3 then '1 2 3' else '1 2' end as cited, '[1] u1' || chr(10) || '[2] u2' as footer from documents",
        "prompt_messages": "select id, sha256('Question: ' || coalesce(title, '') || chr(10) || chr(10) || 'Context:' || chr(10) || path || chr(10) || chr(10) || 'Allowed URLs:' || chr(10) || url || chr(10) || host) as sha256 from resource",
        "legacy_files": "with t as (select distinct on (t.resource_id) t.resource_id, r.url, r.title, trim(t.text, ' ') as text from resource_text t join resource r on r.id = t.resource_id where t.status = 'ok') select resource_id, case when length(text) >= 80 then sha256('---' || chr(10) || 'url: \"' || url || '\"' || case when title is not null then chr(10) || 'title: \"' || replace(title, '\"', '''') || '\"' else '' end || chr(10) || '---' || chr(10) || chr(10) || text || chr(10)) end as sha256 from t",
        "legacy_due": "select url, sha256 from resource where sha256 is not null and http_status = 200 and coalesce(path, '') <> '' and not coalesce(size_bytes % 2 = 0, false)",
        "legacy_needs_ocr": "with t as (select distinct resource_id, coalesce(char_count, 0) as chars from resource_text) select resource_id as url, round(chars / (1 + chars % 30), 4) as chars_per_page from t where chars / (1 + chars % 30) < 100",
        "legacy_terms": "select id, array_to_string(regexp_extract_all(coalesce(title, ''), '[A-Za-z0-9'']+'), ' OR ') as terms from resource",
    }
