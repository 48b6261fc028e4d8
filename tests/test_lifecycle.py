"""The jobs from observations to chunks on small fixtures."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom import config, evaluation, providers, schemas
from corpusloom.operators import derive, ingest, legacy, publish, runs
from corpusloom.sources import robots

NOW, LATER = datetime(2025, 1, 1), datetime(2025, 1, 9)
BLOB = "sha256 string, size_bytes bigint, content_type string, storage_key string, ref_count bigint, synced_at timestamp, created_at timestamp"
LINK = "from_resource_id string, to_url string, first_run_id string, last_run_id string"
SEEN = "url string, status int, content_type string, headers map<string,string>, body string"


def site(b="second", extra=()):
    def page(name, body, links=""):
        return (f"https://e.org/{name}", 200, "text/html; charset=utf-8", {"ETag": name}, f"<title>{name}</title><p>{body} page{links}</p>")

    return [page("a", "first", '<a href="/b">b</a><a href="c">c</a><a href="/login">no</a>'), page("b", b), page("c", "third"), *extra]


def test_three_pages_then_the_same_then_one_edit(spark):
    manifest, blob, link = (spark.createDataFrame([], s) for s in (schemas.SCHEMAS["resource"], BLOB, LINK))
    rows = []
    for number, seen in enumerate([site(), site(), site("another")]):
        batch = spark.createDataFrame(seen, SEEN)
        out = ingest.ingest(batch, manifest, blob, link, f"run{number}", NOW if number < 2 else LATER)
        rows.append(out.versions.count())
        manifest, blob, link = (spark.createDataFrame(df.collect(), df.schema) for df in (out.resource, out.blob, out.link.select("from_resource_id", "to_url", "first_run_id", "last_run_id")))
    assert rows == [3, 0, 1] and blob.count() == 4 and manifest.count() == 3
    assert {r["url"] for r in manifest.where(F.col("last_changed_at") == F.lit(LATER)).collect()} == {"https://e.org/b"}
    assert {(r["to_url"], r["first_run_id"], r["last_run_id"]) for r in link.collect()} == {(f"https://e.org/{x}", "run0", "run2") for x in "bc"}


def test_outcomes_that_are_no_content(spark):
    other = [("https://e.org/x", 404, "text/html", {}, "gone"), ("https://e.org/y", None, None, {}, None), ("https://e.org/z", 503, None, {}, None), ("https://e.org/i", 200, "image/png", {}, "x"), ("https://e.org/sitemap.xml", 200, "text/xml", {}, "<urlset><loc>https://e.org/new</loc></urlset>"), ("https://e.org/d.pdf", 200, "application/pdf", {"Content-Length": "99", "content-disposition": 'inline; filename="d.pdf"'}, "pdf"), (None, 200, "text/html", {}, "x")]
    known = spark.createDataFrame([tuple({"id": "r1", "url": "https://e.org/z", "state": "active", "priority": 1, "sha256": "s", "kind": "page"}.get(c) for c in schemas.SCHEMAS["resource"].names)], schemas.SCHEMAS["resource"])
    empty = [spark.createDataFrame([], s) for s in (BLOB, LINK)]
    out = ingest.ingest(spark.createDataFrame(other, SEEN), known, *empty, "run", NOW, limit=50)
    state = {r["url"]: (r["state"], r["sha256"], r["title"]) for r in out.resource.collect()}
    assert state == {"https://e.org/x": ("gone", None, None), "https://e.org/z": ("error", "s", None), "https://e.org/d.pdf": ("active", None, "d.pdf"), "https://e.org/new": ("active", None, None)}
    assert {(r["resource_id"] == "r1", r["change_kind"], r["size_bytes"]) for r in out.versions.collect()} == {(False, "gone", None), (True, "error", None), (False, "probed", 99)}
    c = out.counters.first()
    assert (c["requests_made"], c["documents"], c["gone_count"], c["error_count"], c["bytes_estimated"], c["bytes_stored"]) == (6, 1, 1, 3, 99, 0)
    nothing = ingest.ingest(spark.createDataFrame([], SEEN), known.limit(0), *empty, "run", NOW)
    assert nothing.resource.count() == nothing.versions.count() == nothing.link.count() == 0


TEXTS = "id string, resource_id string, sha256 string, content_type string, status string, text string, char_count bigint, extractor string, created_at timestamp, updated_at timestamp"
CHUNKS = "id string, resource_id string, source_sha string, chunk_index int, text string, char_start int, char_end int, embedding array<float>, embedder string, url string, title string, kind string, created_at timestamp"


def test_extraction_and_upsert(spark):
    def pdf(body):
        if body == b"broken":
            raise ValueError("no pdf")
        return body.decode()

    bodies = [("r1", "s1", "text/html", b"<p>some words</p>"), ("r2", "s2", "application/pdf", b"--"), ("r3", "s3", "application/pdf", b"broken"), ("r4", "s4", "image/png", b"x"), ("r5", "s5", "application/pdf", b"a text"), ("r6", "s6", "text/html", b"<nav>x</nav>"), ("r7", "s7", None, None)]
    made = derive.extract(spark.createDataFrame(bodies, "resource_id string, sha256 string, content_type string, body binary"), pdf)
    assert {(r["resource_id"], r["status"], r["text"]) for r in made.collect()} == {("r1", "ok", "some words"), ("r2", "scanned", None), ("r4", "unsupported", None), ("r5", "ok", "a text"), ("r6", "empty", None)}
    old = spark.createDataFrame([("t1", "r1", "s0", "text/html", "ok", "old", 3, "x", NOW, NOW), ("t9", "r9", "s9", "text/html", "ok", "kept", 4, "x", NOW, NOW)], TEXTS)
    after = {r["resource_id"]: r for r in derive.upsert_texts(old, made, LATER).collect()}
    assert len(after) == 6 and after["r1"]["id"] == "t1" and (after["r1"]["created_at"], after["r1"]["updated_at"]) == (NOW, LATER) and after["r9"]["text"] == "kept" and after["r2"]["char_count"] == 0


def test_only_changed_texts_are_embedded_again(spark):
    prose = "The board of the town has said that it will be open to all who want to see the plan for the mill and the road. " * 3

    def texts(*rows):
        return spark.createDataFrame([(f"t{r}", r, sha, "text/html", status, text, 1, "x", NOW, NOW) for r, sha, status, text in rows], TEXTS)

    resource = spark.createDataFrame([(r, f"https://e.org/{r}", None, "page") for r in ("r1", "r2", "r3")], "id string, url string, title string, kind string")
    model = derive.HashEmbedder(16)
    first = derive.embed_job(texts(("r1", "A", "ok", prose), ("r2", "b", "ok", prose), ("r3", "c", "ok", "Home News Contact Login Search Menu")), resource, spark.createDataFrame([], CHUNKS), model, NOW).collect()
    assert {r["resource_id"] for r in first} == {"r1", "r2"} and all(len(r["embedding"]) == 16 and r["embedder"] == "hash-16" for r in first)
    chunk = spark.createDataFrame(first, CHUNKS)
    second = derive.embed_job(texts(("r1", "new", "ok", prose + "More."), ("r2", "b", "scanned", None)), resource, chunk, model, LATER).collect()
    assert {(r["resource_id"], r["source_sha"], r["created_at"]) for r in second} == {("r1", "new", LATER)}

    class Bad(derive.HashEmbedder):
        def embed(self, texts):
            return [[1.0]] * len(texts)

    with pytest.raises(ValueError, match="hash-16"):
        derive.checked(Bad(16), ["a"])


def test_publishing_marks_what_arrived(spark, tmp_path):
    blob = spark.createDataFrame([("a", 1, None, "blobs/a", 1, None, NOW), ("b", 2, None, "blobs/b", 1, None, NOW), ("c", 4, None, "local/c", 1, None, NOW), ("d", 8, None, "blobs/d", 1, NOW, NOW)], BLOB)
    bodies = spark.createDataFrame([("a", b"x"), ("d", b"y")], "sha256 string, body binary")
    path = str(tmp_path / "remote")
    plan, same = publish.push(blob, bodies, path, LATER, dry_run=True)
    assert publish.push_counts(plan).first().asDict() == {"held": 2, "copied": 1, "bytes": 1, "stamped": 1, "missing": 1} and same is blob
    plan, after = publish.push(blob, bodies, path, LATER)
    assert {r["sha256"] for r in after.where(F.col("synced_at") == F.lit(LATER)).collect()} == {"a"}
    assert publish.push_counts(publish.push(after, bodies, path, LATER)[0]).first()["copied"] == 0


def test_runs(spark):
    made = spark.createDataFrame([("a", "sync", "queued", "none", NOW, None, None), ("b", "sync", "queued", "none", LATER, None, None)], "id string, mode string, status string, control string, requested_at timestamp, heartbeat_at timestamp, started_at timestamp")
    made = made.withColumns({"worker_id": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string"), "discovery_enabled": F.lit(True)})
    assert [r["id"] for r in runs.next_queued(made).collect()] == ["a"]
    held = runs.claim(made, "a", "w", NOW)
    assert runs.next_queued(held).count() == 0 and runs.claim(held, "a", "v", NOW).where("worker_id = 'v'").count() == 0
    told = runs.set_control(held, "a", "pause")
    assert runs.heartbeat(told, "a", NOW)[1].first()["control"] == "pause" and runs.set_control(told, "a", "resume").where("control = 'pause'").count() == 0
    assert runs.reap(held, LATER).where("status = 'failed'").count() == 1 and runs.reap(held, NOW).where("status = 'failed'").count() == 0
    assert len(runs.mark_failed(held, "a", "x" * 5000, NOW).where("id = 'a'").first()["error"]) == 2000
    assert runs.status_chip(made.limit(0), NOW).first()["chip"] == "idle" and runs.schedule_due(made.limit(0), NOW, 1).first()["due"] and not runs.schedule_due(made.limit(0), NOW, 0).first()["due"]


def test_driving():
    flags = iter(["none", "pause", "none", "none", "cancel"])
    done = []
    assert runs.drive(lambda n: done.append(n) or 1, lambda: next(flags), lambda: done.append("z")) == "canceled" and done == [0, "z", 1, 2]
    assert runs.drive(lambda n: 2 - n, lambda: "none", lambda: None) == "done" and runs.drive(lambda n: 9, lambda: "none", lambda: None, 2) == "more"


def test_settings_and_seams(spark, tmp_path):
    assert config.Config.from_environment({"CORPUSLOOM_CHUNK_CHARS": "900", "CORPUSLOOM_BM25_B": "0.5"}).chunk_chars == 900
    with pytest.raises(ValueError, match="x"):
        config.Config.from_environment({"CORPUSLOOM_CHUNK_CHARS": "x"})
    assert [providers.provider_name(x) for x in (None, " AI-Search ", "aisearch")] == ["vectorize", "ai-search", "vectorize"]
    assert providers.model_name("answer", {"CORPUSLOOM_ANSWER_MODEL": "m"}) == "m" and providers.model_name("escalation", {}) == "scripted"
    asked = spark.createDataFrame([(1, "q"), (2, None)], "id int, message string")
    assert {tuple(r) for r in providers.completed(asked, providers.Scripted(str.upper), "s").collect()} == {(1, "Q"), (2, None)}
    ran = []
    steps = {"0002": lambda s, r: ran.append(2), "0001": lambda s, r: ran.append(1)}
    assert schemas.migrate(spark, str(tmp_path), steps) == ["0001", "0002"] and schemas.migrate(spark, str(tmp_path), steps | {"0003": lambda s, r: ran.append(3)}) == ["0003"] and ran == [1, 2, 3]
    assert robots.load(lambda u, h: (404, {}, b""), "e.org", "x") == [] and robots.load(lambda u, h: (200, {}, b"User-agent: *\nDisallow: /a"), "e.org", "x") == [(False, "/a")]

    def failing(url, headers):
        raise OSError

    assert robots.load(failing, "e.org", "x") == []


def test_legacy_parts(spark):
    df = spark.createDataFrame([("https://E.org/a?b=2&a=1&utm_x=3#f", "It's [1], [3] and [2].")], "url string, a string")
    row = df.select(legacy.sorted_url("url").alias("u"), legacy.match_expression(F.col("a")).alias("m"), legacy.source_footer(F.col("a"), F.array(F.lit("x"), F.lit("y"))).alias("f")).first()
    assert tuple(row) == ("https://e.org/a?a=1&b=2", "It's OR 1 OR 3 OR and OR 2", "[1] x\n[2] y")
    state = spark.createDataFrame([("u", "1")], "url string, sha256 string")
    new = spark.createDataFrame([("u", "2"), ("v", "1")], "url string, sha256 string")
    assert legacy.to_extract(new, state).count() == 2 and {tuple(r) for r in legacy.next_state(state, new).collect()} == {("u", "2"), ("v", "1")}


def test_evaluation_of_the_fixture(spark):
    outcomes = evaluation.evaluate(*evaluation.seed(spark))
    rows = {r["query_id"]: r for r in outcomes.collect()}
    assert len(rows) == 10 and all(set(r["citations"]) <= set(r["retrieved"]) for r in rows.values())
    assert all(rows[n]["mode"] == rows[n]["expected_mode"] for n in rows), {n: (rows[n]["mode"], rows[n]["citations"]) for n in rows if rows[n]["mode"] != rows[n]["expected_mode"]}
    assert "10 questions" in evaluation.report(outcomes) and evaluation.report(outcomes, markdown=True).count("| yes |") == 10
