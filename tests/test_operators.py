from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import answer, export, frontier, links, manifest, readmodels, retrieve
from corpusloom.streaming import changes


def test_classify_keeps_sha_over_nulls_and_failures(spark):
    log = [("v1", "a", 1, None, "x", None), ("v2", "a", 2, "s1", "x", 10), ("v3", "a", 3, None, "x", 10), ("v4", "a", 4, "s1", "x", 10), ("v5", "a", 5, None, "gone", None), ("v6", "a", 6, "s2", "x", 11), ("v6", "a", 6, "s2", "x", 11)]
    df = spark.createDataFrame([(i, r, datetime(2025, 1, d), s, k, n) for i, r, d, s, k, n in log], "id string, resource_id string, observed_at timestamp, sha256 string, change_kind string, size_bytes long")
    assert {r["id"]: r["kind"] for r in manifest.classify(df).collect()} == {"v1": "probed", "v2": "new", "v3": "unchanged", "v4": "unchanged", "v5": "gone", "v6": "changed"}


def test_snapshots(spark):
    old = spark.createDataFrame([("1", 1), ("1", 2), ("2", 1)], "k string, v int")
    new = spark.createDataFrame([("1", 9)], "k string, v int")
    assert sorted(map(tuple, manifest.replace_groups(old, new, new, "k").collect())) == [("1", 9), ("2", 1)]
    assert sorted(map(tuple, manifest.insert_absent(new, old, "k").collect())) == [("1", 9), ("2", 1)]
    held = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", datetime(2025, 1, 1))], "sha256 string, synced_at timestamp")
    lists = [spark.createDataFrame([(x,) for x in s], "sha256 string") for s in ("abd", "a")]
    assert {r["outcome"]: r["n"] for r in manifest.push_outcomes(held, *lists).collect()} == {"stamped": 1, "copied": 1, "missing": 1}


def test_links_and_reach(spark):
    pages = spark.createDataFrame([("p1", "https://e.org/a", '<a href="b#x">1</a><a href="b">2</a><a href="mailto:x@e.org">m</a>'), ("p2", "https://e.org/b", "<p>none"), ("p3", "https://e.org/c", None)], "id string, url string, html string")
    found = links.page_links(pages)
    assert [tuple(r) for r in found.collect()] == [("p1", "https://e.org/b")] * 2
    resolved = links.resolve(found, pages)
    assert {r["id"] for r in links.orphans(resolved, pages).collect()} == {"p1", "p3"}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "from_url string, to_url string")
    seen = links.reachable(edges, spark.createDataFrame([("a",)], "url string"))
    assert {(r["url"], r["level"]) for r in seen.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    old = spark.createDataFrame([("p1", "https://e.org/b", "r0", "r0"), ("p9", "z", "r0", "r0")], "from_resource_id string, to_url string, first_run_id string, last_run_id string")
    assert {tuple(r) for r in links.merge_links(old, found, "r1").collect()} == {("p1", "https://e.org/b", "r0", "r1"), ("p9", "z", "r0", "r0")}


def test_reach_follows_chains_to_their_end(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(23)], "from_url string, to_url string")
    seeds = spark.createDataFrame([("n0",)], "url string")
    assert {(r["url"], r["level"]) for r in links.reachable(edges, seeds).collect()} == {(f"n{k}", k) for k in range(24)}
    with pytest.raises(ValueError, match="levels"):
        links.reachable(edges, seeds, levels=2)


def test_scope_knows_every_host(spark, tmp_path):
    from corpusloom.plans import pipeline

    spark.range(10_050).selectExpr("concat('r', id) as id", "format_string('h%05d.example', id) as host", "'page' as kind", "format_string('https://h%05d.example/a', id) as url").write.parquet(f"{tmp_path}/resource.parquet")
    assert pipeline.url_in_scope(spark, str(tmp_path)).where("in_scope").count() == 10_050


def test_vector_search_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 8)).astype(np.float32)
    data[7] = data[3]
    data[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(99, None)], "id long, embedding array<float>").repartition(3)
    queries = df.where("id % 20 = 3").select(F.col("id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieve.vector_top_k(df, queries, 5, block=2).collect()}
    unit = data.astype(float) / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-9)
    for q in (3, 23, 43):
        scores = np.round(unit @ unit[q], 6)
        want = [i for i in np.lexsort((np.arange(60), -scores)) if i != 9][:5]
        assert [got[q, k] for k in range(1, 6)] == want
    assert retrieve.vector_top_k(df, queries.limit(0), 5).count() == 0


def test_cap_filters_after_candidates(spark):
    hits = spark.createDataFrame([(1, i, 1 - i / 10, i + 1, "a" if i < 4 else "b") for i in range(6)], "query_id int, id int, score double, rank int, g string")
    assert [(r["id"], r["rank"]) for r in retrieve.capped(hits, "g", 1, 8).orderBy("rank").collect()] == [(0, 1), (4, 2)]


def test_policy_and_metrics(spark):
    rows = [("a", '{"mode":"grounded","answer":"x","citations":["u2","u1","u2"]}', ["u1", "u2"]), ("b", "{}", []), ("c", "", None)]
    got = {r["id"]: r for r in answer.policy(spark.createDataFrame(rows, "id string, raw string, urls array<string>")).collect()}
    assert got["a"]["citations"] == ["u2", "u1"] and got["b"]["mode"] == got["c"]["mode"] == "abstained"
    outcomes = spark.createDataFrame([("grounded", "grounded", None, ["u"], ["u"]), ("abstained", "grounded", None, [], ["u"])], "expected_mode string, mode string, expected_source string, retrieved array<string>, citations array<string>")
    m = answer.metrics(outcomes).first()
    assert m["hit_rate"] != m["hit_rate"] and m["mode_correct"] == 0.5 and m["citations_valid"] == 0.5


def test_export_limits(spark):
    texts = spark.createDataFrame([("r1", "ok", "é" * 5), ("r2", "ok", "é" * 6), ("r3", "ok", "  "), ("r4", "scanned", None)], "resource_id string, status string, text string")
    resource = spark.createDataFrame([(f"r{n}", f"u{n}", None if n == 1 else "t\né", "page") for n in range(1, 5)], "id string, url string, title string, kind string")
    got = {r["key"]: r for r in export.index_objects(texts, resource, 10).collect()}
    assert [got[f"index/r{n}.md"]["skip_reason"] for n in range(1, 5)] == [None, "too_large", "blank", "not_ok"]
    assert got["index/r1.md"]["title"] == "u1" and got["index/r2.md"]["title"] == "t"


def test_empty_tables(spark, tmp_path):
    schemas.create_if_absent(spark, str(tmp_path))
    schemas.create_if_absent(spark, str(tmp_path))
    read = {name: schemas.read(spark, str(tmp_path), name) for name in schemas.TABLES}
    now = datetime(2025, 1, 1)
    assert readmodels.storage_health(readmodels.blobs(read["resource_version"]), read["resource"], now).first()["stored_bytes"] == 0
    assert readmodels.sync_progress(read["resource"], now).first()["percent"] is None
    assert frontier.due_batch(read["resource"], now).count() == 0
    assert frontier.needs_embed(read["resource_text"], read["chunk"]).count() == 0
    assert readmodels.dedup_savings(read["resource_version"], readmodels.blobs(read["resource_version"])).first()["saved_bytes"] == 0


def test_stream_is_idempotent(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    row = ["id", "resource_id", "run", datetime(2025, 1, 1), "new", 200, "t", 1, "AB", None, None, None, None]
    df = spark.createDataFrame([tuple(row), (*["id2", *row[1:3]], datetime(2025, 1, 2), *row[4:8], "ab", *row[9:]), (*["id3", *row[1:8]], None, *row[9:])], schemas.SCHEMAS["resource_version"])
    df.repartition(3).write.parquet(source)
    held = []
    for checkpoint in ("c1", "c2"):
        changes.append_changes(changes.stream_table(spark, source, "resource_version"), log, str(tmp_path / checkpoint))
        held.append(spark.read.parquet(log).count())
        assert [(r["resource_id"], r["sha256"], r["observed_at"]) for r in changes.first_seen(spark, log).collect()] == [("resource_id", "ab", datetime(2025, 1, 1))]
    assert held[0] == held[1]


def test_an_earlier_sight_that_comes_late_is_kept(spark, tmp_path):
    source, log = tmp_path / "in", str(tmp_path / "log")
    for n, day in enumerate((5, 3, 9)):
        row = (f"v{n}", "r", "run", datetime(2025, 1, day), "new", 200, "t", 1, "ab", None, None, None, None)
        spark.createDataFrame([row], schemas.SCHEMAS["resource_version"]).coalesce(1).write.mode("append").parquet(str(source))
        changes.append_changes(changes.stream_table(spark, str(source), "resource_version"), log, str(tmp_path / "state"))
    assert [(r["observed_at"], r["id"]) for r in changes.first_seen(spark, log).collect()] == [(datetime(2025, 1, 3), "v1")]
    assert spark.read.parquet(log).count() == 2


def test_intermediates_can_be_released(spark, tmp_path):
    from corpusloom import session

    kept = session.materialize(spark.range(3))
    assert kept.count() == 3 and session.release(spark) >= 1 and session.release(spark) == 0
    wide = spark.range(10).selectExpr("repeat('x', 100) as s", "array(id, id) as a")
    assert "ResolvedHint" in session.maybe_broadcast(wide)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in session.maybe_broadcast(wide, size=500)._jdf.queryExecution().analyzed().toString()
    objects = spark.createDataFrame([("k", "b", "u", "t", "page", None), ("l", None, "u", "t", "page", "blank")], "key string, body string, url string, title string, kind string, skip_reason string")
    export.write_objects(objects, str(tmp_path / "objects"))
    assert [(r["key"], r["metadata"]["kind"]) for r in spark.read.parquet(str(tmp_path / "objects")).collect()] == [("k", "page")]


def test_hybrid_search_fuses_words_and_vectors(spark, tmp_path):
    documents = spark.createDataFrame([(1, "the mill road is closed", [1.0, 0.0]), (2, "a mill", [0.0, 1.0]), (3, "nothing of it", [0.9, 0.1]), (4, None, None)], "id int, text string, embedding array<float>")
    asked = spark.createDataFrame([(7, "mill road", [1.0, 0.0])], "query_id int, text string, embedding array<float>")
    lexical = retrieve.bm25(documents.select("id", "text"), asked.select("query_id", "text"), 50)
    cosine = retrieve.vector_top_k(documents.select("id", "embedding"), asked.select("query_id", "embedding"), 50)
    got = {r["id"]: (r["rank"], r["text"]) for r in retrieve.hybrid(lexical, cosine, documents.select("id", "text"), 2).collect()}
    assert got == {1: (1, "the mill road is closed"), 2: (2, "a mill")}
    path = str(tmp_path / "index")
    retrieve.build_index(documents.select("id", "text"), path)
    assert sorted(map(tuple, retrieve.bm25_from(spark, path, asked, 50).collect())) == sorted(map(tuple, lexical.collect()))


def test_windowed_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [(datetime(2025, 1, d, h), "a" if h % 2 else "b", float(h), d) for d in (1, 2) for h in range(0, 24, 3)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double, user_id long").write.parquet(path)
    batch = changes.windowed_counts(spark.read.parquet(path))
    query = changes.windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double, user_id long").parquet(path)).writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert set(map(tuple, spark.sql("select * from windowed").collect())) == set(map(tuple, batch.collect()))
