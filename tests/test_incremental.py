import pytest
from pyspark.sql import functions as F

from corpusloom.operators import incremental as I

SCHEMA = "id string, body string, extra int"


def rows(spark, values, schema=SCHEMA):
    return spark.createDataFrame(values, schema)


def found(df):
    return {(r["key"], r["change"]) for r in df.collect()}


def test_diff_finds_exactly_what_differs(spark):
    old = rows(spark, [(f"k{n}", f"v{n}", n) for n in range(300)])
    new = rows(spark, [(f"k{n}", f"v{n}" if n != 7 else None, n) for n in range(1, 300)] + [("new", "x", 0), (None, "y", 1)])
    assert found(I.merkle_diff(new, old, "id", ["body"])) == {("k0", "removed"), ("k7", "changed"), ("new", "added")}
    assert found(I.merkle_diff(new, new, "id", ["body"])) == set()
    assert found(I.merkle_diff(new.limit(0), new.limit(0), "id", ["body"])) == set()
    assert len(found(I.merkle_diff(old, old.limit(0), "id", ["body"]))) == 300


def test_null_and_empty_content_differ(spark):
    assert found(I.merkle_diff(rows(spark, [("a", None, 1)]), rows(spark, [("a", "", 1)]), "id", ["body"])) == {("a", "changed")}


def test_descends_only_below_differences(spark):
    a = I.record_digests(rows(spark, [(f"k{n}", "v", n) for n in range(500)]), "id", ["body"])
    b = I.record_digests(rows(spark, [(f"k{n}", "v" if n else "w", n) for n in range(500)]), "id", ["body"])
    leaves = I.differing_leaves(I.build_tree(a), I.build_tree(b)).collect()
    assert [r["leaf"] for r in leaves] == [r["leaf"] for r in a.where("key = 'k0'").select("leaf").collect()]
    root = I.build_tree(a).where("level = 0").collect()
    assert len(root) == 1 and root[0]["n"] == 500


def test_runs_skip_and_repeat_nothing_through_a_failure(spark, tmp_path):
    store = I.Store(spark, str(tmp_path / "store"))
    first = rows(spark, [("a", "1", 0), ("b", "1", 0)])
    second = rows(spark, [("a", "2", 0), ("b", "1", 0), ("c", "1", 0)])

    def run(df, process=lambda x: x):
        return {r["key"] for r in I.run_incremental(store, df, "id", ["body"], process).collect()}

    assert run(first) == {"a", "b"}
    assert run(first) == set()

    def failing(df):
        return df.withColumn("bad", F.raise_error(F.lit("boom")))

    with pytest.raises(Exception, match="boom"):
        run(second, failing)
    assert len(store.versions()) == 2
    assert run(second) == {"a", "c"}
    assert run(second) == set()


def test_of_two_runs_from_one_version_one_publishes(spark, tmp_path):
    store = I.Store(spark, str(tmp_path / "store"))
    made = rows(spark, [("a", "1", 0)])

    def overtaken(df):
        I.run_incremental(store, made, "id", ["body"], lambda x: x)
        return df

    with pytest.raises(I.Outrun):
        I.run_incremental(store, made, "id", ["body"], overtaken)
    assert len(store.versions()) == 1 and store.current()["number"] == 1
    left = store.sweep(minutes=0)
    assert len(left) == 1 and left[0] not in store.versions()
    assert I.run_incremental(store, made, "id", ["body"], lambda x: x).count() == 0


def test_a_deeper_tree_finds_the_same(spark, tmp_path):
    store = I.Store(spark, str(tmp_path / "store"))
    made = [(f"k{n}", "v", n) for n in range(200)]
    assert I.run_incremental(store, rows(spark, made), "id", ["body"], lambda x: x, depth=2).count() == 200
    changed = rows(spark, [("k3", "w", 3), *made[4:]])
    assert {tuple(r) for r in I.run_incremental(store, changed, "id", ["body"], lambda x: x.select("key", "change"), depth=3).collect()} == {("k3", "changed"), ("k0", "removed"), ("k1", "removed"), ("k2", "removed")}
    assert set(spark.read.parquet(f"{store.root}/{store.versions()[-1]}/records").columns) == {"key", "leaf", "digest"}
    assert [I.depth_for(n) for n in (0, 10**6, 10**8, 10**10)] == [2, 2, 3, 4]


def test_stages_on_dirty_tables(spark):
    resource = spark.createDataFrame([("r1", "AA"), ("r1", "AA"), ("r2", "bb"), ("r3", "cc"), ("r4", "dd"), ("r5", "ee"), ("r6", "ff"), ("r7", None), (None, "gg"), ("r8", "hh")], "id string, sha256 string")
    text = spark.createDataFrame(
        [("r2", "old", "ok", "abc"), ("r3", "cc", "scanned", None), ("r4", "dd", "ok", "abcdef   \n"), ("r4", "dd", "ok", "abcdef   \n"), ("r5", "EE", "ok", "abcdef"), ("r6", "ff", "empty", None), ("r8", "hh", "ok", "abc")],
        "resource_id string, sha256 string, status string, text string",
    )
    chunk = spark.createDataFrame(
        [("r3", "cc", 0, 3), ("r4", "DD", 0, 4), ("r4", "dd", 1, 6), ("r4", "dd", 1, 6), ("r5", "ee", 0, 4), ("r5", "ee", 2, 6), ("r8", "hh", 0, 2)],
        "resource_id string, source_sha string, chunk_index int, char_end int",
    )
    out = {(r["resource_id"], r["stage"]) for r in I.stages_due(resource, text, chunk).collect()}
    assert out == {("r1", "extract"), ("r2", "extract"), ("r3", "clear"), ("r5", "embed"), ("r8", "embed")}
    empty = I.stages_due(resource, text.limit(0), chunk.limit(0)).collect()
    assert {r["stage"] for r in empty} == {"extract"} and len(empty) == 7
    assert I.stages_due(resource.limit(0), text, chunk).count() == 0
