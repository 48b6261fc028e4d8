"""Processing only new or changed records with a Merkle tree over key ranges.

Every record has a digest of its key and content. Keys are ordered by a 64-bit hash, and equal ranges of that order are
the leaves of a tree; a node's digest combines the digests below it. Two trees are compared from the root down: only
below nodes whose digests differ are children looked at, and only the records of leaves that differ are read and
compared. The depth of the tree follows from the number of records (about LEAF_RECORDS a leaf), so that a leaf stays
small however many there are. Digests are stored sorted by their place in the order, so the files and row groups of
leaves that do not differ are skipped by their statistics.

A run publishes its output, the digests (not the contents) of all records and the tree in one new version folder and
then swaps one pointer file by an atomic rename. A run that dies before the rename has published nothing, and the next
run finds the same differences again (what was left is removed a day later); after the rename nothing of that run is found again.
Of two runs that started from one version, only the first can publish.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize, maybe_broadcast

FANOUT_BITS = 6
DEPTH = 2
#: Records a leaf should have at most in the mean; published versions that are kept, the last one among them.
LEAF_RECORDS, KEPT_VERSIONS = 20_000, 3


def depth_for(n: int) -> int:
    """The least depth, DEPTH or more, at which ``n`` records are at most LEAF_RECORDS a leaf in the mean."""
    return max(DEPTH, math.ceil(math.log(max(1, n) / LEAF_RECORDS, 2**FANOUT_BITS)))


def leaf_of(key: Column, depth: int = DEPTH) -> Column:
    """The number of the key range (leaf) that holds ``key``: the top bits of the key's hash."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - FANOUT_BITS * depth)


def record_digests(df: DataFrame, key: str, content: list[str], depth: int = DEPTH) -> DataFrame:
    """Rows (key, leaf, digest, *content): one per row of ``df``, whose keys are unique and not null.

    Null content has its own digest: xxhash64 leaves a null out, so a flag for each column goes in beside it.
    """
    parts = [p for c in content for p in (F.col(c).isNull(), F.col(c))]
    return df.select(F.col(key).alias("key"), leaf_of(F.col(key), depth).alias("leaf"), F.xxhash64(F.col(key), *parts).alias("digest"), *content)


def build_tree(records: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows (level, node, digest, n) for levels ``depth`` (leaves) to 0 (the root) of ``records`` (leaf, digest).

    An empty table has an empty tree. Each level is aggregated from the one below it.
    """
    level = records.groupBy(F.col("leaf").alias("node")).agg(F.bit_xor("digest").alias("x"), F.count("*").alias("n"))
    level = level.select("node", F.xxhash64("node", "x", "n").alias("digest"), "n")
    tree = None
    for k in range(depth, -1, -1):
        here = level.select(F.lit(k).alias("level"), "node", "digest", "n")
        tree = here if tree is None else tree.unionByName(here)
        level = level.groupBy(F.shiftrightunsigned("node", FANOUT_BITS).alias("node")).agg(F.bit_xor("digest").alias("x"), F.sum("n").alias("n"))
        level = level.select("node", F.xxhash64("node", "x", "n").alias("digest"), "n")
    return tree


def differing_leaves(current: DataFrame, saved: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows (leaf): leaves under which two trees of one depth differ, found by descending only below nodes that differ."""

    def differing(level: int, parents: DataFrame | None) -> DataFrame:
        sides = []
        for tree, name in ((current, "a"), (saved, "b")):
            side = tree.where(F.col("level") == level).select("node", F.col("digest").alias(name))
            if parents is not None:
                side = side.join(parents, F.shiftrightunsigned(side["node"], FANOUT_BITS) == parents["parent"], "left_semi")
            sides.append(side)
        both = sides[0].join(sides[1], "node", "full_outer")
        return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node")

    nodes = differing(0, None)
    for level in range(1, depth + 1):
        nodes = differing(level, maybe_broadcast(materialize(nodes.select(F.col("node").alias("parent")))))
    return nodes.select(F.col("node").alias("leaf"))


def changed_keys(current: DataFrame, saved: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows (key, change) of the leaves that differ: change is added, changed or removed.

    Both sides have (key, leaf, digest). The bounds of the leaves that differ are a filter that the scan can use.
    """
    low, high = leaves.agg(F.min("leaf"), F.max("leaf")).first()
    few = maybe_broadcast(leaves)

    def side(records: DataFrame, name: str) -> DataFrame:
        within = F.lit(False) if low is None else F.col("leaf").between(low, high)
        return records.where(within).join(few, "leaf", "left_semi").select("key", F.col("digest").alias(name))

    both = side(current, "now").join(side(saved, "then"), "key", "full_outer").where(~F.col("now").eqNullSafe(F.col("then")))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.select("key", change.alias("change"))


def with_content(changes: DataFrame, records: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Rows (key, change, *content) of ``changes`` (key, change): ``content`` is that of ``records``, null for a removed key."""
    return changes.join(records.select(F.col(key).alias("key"), *content), "key", "left")


def merkle_diff(current: DataFrame, saved: DataFrame, key: str, content: list[str], saved_content: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """Rows (key, change, *content): records of ``current`` that are not in ``saved`` with equal content.

    Both tables have one row per key; ``saved_content`` names the saved side's columns where they differ. Null keys
    are dropped (they cannot be carried through). Either table may be empty.
    """
    current, saved = current.where(F.col(key).isNotNull()), saved.where(F.col(key).isNotNull())
    depth = depth_for(current.count()) if depth is None else depth
    then = saved.select(key, *[F.col(b).alias(a) for a, b in zip(content, saved_content or content, strict=True)])
    sides = [materialize(record_digests(side, key, content, depth).select("key", "leaf", "digest")) for side in (current, then)]
    trees = [materialize(build_tree(side, depth)) for side in sides]
    return with_content(changed_keys(*sides, materialize(differing_leaves(*trees, depth))), current, key, content)


# ---------------------------------------------------------------- durable runs


class Outrun(RuntimeError):
    """Another run has published since this one began."""


@dataclass(frozen=True)
class Store:
    """Published versions under ``root``: ``v-<id>/{output,records,tree}`` and the pointer file ``CURRENT``."""

    spark: SparkSession
    root: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def current(self) -> dict:
        """The pointer: {versions: those kept, oldest first; depth: of the last one's tree; number: of runs published}."""
        if not self._fs().exists(self._path("CURRENT")):
            return {"versions": [], "depth": DEPTH, "number": 0}
        stream = self._fs().open(self._path("CURRENT"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def versions(self) -> list[str]:
        """Published version folders that are kept, oldest first; empty before the first run."""
        return self.current()["versions"]

    def publish(self, before: dict, version: str, depth: int) -> None:
        """Make ``version`` the last one, if the pointer still is ``before``; else raise Outrun.

        The turn is taken by creating a file that only one run can create; the pointer is then written beside the old
        one and renamed over it in one step. A turn whose run died before the rename is taken over by the next one,
        once the file is older than an hour.
        """
        jvm, files = self.spark._jvm, self._fs()
        turn = self._path(f".TURN.{before['number'] + 1}")
        if files.exists(turn) and jvm.java.lang.System.currentTimeMillis() - files.getFileStatus(turn).getModificationTime() > 3_600_000:
            files.delete(turn, False)
        if not files.createNewFile(turn):
            raise Outrun(version)
        if self.current() != before:
            files.delete(turn, False)
            raise Outrun(version)
        beside = self._path(f".CURRENT.{uuid.uuid4().hex}")
        stream = files.create(beside, True)
        kept = [*before["versions"], version][-KEPT_VERSIONS:]
        stream.write(bytearray(json.dumps({"versions": kept, "depth": depth, "number": before["number"] + 1}), "utf-8"))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        context.rename(beside, self._path("CURRENT"), options)
        files.delete(turn, False)

    def sweep(self, minutes: float = 24 * 60) -> list[str]:
        """Remove version folders that the pointer does not name and that are older than ``minutes``: failed runs and old versions."""
        known, files = set(self.versions()), self._fs()
        if not files.exists(self._path("")):
            return []
        latest = self.spark._jvm.java.lang.System.currentTimeMillis() - minutes * 60_000
        gone = [s.getPath() for s in files.listStatus(self._path("")) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in known and s.getModificationTime() <= latest]
        for path in gone:
            files.delete(path, True)
        return sorted(path.getName() for path in gone)


def run_incremental(store: Store, records: DataFrame, key: str, content: list[str], process: Callable[[DataFrame], DataFrame], depth: int | None = None) -> DataFrame:
    """Process the records added or changed since the last published run, publish, and return this run's output.

    ``process`` gets rows (key, change, *content). Its output, the digests of all current records and their tree are
    written before the pointer moves, so a failure anywhere leaves the last published state as it was. Digests are
    kept sorted by leaf. Where the depth has grown, the saved digests get their leaves anew: their keys are kept.
    """
    spark, before = store.spark, store.current()
    here = f"v-{before['number']:06d}-{uuid.uuid4().hex[:8]}"
    base = f"{store.root}/{here}"
    records = records.where(F.col(key).isNotNull())
    depth = max(before["depth"], depth_for(records.count())) if depth is None else depth
    digests = record_digests(records, key, content, depth).select("key", "leaf", "digest")
    digests.repartitionByRange("leaf").sortWithinPartitions("leaf").write.parquet(f"{base}/records")
    now = spark.read.parquet(f"{base}/records")
    build_tree(now, depth).write.parquet(f"{base}/tree")
    tree = spark.read.parquet(f"{base}/tree")
    if before["versions"]:
        last = f"{store.root}/{before['versions'][-1]}"
        then, saved = spark.read.parquet(f"{last}/records"), spark.read.parquet(f"{last}/tree")
        if before["depth"] != depth:
            then = then.withColumn("leaf", leaf_of(F.col("key"), depth))
            saved = materialize(build_tree(then, depth))
    else:
        then, saved = now.limit(0), tree.limit(0)
    changes = changed_keys(now, then, materialize(differing_leaves(tree, saved, depth)))
    process(with_content(changes, records, key, content)).write.parquet(f"{base}/output")
    store.publish(before, here, depth)
    store.sweep()
    return spark.read.parquet(f"{base}/output")


# ---------------------------------------------------------------- stages of the crawler's derivation


#: Characters that count as trailing white space of a text; no-break spaces and the byte order mark are among them.
WHITE_SPACE = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def carried_through(resource_text: DataFrame, chunk: DataFrame) -> DataFrame:
    """Rows (id, carried, text_sha, status, has_chunks): how far each resource's text has been carried.

    ``carried`` is the sha256 that text and chunks both show completely, else null. Shas are compared in lower case.
    Chunks without a text row are not carried. Repeated deliveries of a chunk count once: the index check uses
    distinct indexes, so does not depend on them.
    """
    text = resource_text.select(
        F.col("resource_id").alias("id"), F.lower("sha256").alias("text_sha"), "status",
        F.char_length("text").alias("full_end"), F.char_length(F.rtrim("text", F.lit(WHITE_SPACE))).alias("least_end"),
    ).distinct()
    pieces = (
        chunk.select(F.col("resource_id").alias("id"), "chunk_index", F.lower("source_sha").alias("sha"), "char_end")
        .groupBy("id", "chunk_index").agg(F.min("sha").alias("low"), F.max("sha").alias("high"), F.max(F.col("sha").isNull()).alias("lost"), F.max("char_end").alias("char_end"))
        .groupBy("id").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.max("lost").alias("lost"),
            F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"), F.count("chunk_index").alias("n"),
            F.max_by("char_end", "chunk_index").alias("end"),
        )
    )
    both = text.join(pieces, "id", "left").withColumn("has_chunks", F.col("n").isNotNull())
    complete = (
        (F.col("low") == F.col("text_sha")) & (F.col("high") == F.col("text_sha")) & ~F.col("lost")
        & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & F.col("end").between(F.col("least_end"), F.col("full_end"))
    )
    done = F.when(F.col("status") == "ok", F.coalesce(complete, F.lit(False))).otherwise(~F.col("has_chunks"))
    return both.select("id", F.when(done, F.col("text_sha")).alias("carried"), "text_sha", "status", "has_chunks")


def stages_due(resource: DataFrame, resource_text: DataFrame, chunk: DataFrame) -> DataFrame:
    """Rows (resource_id, stage): resources with a sha256 whose content is not carried through, at the first stage due.

    The current side is each resource's sha256, the saved side the sha256 its derived rows show complete; the two
    Merkle trees are compared and only leaves that differ are looked into. ``extract``: no text of that sha256.
    ``clear``: the text is not ok but chunks are left. ``embed``: the chunks of an ok text are not complete. A resource
    without sha256 has nothing to carry and no row; repeated deliveries count once; empty tables give no rows or, for
    empty derived tables, ``extract`` for all.
    """
    wanted = resource.where(F.col("id").isNotNull() & F.col("sha256").isNotNull()).select("id", F.lower("sha256").alias("sha")).distinct()
    derived = materialize(carried_through(resource_text, chunk))
    due = merkle_diff(wanted, derived.where(F.col("carried").isNotNull()), "id", ["sha"], ["carried"])
    due = due.where(F.col("change") != "removed").select(F.col("key").alias("id"), "sha")
    state = due.join(derived, (due["id"] == derived["id"]) & (due["sha"] == derived["text_sha"]), "left").select(due["id"], "text_sha", "status", "has_chunks")
    stage = F.when(F.col("text_sha").isNull(), "extract").when((F.col("status") == "ok").eqNullSafe(True), "embed").otherwise("clear")
    return state.select(F.col("id").alias("resource_id"), stage.alias("stage"))
