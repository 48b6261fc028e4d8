"""The most similar vectors of every vector (problem 6): a hash-prefix forest, then exact cosines.

Each tree gives a vector a string of symbols; a symbol is the largest of WIDTH random projections in absolute value,
with its sign, so that near vectors share symbols. Strings grow with the collection, by a symbol for every 2 * WIDTH
times as many vectors, so that cells keep their size, and the trees with them, so that near vectors meet as often (see
:func:`forest`). Vectors that share a string in a tree are one cell of it, and a cell is compared in full whatever its size: up to CELL vectors by sign sketches, and pairs that pass are
checked exactly; a larger one in pairs of stripes, by the vectors themselves, of which each keeps its nearest in every
pair of stripes. The nearest of all are among these, so a crowd loses nothing and gives no more pairs than it has to.
The work grows with the square of a crowd.

Vectors equal up to a power of two are one class with its least id as representative, so copies never meet in pairs;
vectors that are only nearly equal are compared like any others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import materialize, maybe_broadcast

#: Trees and symbols of a string up to PER_CELL * (2 * WIDTH) ** DEPTH vectors, projections of a symbol, bits of a sketch.
TREES, DEPTH, WIDTH, BITS, PER_CELL = 32, 2, 32, 256, 250
#: Places to which cosines are equal: below them the order of the terms in a sum decides.
PLACES = 9
#: How often vectors at LEAST_COSINE share a symbol (measured for WIDTH), which sets how many more trees a symbol takes.
SHARED = 0.4
#: Most vectors of a cell that are compared by sketches; vectors in a stripe of a larger cell; rows of a block of it.
CELL, STRIPE, BLOCK = 1_000, 20_000, 512
NEIGHBOURS, LEAST_COSINE = 5, 0.8
#: Sketches may differ in so many bits: the mean at LEAST_COSINE and three deviations.
APART = int(BITS * (q := np.arccos(LEAST_COSINE) / np.pi) + 3 * np.sqrt(BITS * q * (1 - q)))

_SCHEMA = "embedder string, dim int, h1 bigint, h2 bigint, id string, sketch binary, codes binary"
_PROJECTIONS: dict[tuple[int, int], np.ndarray] = {}


def forest(n: int) -> tuple[int, int]:
    """(trees, symbols of a string) for ``n`` vectors."""
    depth = DEPTH
    while n > PER_CELL * (2 * WIDTH) ** depth:
        depth += 1
    return int(np.ceil(TREES / SHARED ** (depth - DEPTH))), depth


def _projection(dim: int, symbols: int) -> np.ndarray:
    if (dim, symbols) not in _PROJECTIONS:
        _PROJECTIONS.clear()
        _PROJECTIONS[dim, symbols] = np.random.default_rng(dim).standard_normal((dim, symbols * WIDTH + BITS), np.float32)
    return _PROJECTIONS[dim, symbols]


def describe(unit: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(sign sketches, symbols) of unit vectors: arrays of BITS / 8 and ``symbols`` bytes a row."""
    seen = unit @ _projection(unit.shape[1], symbols)
    signs = np.packbits(seen[:, -BITS:] > 0, axis=1)
    cells = seen[:, :-BITS].reshape(-1, symbols, WIDTH)
    top = np.abs(cells).argmax(2)
    positive = np.take_along_axis(cells, top[:, :, None], 2)[:, :, 0] > 0
    return signs, (top * 2 + positive).astype(np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


@contextmanager
def _short_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Arrow batches of ``rows`` for what is computed within: rows of vectors are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def index(vectors: DataFrame, symbols: int) -> DataFrame:
    """Rows of _SCHEMA with ``symbols`` codes, one for each row of ``vectors`` (id, embedder, embedding) that can be compared.

    Null, empty, all-zero and non-finite embeddings and such with null entries are left out; a null embedder is one of
    its own. (h1, h2) hashes the vector without its scale: equal for equal vectors and copies scaled by powers of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in [batch.slice(k, 2048) for k in range(0, batch.num_rows, 2048)]:
                lists = part.column(2)
                sizes = np.asarray(pa.compute.list_value_length(lists).fill_null(0))
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                for dim in np.unique(sizes[sizes > 0]).tolist():
                    rows = np.flatnonzero(sizes == dim)
                    values = flat[(starts[rows][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                    peak = np.abs(values).max(1)
                    good = np.isfinite(values).all(1) & (peak > 0)
                    rows, values = rows[good], values[good]
                    if not len(rows):
                        continue
                    values = np.ldexp(values, -np.frexp(peak[good])[1][:, None])  # exact, and no square overflows
                    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
                    digests = [xxhash.xxh128_digest(v) for v in values + np.float32(0)]
                    h1, h2 = (np.frombuffer(b"".join(d[k : k + 8] for d in digests), np.int64) for k in (0, 8))
                    signs, codes = describe(unit, symbols)
                    keep = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([part.column(1).take(keep), pa.array(np.full(len(rows), dim, np.int32)), pa.array(h1), pa.array(h2), part.column(0).take(keep), _binary(signs), _binary(codes)], names=["embedder", "dim", "h1", "h2", "id", "sketch", "codes"])

    return vectors.where(F.col("id").isNotNull()).select("id", F.coalesce("embedder", F.lit("")).alias("embedder"), "embedding").mapInArrow(run, _SCHEMA)


def near_in_order(cells: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in one cell whose sketches are near; ``cells`` names the cell of each, equal ones in a row."""
    n = len(cells)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    start = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1])
    size = np.diff(np.concatenate([start, [n]]))
    after = np.repeat(start + size, size) - np.arange(n) - 1  # how many of its cell follow each row
    at, k = np.flatnonzero(after > 0), 1
    while len(at):
        for block in range(0, len(at), 1 << 18):
            left = at[block : block + (1 << 18)]
            apart = np.bitwise_count(sketches[left] ^ sketches[left + k]).sum(1, dtype=np.int32)
            left = left[apart <= APART]
            found.append((left, left + k))
        k += 1
        at = at[after[at] >= k]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def nearest_in_tile(data: np.ndarray, count: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions: each row of ``data`` with its ``count`` most similar rows of cosine ``least`` or more."""
    data = data / np.abs(data).max(1, keepdims=True)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    n, found = len(unit), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for first in range(0, n, BLOCK):
        scores = unit[first : first + BLOCK] @ unit.T
        scores[np.arange(len(scores)), first + np.arange(len(scores))] = -2
        top = np.argpartition(scores, n - count, axis=1)[:, n - count :] if n > count else np.tile(np.arange(n), (len(scores), 1))
        row, k = np.nonzero(np.take_along_axis(scores, top, 1) >= least - 1e-5)  # single precision; cosines() is exact
        found.append((first + row, top[row, k]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _by_cell(rows: DataFrame, cell: list[str], value: str, near: Callable[[np.ndarray, np.ndarray, pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows (a, b), a < b, of ``near`` over whole cells of ``rows`` (*cell, key, value): positions of pairs by cell numbers and values.

    One number of 64 bits stands for a cell, by which rows are shuffled and sorted: with the 10 ** 8 cells of 25
    million vectors, two share one with a chance of 0.0003. A task holds one cell, or as many small ones as fit.
    """
    placed = rows.select(F.xxhash64(*cell).alias("cell"), "key", value).repartition("cell").sortWithinPartitions("cell", "key")

    def pairs(table: pa.Table) -> pa.RecordBatch:
        keys = table.column("key").to_numpy()
        left, right = near(table.column("cell").to_numpy(), keys, table)
        a, b = np.minimum(keys[left], keys[right]), np.maximum(keys[left], keys[right])
        both = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 2 * STRIPE:
                table = pa.Table.from_batches(held)
                cells = table.column("cell").to_numpy()
                last = int(np.flatnonzero(cells == cells[-1])[0])
                if last:
                    yield pairs(table.slice(0, last))
                rest = table.slice(last)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield pairs(pa.Table.from_batches(held))

    return placed.mapInArrow(run, "a bigint, b bigint")


def candidate_pairs(classes: DataFrame, vectors: DataFrame, trees: int, depth: int, neighbours: int = NEIGHBOURS, least: float = LEAST_COSINE) -> DataFrame:
    """Rows (a, b), a < b: keys of representatives that may be near in a cell of a tree; each pair once."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    strings = classes.select("embedder", "dim", "key", "sketch", "codes", numbers).select("embedder", "dim", "tree", "key", "sketch", F.expr(f"substring(codes, tree * {depth} + 1, {depth})").alias("cell"))
    site = ["embedder", "dim", "tree", "cell"]
    crowded = maybe_broadcast(materialize(strings.groupBy(*site).agg(F.count("*").alias("n")).where(F.col("n") > CELL)))

    def by_sketch(cells: np.ndarray, keys: np.ndarray, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return near_in_order(cells, np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64))

    if crowded.isEmpty():
        return _by_cell(strings, site, "sketch", by_sketch).distinct()

    def by_vector(cells: np.ndarray, keys: np.ndarray, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        start = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]]).tolist()
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for first, end in zip(start, start[1:], strict=False):
            data = pa.concat_arrays([c.flatten() for c in table.column("embedding").slice(first, end - first).chunks])
            # Twice the neighbours: room for equal cosines, which single precision cannot order.
            left, right = nearest_in_tile(data.to_numpy().reshape(end - first, -1), 2 * neighbours, least)
            found.append((first + left, first + right))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    # Every pair of stripes of a crowded cell is one task's work, with the vectors.
    stripes = F.ceil(F.col("n") / STRIPE).cast("int")
    stripe = F.pmod("key", stripes).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), stripes - 1), lambda k: F.least(k, stripe) * 100_000 + F.greatest(k, stripe))
    hot = strings.join(crowded, site).select(*site, "key", F.explode(tiles).alias("tile"))
    own = vectors.select(F.xxhash64("id").alias("key"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<float>").alias("embedding"))
    own = own.join(hot.select("key", "dim").distinct(), ["key", "dim"], "left_semi").dropDuplicates(["key", "dim"])
    cold = _by_cell(strings.join(crowded, site, "left_anti"), site, "sketch", by_sketch)
    return cold.unionByName(_by_cell(hot.join(own, ["key", "dim"]), [*site, "tile"], "embedding", by_vector)).distinct()


def cosines(pairs: DataFrame, vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Rows (id_a, id_b, cosine) of ``pairs`` (a, b) whose vectors' cosine is at least ``least``, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column(2)))
            same = np.flatnonzero(sizes == np.asarray(pa.compute.list_value_length(batch.column(3))))
            for dim in np.unique(sizes[same]).tolist():
                rows = pa.array(same[sizes[same] == dim])
                x, y = (batch.column(k).take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) for k in (2, 3))
                value = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                good = np.flatnonzero(value >= least)
                keep = rows.take(pa.array(good))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(value[good])], names=["id_a", "id_b", "cosine"])

    found = vectors.where(F.col("id").isNotNull() & F.col("embedding").isNotNull()).select(F.xxhash64("id").alias("key"), "id", "embedding")
    left = found.select(F.col("key").alias("a"), F.col("id").alias("id_a"), F.col("embedding").alias("x"))
    right = found.select(F.col("key").alias("b"), F.col("id").alias("id_b"), F.col("embedding").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("id_a", "id_b", "x", "y")
    return met.mapInArrow(run, "id_a string, id_b string, cosine double").dropDuplicates(["id_a", "id_b"])


def similar(vectors: DataFrame, neighbours: int = NEIGHBOURS, least: float = LEAST_COSINE) -> DataFrame:
    """Rows (chunk_id_a, chunk_id_b): pairs of ids of which one is among the other's ``neighbours`` most similar.

    ``vectors`` has (id, embedder, embedding); vectors of different embedders or widths are never compared; repeated
    deliveries count once; of equal similarities the smaller id comes first. A class of equal vectors lists only its
    first ids, which are the most similar of all its members, so a class of n vectors gives about n * neighbours rows.
    """
    trees, depth = forest(vectors.where(F.col("embedding").isNotNull()).count())
    with _short_batches(vectors.sparkSession):
        known = materialize(index(vectors, trees * depth).withColumn("key", F.xxhash64("id")))
    which = ["embedder", "dim", "h1", "h2"]
    classes = materialize(known.groupBy(*which).agg(F.min_by(F.struct("id", "key", "sketch", "codes"), "id").alias("r"), F.max("id").alias("last")).select(*which, "r.*", "last"))
    pairs = materialize(candidate_pairs(classes, vectors, trees, depth, neighbours, least))
    with _short_batches(vectors.sparkSession):
        close = materialize(cosines(pairs, vectors, least).withColumn("cosine", F.round("cosine", PLACES)))

    several = classes.where(F.col("last") != F.col("id")).select(*which)
    members = known.join(several, which, "left_semi").select(*which, "id").distinct()
    order = Window.partitionBy(*which).orderBy("id")
    first = members.withColumn("k", F.row_number().over(order)).where(F.col("k") <= neighbours + 1).groupBy(*which).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    listed = materialize(classes.join(first, which, "left").select(*which, F.col("id").alias("rep"), F.coalesce("ids", F.array("id")).alias("ids")))
    both = close.select(F.col("id_a").alias("rep"), F.col("id_b").alias("other"), "cosine").unionByName(close.select(F.col("id_b").alias("rep"), F.col("id_a").alias("other"), "cosine"))
    others = both.join(listed.select(F.col("rep").alias("other"), F.col("ids").alias("near")), "other").select("rep", "cosine", "near")
    own = listed.where(F.size("ids") > 1).select("rep", F.lit(1.0).alias("cosine"), F.col("ids").alias("near"))
    flat = others.unionByName(own).select("rep", "cosine", F.explode("near").alias("near"))
    best = flat.withColumn("k", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "near"))).where(F.col("k") <= neighbours + 1)
    lists = best.groupBy("rep").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "near"))), lambda x: x["near"]).alias("near"))

    single = listed.where(F.size("ids") == 1).join(lists, "rep").select(F.col("rep").alias("id"), "near")
    many = members.join(listed.where(F.size("ids") > 1).join(lists, "rep").select(*which, "near"), which).select("id", "near")
    near = single.unionByName(many).select("id", F.explode(F.slice(F.filter("near", lambda x: x != F.col("id")), 1, neighbours)).alias("near"))
    return near.select(F.least("id", "near").alias("chunk_id_a"), F.greatest("id", "near").alias("chunk_id_b")).distinct()
