"""Retrieval: exact vector search in tiles, postings and BM25, rank fusion, sources and context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.config import DEFAULT
from corpusloom.functions.text import tokens
from corpusloom.session import materialize, maybe_broadcast

#: Queries and vectors of a tile, and rows of it that are scored at once.
QUERY_BLOCK, VECTOR_STRIPE, SCORED = 4096, 200_000, 2048


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one width as unit vectors; rows of zeros stay zero."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = pa.concat_arrays([c.flatten() for c in chunks]).to_numpy(zero_copy_only=False).astype(np.float64)
    data = flat.reshape(len(column), -1)
    return data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-300)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK, stripe: int = VECTOR_STRIPE) -> DataFrame:
    """Rows (query_id, id, score, rank): the ``k`` vectors of greatest cosine for each query, ties by id.

    ``vectors`` has (id, embedding), ``queries`` (query_id, embedding); vectors of another width than the query's are
    not compared, null and zero vectors have no score. Blocks of queries meet stripes of vectors in tiles, one task's
    work each; with one block the vectors are not copied. A tile keeps ``k`` rows a query, and one window over those
    finishes. Exact: no bucket or candidate is left out.
    """
    kinds = {c: dict(d.dtypes)[c] for d, c in ((vectors, "id"), (queries, "query_id"))}
    number = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))

    def usable(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("embedding").isNotNull() & (number > 0)).select(F.col(name).alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.size("embedding").alias("dim"))

    left, right = usable(queries, "query_id"), usable(vectors, "id")
    blocks, stripes = (max(1, -(-side.count() // width)) for side, width in ((left, block), (right, stripe)))
    part = [F.pmod(F.xxhash64("id"), F.lit(n)).cast("int") for n in (blocks, stripes)]
    asked = left.select("dim", part[0].alias("block"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.col("id").alias("query_id"), F.lit(None).cast(kinds["id"]).alias("id"), "embedding")
    held = right.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part[1].alias("stripe"), F.lit(None).cast(kinds["query_id"]).alias("query_id"), "id", "embedding")
    tile = ["dim", "block", "stripe"]
    rows = asked.unionByName(held).withColumn("late", F.col("query_id").isNull()).repartition(blocks * stripes, *tile).sortWithinPartitions(*tile, "late")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, names, wanted, best = None, [], [], None

        def found() -> Iterator[pa.RecordBatch]:
            if best is not None:
                score, at, ids = best
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(names).take(pa.array(np.repeat(np.arange(len(score)), score.shape[1]))), ids.take(pa.array(at.ravel())), pa.array(score.ravel())], names=["query_id", "id", "score"])

        for whole in batches:
            marks = np.stack([np.asarray(whole.column(n)) for n in tile] + [np.asarray(whole.column("late")).astype(np.int32)], 1)
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
            for first, end in zip(edges, edges[1:], strict=False):
                for start in range(first, end, SCORED):
                    batch = whole.slice(start, min(SCORED, end - start))
                    if tuple(marks[first, :3]) != here:
                        yield from found()
                        here, names, wanted, best = tuple(marks[first, :3]), [], [], None
                    if not marks[first, 3]:
                        names.append(batch.column("query_id"))
                        wanted.append(_matrix(batch.column("embedding")))
                    elif wanted:
                        best = merged(np.concatenate(wanted), batch, best)
        yield from found()

    def merged(wanted: np.ndarray, batch: pa.RecordBatch, best):
        """(scores, positions, ids) of the ``k`` best of ``best`` and ``batch`` for each query; ids are kept in order."""
        score = np.round(wanted @ _matrix(batch.column("embedding")).T, 6)
        ids = batch.column("id")
        at = np.broadcast_to(np.arange(len(ids)), score.shape)
        if best is not None:
            score, at, ids = np.concatenate([best[0], score], 1), np.concatenate([best[1], at + len(best[2])], 1), pa.concat_arrays([best[2], ids])
        order = np.asarray(pa.compute.rank(ids, sort_keys="ascending", tiebreaker="first")).astype(np.int64)
        top = np.stack([np.lexsort((order[p], -s))[:k] for p, s in zip(at, score, strict=True)])
        score, at = np.take_along_axis(score, top, 1), np.take_along_axis(at, top, 1)
        used, at = np.unique(at, return_inverse=True)
        return score, at.reshape(score.shape), ids.take(pa.array(used))

    out = rows.select(*tile, "late", "query_id", "id", "embedding").mapInArrow(tiles, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def chunk_search(chunk: DataFrame, resource: DataFrame, queries: DataFrame, k: int = DEFAULT.top_k, cap: int = DEFAULT.per_resource, over: int = DEFAULT.over_fetch) -> DataFrame:
    """Rows (query_id, id, resource_id, url, title, score, rank, ordinal): the passages of live resources for each query.

    ``chunk`` and ``queries`` (query_id, embedder, embedding) meet by embedder. ``k * over`` candidates are taken, then
    those of resources that are gone or in error are left out, at most ``cap`` of a resource kept, and the first ``k``
    ranked anew; so fewer than ``k`` may be left. ``ordinal`` counts the passages of a resource from 0.
    """
    one = chunk.where(F.col("id").isNotNull()).dropDuplicates(["id"])
    hits = None
    for name in [r[0] for r in queries.select("embedder").distinct().collect()]:  # a few embedders
        mine = F.col("embedder").eqNullSafe(F.lit(name))
        found = vector_top_k(one.where(mine).select("id", "embedding"), queries.where(mine).select("query_id", "embedding"), max(k, k * over))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = vector_top_k(one.select("id", "embedding"), queries.select("query_id", "embedding"), k)
    live = resource.where(~F.col("state").isin("gone", "error")).select(F.col("id").alias("resource_id"), F.col("url"), F.col("title")).dropDuplicates(["resource_id"])
    kept = capped(hits.join(one.select("id", "resource_id"), "id").join(live, "resource_id"), "resource_id", cap, k)
    ordinal = F.row_number().over(Window.partitionBy("query_id", "resource_id").orderBy("rank")) - 1
    return kept.select("query_id", "id", "resource_id", "url", "title", "score", "rank", ordinal.alias("ordinal"))


def capped(hits: DataFrame, group: str, cap: int = DEFAULT.per_resource, k: int = DEFAULT.top_k) -> DataFrame:
    """``hits`` with at most ``cap`` of a group, then the first ``k`` of each query, ranked anew; fewer may be left."""
    per = F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))
    kept = hits.withColumn("per", per).where(F.col("per") <= cap)
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("rank", again).where(F.col("rank") <= k).drop("per")


def postings(documents: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Rows (id, length, terms): each document with a text, and its terms as array<struct<term, tf>>.

    ``only`` (term), if it is small, limits the terms before anything is exploded; lengths are of the whole text. The
    text is taken apart once.
    """
    words = tokens(F.col("text"))
    held = documents.where(F.col("text").isNotNull()).select("id", words.alias("words"))
    kept: Column = F.col("words")
    if only is not None:
        few = [r[0] for r in only.select("term").distinct().limit(QUERY_TERMS + 1).collect()]
        if len(few) <= QUERY_TERMS:
            kept = F.filter("words", lambda w: w.isin(*few)) if few else F.array().cast("array<string>")
    counted = F.transform(F.array_distinct("kept"), lambda t: F.struct(t.alias("term"), F.size(F.filter("kept", lambda w: w == t)).alias("tf")))
    if only is not None and len(few) <= QUERY_TERMS:
        return held.select("id", F.size("words").alias("length"), kept.alias("kept")).select("id", "length", counted.alias("terms"))
    spread = held.select("id", F.explode("words").alias("term")).groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"))
    terms = spread.groupBy("id").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    return held.select("id", F.size("words").alias("length")).join(terms, "id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<term:string,tf:int>>")))


#: Distinct terms of the queries up to which they are a filter on the words; beyond it postings are joined to them.
QUERY_TERMS = 2_000


def build_index(documents: DataFrame, path: str) -> None:
    """Write the index of ``documents`` (id, text) to ``path``: postings sorted by term, and the lengths of the documents."""
    found = materialize(postings(documents))
    found.select("id", F.inline("terms")).repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    found.select("id", "length").write.mode("overwrite").parquet(f"{path}/lengths")


def _asked(queries: DataFrame) -> DataFrame:
    return materialize(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")))


def _ranked(counts: DataFrame, totals: DataFrame, asked: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """BM25 of ``counts`` (id, length, term, tf) for ``asked`` (query_id, term); ``totals`` is one row (n_docs, mean)."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    scored = counts.join(maybe_broadcast(materialize(df)), "term").crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    sums = scored.select("id", "term", weight.alias("w")).join(maybe_broadcast(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(documents: DataFrame, queries: DataFrame, k: int, k1: float = DEFAULT.bm25_k1, b: float = DEFAULT.bm25_b) -> DataFrame:
    """Rows (query_id, id, score, rank) by BM25; ``documents`` has (id, text), ``queries`` (query_id, text).

    Without an index: one pass over the texts keeps their lengths and the queries' terms. Lengths and document
    frequencies are over all documents. A document without any term of a query has no row.
    """
    asked = _asked(queries)
    found = materialize(postings(documents, asked))
    totals = found.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))
    counts = found.select("id", "length", F.inline("terms")).join(maybe_broadcast(asked.select("term").distinct()), "term", "left_semi")
    return _ranked(materialize(counts), totals, asked, k, k1, b)


def bm25_from(spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float = DEFAULT.bm25_k1, b: float = DEFAULT.bm25_b) -> DataFrame:
    """As :func:`bm25`, from the index at ``path``: only the queries' postings are read, by the statistics of their files."""
    asked = _asked(queries)
    lengths, held = spark.read.parquet(f"{path}/lengths"), spark.read.parquet(f"{path}/postings")
    few = [r[0] for r in asked.select("term").distinct().limit(QUERY_TERMS + 1).collect()]
    held = held.where(F.col("term").isin(*few)) if len(few) <= QUERY_TERMS else held.join(asked.select("term").distinct(), "term", "left_semi")
    return _ranked(materialize(held.join(lengths, "id")), lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean")), asked, k, k1, b)


def hybrid(lexical: DataFrame, cosine: DataFrame, rows: DataFrame, k: int = DEFAULT.top_k) -> DataFrame:
    """``rows`` (id, ...) of the first ``k`` of two fused lists (query_id, id, rank), with their score and rank."""
    return fuse([lexical, cosine], k).join(rows, "id")


#: A way to search: rows (query_id, text) to passages (query_id, id, url, title, text, score, rank).
Retriever = Callable[[DataFrame], DataFrame]


def fuse(lists: list[DataFrame], k: int, constant: int = DEFAULT.rank_constant) -> DataFrame:
    """Rows (query_id, id, score, rank) by reciprocal rank fusion; ranks of the lists count from 0 in the sum."""
    parts = [x.select("query_id", "id", (1.0 / (constant + F.col("rank") - 1)).alias("s")) for x in lists]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    sums = both.groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k)


def numbered_sources(passages: DataFrame) -> DataFrame:
    """``passages`` (query_id, rank, url, ...) with the number of their source: sources count by first appearance."""
    first = passages.groupBy("query_id", "url").agg(F.min("rank").alias("first"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return passages.join(first.withColumn("source", number).drop("first"), ["query_id", "url"])


def contexts(passages: DataFrame) -> DataFrame:
    """Rows (query_id, context): numbered passages with a list of sources, for a model to read.

    ``passages`` has (query_id, rank, source, text, title, url), a few a query.
    """
    line = F.concat(F.lit("["), F.col("source").cast("string"), F.lit("] "), F.col("text"))
    name = F.concat(F.lit("["), F.col("source").cast("string"), F.lit("] "), F.coalesce("title", "url"))
    out = passages.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("x")))).alias("p"), F.sort_array(F.collect_set(F.struct("source", name.alias("x")))).alias("s"))
    joined = F.array_join(F.transform("p", lambda r: r["x"]), "\n\n")
    return out.select("query_id", F.concat(joined, F.lit("\n\nSources:\n"), F.array_join(F.transform("s", lambda r: r["x"]), "\n")).alias("context"))
