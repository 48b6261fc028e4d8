"""Lines repeated across one site's documents (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.pages import line_hashes
from corpusloom.session import materialize, maybe_broadcast

LEAST_DOCUMENTS, LEAST_SHARE = 3, 0.05


def hashed(documents: DataFrame) -> DataFrame:
    """Rows (resource_id, host, t, u, day, lines), one per resource of ``documents`` (resource_id, host, text, day), written to the shared folder.

    (t, u) is a digest of the text and ``lines`` are the 64-bit hashes of the forms of its lines in order, null for a
    blank one. The texts are taken apart once; repeated deliveries are dropped from these narrow rows.
    """
    rows = documents.select("resource_id", "host", F.xxhash64("text").alias("t"), F.hash("text").alias("u"), "day", line_hashes(F.col("text")).alias("lines"))
    return materialize(rows.dropDuplicates(["resource_id"]))


def repeated_lines(found: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE, unit: str = "documents", days: int = 1) -> DataFrame:
    """Rows (host, line, documents, clusters, days): lines repeated on a host; ``line`` is the hash of the line's form.

    ``found`` has the columns of :func:`hashed`. Documents of equal text are collapsed into one cluster per host
    first: its lines are counted once, with the number of its documents as weight. So a line's documents are counted
    exactly, and beside them its clusters and publication days (the least day of each cluster). ``unit`` says which of
    these counts must reach ``least`` and ``share`` of the host's, and ``days`` on how many days it must have been
    published: with "clusters" and two days, lines of one article that was published again and again are not repeated.
    Counts are combined before every shuffle, so a host or text that holds most rows is no hot spot. No rows: no rows.
    """
    if unit not in ("documents", "clusters"):
        raise ValueError(unit)
    clusters = materialize(found.groupBy("host", "t", "u").agg(F.count("*").alias("documents"), F.min("day").alias("day"), F.first("lines").alias("lines")))
    hosts = materialize(clusters.groupBy("host").agg(F.sum("documents").alias("all_documents"), F.count("*").alias("all_clusters")))
    lines = clusters.select("host", "day", "documents", F.explode(F.array_compact(F.array_distinct("lines"))).alias("line"))
    by_day = lines.groupBy("host", "line", "day").agg(F.sum("documents").alias("documents"), F.count("*").alias("clusters"))
    counted = by_day.groupBy("host", "line").agg(F.sum("documents").alias("documents"), F.sum("clusters").alias("clusters"), F.count("day").alias("days"))
    kept = counted.where((F.col(unit) >= least) & ((F.col("days") >= days) | F.lit(days <= 1))).join(maybe_broadcast(hosts), "host")
    return materialize(kept.where(F.col(unit) >= share * F.col(f"all_{unit}") - 1e-9).select("host", "line", "documents", "clusters", "days"))


def occurrences(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows (resource_id, line_no): every occurrence of a repeated line (host, line) in ``found``.

    Lines and repeated lines meet as rows: broadcast while these are few, else by a shuffle in which adaptive
    execution splits a line that most documents have.
    """
    places = found.select("resource_id", "host", F.posexplode("lines").alias("line_no", "line")).where(F.col("line").isNotNull())
    return places.join(maybe_broadcast(repeated.select("host", "line")), ["host", "line"], "left_semi").select("resource_id", "line_no")


def without_repeated(documents: DataFrame, found: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows (resource_id, text): each document without the lines repeated on its host; all documents come out."""
    gone = occurrences(found, repeated).groupBy("resource_id").agg(F.collect_list("line_no").alias("gone"))
    texts = documents.select("resource_id", "text").dropDuplicates(["resource_id"]).join(gone, "resource_id", "left")
    kept: Column = F.filter(F.split("text", "\n", -1), lambda x, n: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), n))
    return texts.select("resource_id", F.array_join(kept, "\n").alias("text"))
