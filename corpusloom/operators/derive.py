"""Derivation: stored bodies to texts, texts to chunks with embeddings, and what each job has to do."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.functions import chunking, html, text
from corpusloom.functions.vectors import hash_embedding
from corpusloom.operators import frontier, manifest

EXTRACTED = "text string, extractor string, status string"


class Embedder(Protocol):
    """A model of embeddings: ``embed`` gives one vector of ``dimensions`` numbers a text."""

    id: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """The deterministic stand-in: signed token counts by hash."""

    def __init__(self, dimensions: int = DEFAULT.embed_width) -> None:
        self.id, self.dimensions = f"hash-{dimensions}", dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [hash_embedding(t, self.dimensions).tolist() for t in texts]


def checked(model: Embedder, texts: list[str], batch: int = DEFAULT.embed_batch) -> list[list[float]]:
    """The vectors of ``texts``, asked for in batches. ValueError if the model gives another number or width."""
    out: list[list[float]] = []
    for at in range(0, len(texts), batch):
        part = texts[at : at + batch]
        found = model.embed(part)
        if len(found) != len(part) or any(len(v) != model.dimensions for v in found):
            raise ValueError(f"{model.id}: {len(part)} texts gave {len(found)} vectors, or a width is not {model.dimensions}")
        out += found
    return out


def due_bodies(resource: DataFrame, blob: DataFrame, texts: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (resource_id, sha256, content_type, storage_key) to extract: the bodies, held as blobs, of which no text was made.

    ``most`` takes the first so many by id, for a bounded run.
    """
    due = frontier.needs_extract(resource, texts).select(F.col("id").alias("resource_id"), F.col("sha").alias("sha256"))
    rows = due.join(blob.select(F.lower("sha256").alias("sha256"), "content_type", "storage_key").dropDuplicates(["sha256"]), "sha256")
    rows = rows.select("resource_id", "sha256", "content_type", "storage_key")
    return rows if most is None else rows.orderBy("resource_id").limit(most)


def extract(bodies: DataFrame, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """``bodies`` (resource_id, sha256, content_type, body binary) as rows (resource_id, sha256, content_type, text, extractor, status).

    HTML and XML go to the main-content rule, PDF to ``pdf`` (a function of bytes; without it they are unsupported). A
    PDF without words is ``scanned``, any other text without words ``empty``; text is null unless ok. A body that
    cannot be read (null, or an error of ``pdf``) gives no row, so that it is due again.
    """
    routed = bodies.where(F.col("body").isNotNull()).withColumn("route", html.text_route(html.content_type(F.coalesce("content_type", F.lit("")))))
    names = ["resource_id", "sha256", "content_type"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, sha, kind, body, route in zip(*(batch[c] for c in (*names, "body", "route")), strict=True):
                name = None
                try:
                    if route == "html":
                        found, name = html.html_text(bytes(body).decode("utf-8", "replace"))
                    elif route == "pdf" and pdf is not None:
                        found, name = text.clean_python(pdf(bytes(body)) or ""), "pdf"
                    else:
                        rows.append((key, sha, kind, None, None, "unsupported"))
                        continue
                except Exception:  # noqa: BLE001 - one unreadable body must not end the job; it stays due
                    continue
                words = any(c.isalnum() for c in found)
                rows.append((key, sha, kind, found if words else None, name, "ok" if words else "scanned" if route == "pdf" else "empty"))
            yield pd.DataFrame(rows, columns=[*names, "text", "extractor", "status"])

    return routed.select(*names, "body", "route").mapInPandas(run, f"resource_id string, sha256 string, content_type string, {EXTRACTED}")


def upsert_texts(old: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """The next snapshot of texts, one a resource: ``new`` replaces content and status, ids and times of creation stay."""
    n = new.dropDuplicates(["resource_id"]).select("resource_id", *[F.col(c).alias(f"n_{c}") for c in ("sha256", "content_type", "text", "extractor", "status")])
    both = old.dropDuplicates(["resource_id"]).join(n, "resource_id", "full_outer")
    hit = F.col("n_status").isNotNull()

    def new_or(c: str):
        return F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)

    length = F.coalesce(F.char_length("n_text"), F.lit(0)).cast("bigint")
    return both.select(
        F.coalesce("id", F.sha2(F.concat_ws("|", F.lit("text"), "resource_id"), 256)).alias("id"), "resource_id", new_or("sha256"), new_or("content_type"), new_or("status"), new_or("text"), F.when(hit, length).otherwise(F.col("char_count")).alias("char_count"), new_or("extractor"),
        F.coalesce("created_at", F.lit(as_of)).alias("created_at"), F.when(hit, F.lit(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def chunked(texts: DataFrame, floor: float = DEFAULT.boilerplate_floor) -> DataFrame:
    """Rows (resource_id, source_sha, chunk_index, text, char_start, char_end) of ``texts`` (resource_id, sha256, text).

    Chunks with too few function words are dropped; the others keep their index, so indexes may have gaps.
    """
    keyed = texts.select(F.to_json(F.struct("resource_id", F.lower("sha256").alias("source_sha"))).alias("of"), "text")
    pieces = chunking.chunk_table(keyed, "of", "text").select(F.from_json("key", "resource_id string, source_sha string").alias("of"), F.col("piece_index").alias("chunk_index"), F.col("piece").alias("text"), "char_start", "char_end")
    rated = pieces.withColumn("ratio", text.stopword_ratio(F.col("text"))) if floor > 0 else pieces.withColumn("ratio", F.lit(1.0))
    return rated.where(F.col("ratio") >= floor).select("of.resource_id", "of.source_sha", "chunk_index", "text", "char_start", "char_end")


def embedded(chunks: DataFrame, model: Embedder, batch: int = DEFAULT.embed_batch) -> DataFrame:
    """``chunks`` with the columns embedding and embedder; the model is sent to the workers once a task."""
    schema = chunks.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.assign(embedding=[np.asarray(v, np.float32) for v in checked(model, part["text"].fillna("").tolist(), batch)], embedder=model.id)

    return chunks.mapInPandas(run, f"{schema}, embedding:array<float>, embedder:string")


def embed_job(texts: DataFrame, resource: DataFrame, chunk: DataFrame, model: Embedder, as_of: datetime, floor: float = DEFAULT.boilerplate_floor) -> DataFrame:
    """The next snapshot of ``chunk``: new chunks of ok texts that have none of their content, none for texts no longer ok."""
    stale = frontier.needs_embed(texts, chunk)
    due = texts.dropDuplicates(["resource_id"]).join(stale.select("resource_id"), "resource_id", "left_semi")
    made = embedded(chunked(due.select("resource_id", "sha256", "text"), floor), model)
    named = made.join(resource.select(F.col("id").alias("resource_id"), "url", "title", "kind").dropDuplicates(["resource_id"]), "resource_id")
    fresh = named.withColumns({"id": F.sha2(F.concat_ws("|", "resource_id", "source_sha", "chunk_index"), 256), "created_at": F.lit(as_of)})
    gone = stale.select("resource_id").unionByName(frontier.needs_clear(texts, chunk).select("resource_id"))
    return manifest.replace_groups(chunk.dropDuplicates(["id"]), fresh.select(*chunk.columns), gone, "resource_id").select(*chunk.columns)


def stats(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(F.col(column).alias("outcome")).agg(F.count("*").alias("n"))
