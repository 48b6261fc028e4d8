"""Seams to outside services: which retriever and model are used, models of answers, and the items of a managed search."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.config import DEFAULT


class Model(Protocol):
    """A model of answers: ``complete`` gives its raw text for instructions and a message."""

    def complete(self, system: str, message: str) -> str: ...


class Scripted:
    """A stand-in that answers by a rule."""

    def __init__(self, rule: Callable[[str], str]) -> None:
        self.rule = rule

    def complete(self, system: str, message: str) -> str:
        return self.rule(message)


def completed(messages: DataFrame, model: Model, system: str) -> DataFrame:
    """Rows (id, raw) of ``messages`` (id, message): what the model says; a null message and an error give a null."""
    kind = dict(messages.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for message in batch["message"]:
                try:
                    out.append(model.complete(system, message) if isinstance(message, str) else None)
                except Exception:  # noqa: BLE001 - one failing call is one missing answer
                    out.append(None)
            yield pd.DataFrame({"id": batch["id"], "raw": out})

    return messages.select("id", "message").mapInPandas(run, f"id {kind}, raw string")


def provider_name(name: str | None) -> str:
    """The retriever of a setting: ``ai-search`` exactly (white space and case apart), else ``vectorize``."""
    return "ai-search" if (name or "").strip().lower() == "ai-search" else "vectorize"


def retriever(name: str | None, known: Mapping[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """The retriever of a setting among those known; KeyError if it is not there."""
    return known[provider_name(name)]


def model_name(kind: str, environment: Mapping[str, str] = os.environ, default: str = "scripted") -> str:
    """The model for answers or escalation: CORPUSLOOM_ANSWER_MODEL or CORPUSLOOM_ESCALATION_MODEL, else ``default``."""
    return environment.get(f"CORPUSLOOM_{kind.upper()}_MODEL", "").strip() or default


_ITEM = "struct<file_id:string,filename:string,id:string,score:double,text:string,content:string,attributes:map<string,string>,metadata:map<string,string>,item:struct<key:string,metadata:map<string,string>>>"
_PARTS = "array<struct<text:string>>"


def _bare(text: Column) -> Column:
    """A text without white space at its ends, no-break spaces too."""
    return F.regexp_replace(text, r"(?U)^[\s\ufeff]+|[\s\ufeff]+$", "")


def _meta(bag: Column, name: str) -> Column:
    """A value of a metadata map by its name, with or without the store's prefix, in either spelling; null if blank."""
    names = [name, f"x-amz-meta-{name}", name.replace("-", "_"), f"x-amz-meta-{name.replace('-', '_')}"]
    return F.coalesce(*[F.nullif(_bare(F.element_at(bag, n)), F.lit("")) for n in dict.fromkeys(names)])


def search_items(replies: DataFrame, k: int = DEFAULT.top_k, cap: int = DEFAULT.per_resource) -> DataFrame:
    """Rows (query_id, rank, url, title, kind, resource_id, ordinal, text, score): the passages in ``replies`` (query_id, body).

    ``body`` is JSON with the items as data or chunks, at the top or under result. Items without text or source are
    left out; of each resource the first ``cap`` are kept, then the first ``k`` of all, in the order of the reply.
    """
    paths = ["$.result.data", "$.result.chunks", "$.data", "$.chunks"]
    listed = F.coalesce(*[F.get_json_object("body", p) for p in paths])
    items = replies.select("query_id", F.posexplode(F.from_json(listed, f"array<{_ITEM}>")).alias("at", "i"))
    parts = F.from_json(F.col("i.content"), _PARTS)
    text = _bare(F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(F.coalesce("i.content", "i.text", F.lit(""))))
    empty = F.create_map().cast("map<string,string>")
    bags = [F.coalesce(b, empty) for b in ("i.attributes", "i.metadata", "i.item.metadata")]

    def meta(name: str) -> Column:
        return F.coalesce(*[_meta(bag, name) for bag in bags])

    key = F.coalesce("i.file_id", "i.filename", "i.id", "i.item.key")
    rows = items.select("query_id", "at", text.alias("text"), F.coalesce("i.score", F.lit(0.0)).alias("score"), F.coalesce(meta("source-url"), meta("url"), key).alias("url"), key.alias("key"), meta("title").alias("title"), F.coalesce(meta("kind"), F.lit("page")).alias("kind"))
    rows = rows.where((F.col("text") != "") & (F.coalesce("url", F.lit("")) != "")).withColumn("resource_id", F.coalesce(F.nullif("key", F.lit("")), "url"))
    capped = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id", "resource_id").orderBy("at")) - 1).where(F.col("ordinal") < cap)
    ranked = capped.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "url", "title", "kind", "resource_id", "ordinal", "text", "score")
