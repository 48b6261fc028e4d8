"""The link graph: edges from pages, their targets, hubs, orphans and what is not discovered yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.html import raw_links
from corpusloom.functions.urls import normalize_against
from corpusloom.session import materialize


def page_links(pages: DataFrame) -> DataFrame:
    """Rows (from_resource_id, to_url): the canonical link targets of ``pages`` (id, url, html), repeated ones too."""
    raw = pages.select(F.col("id").alias("from_resource_id"), "url", F.explode(raw_links(F.col("html"))).alias("href"))
    return raw.select("from_resource_id", normalize_against(F.col("href"), F.col("url")).alias("to_url"))


def merge_links(old: DataFrame, seen: DataFrame, run_id: str) -> DataFrame:
    """The next snapshot of links (from_resource_id, to_url, first_run_id, last_run_id): one row an edge."""
    new = seen.select("from_resource_id", "to_url").distinct().withColumn("run", F.lit(run_id))
    both = old.join(new, ["from_resource_id", "to_url"], "full_outer")
    return both.select("from_resource_id", "to_url", F.coalesce("first_run_id", "run").alias("first_run_id"), F.coalesce("run", "last_run_id").alias("last_run_id"))


def resolve(links: DataFrame, resource: DataFrame) -> DataFrame:
    """``links`` with the id of the resource at their target, null where there is none: a left join on url. One already there is kept."""
    known = resource.select(F.col("url").alias("to_url"), F.col("id").alias("_found")).dropDuplicates(["to_url"])
    both = links.join(known, "to_url", "left")
    target = F.coalesce("to_resource_id", "_found") if "to_resource_id" in links.columns else F.col("_found")
    return both.withColumn("to_resource_id", target).drop("_found")


def undiscovered(links: DataFrame, resource: DataFrame, scope: Column | None = None) -> DataFrame:
    """Rows (to_url, n): targets that are no resource, and from how many pages they are linked."""
    found = links if scope is None else links.where(scope)
    return found.join(resource.select(F.col("url").alias("to_url")), "to_url", "left_anti").groupBy("to_url").agg(F.count_distinct("from_resource_id").alias("n"))


def out_degree(links: DataFrame) -> DataFrame:
    return links.groupBy("from_resource_id").agg(F.count_distinct("to_url").alias("links"))


def orphans(resolved: DataFrame, resource: DataFrame) -> DataFrame:
    """Rows (id): resources that no other page links to."""
    linked = resolved.where(F.col("to_resource_id").isNotNull() & (F.col("to_resource_id") != F.col("from_resource_id"))).select(F.col("to_resource_id").alias("id"))
    return resource.select("id").distinct().join(linked, "id", "left_anti")


def reachable(edges: DataFrame, seeds: DataFrame, levels: int | None = None) -> DataFrame:
    """Rows (url, level): breadth-first from ``seeds`` (url) over ``edges`` (from_url, to_url), level by level.

    Each level is written to the shared folder, so lineage and plans stay short; it ends at the first empty level. With
    ``levels``, it raises ValueError where there are more.
    """
    seen = materialize(seeds.select("url").distinct().withColumn("level", F.lit(0)))
    front, level = seen, 0
    while True:
        level += 1
        step = edges.join(front.select(F.col("url").alias("from_url")), "from_url").select(F.col("to_url").alias("url")).distinct()
        front = materialize(step.join(seen.select("url"), "url", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            return seen
        if levels is not None and level > levels:
            raise ValueError(f"more than {levels} levels of links")
        seen = seen.unionByName(front)
        if level % 20 == 0:
            seen = materialize(seen)
