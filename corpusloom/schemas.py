"""Schemas of the tables, so that no read infers one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "t": T.TimestampType(), "b": T.BooleanType(), "v": T.ArrayType(T.FloatType()), "x": T.BinaryType(), "m": T.MapType(T.StringType(), T.StringType())}

#: name: columns as "name:type".
TABLES = {
    "blob": "sha256:s size_bytes:l content_type:s storage_key:s ref_count:l synced_at:t created_at:t",
    "resource": "id:s url:s url_hash:s host:s path:s kind:s content_type:s title:s http_status:i state:s priority:i next_fetch_at:t sha256:s etag:s last_modified:s size_bytes:l latest_version_id:s first_seen_at:t last_seen_at:t last_fetched_at:t last_changed_at:t first_run_id:s last_run_id:s",
    "resource_version": "id:s resource_id:s run_id:s observed_at:t change_kind:s http_status:i content_type:s size_bytes:l sha256:s etag:s last_modified:s blob_sha256:s title:s",
    "resource_text": "id:s resource_id:s sha256:s content_type:s status:s text:s char_count:l extractor:s created_at:t updated_at:t",
    "chunk": "id:s resource_id:s source_sha:s chunk_index:i text:s char_start:i char_end:i embedding:v embedder:s url:s title:s kind:s created_at:t",
    "link": "id:s from_resource_id:s to_resource_id:s to_url:s rel:s first_run_id:s last_run_id:s last_seen_at:t",
    "crawl_event": "id:s run_id:s resource_id:s url:s kind:s http_status:i message:s at:t",
    "observation": "url:s status:i content_type:s headers:m body:s fetched_at:t run_id:s",
}
SCHEMAS = {name: T.StructType([T.StructField(c.split(":")[0], _TYPES[c.split(":")[1]]) for c in columns.split()]) for name, columns in TABLES.items()}


def create_if_absent(spark: SparkSession, root: str, names: list[str] | None = None) -> None:
    """Empty tables under ``root`` where there are none yet; those that exist stay as they are."""
    for name in names or list(TABLES):
        spark.createDataFrame([], SCHEMAS[name]).write.mode("ignore").parquet(f"{root}/{name}")


def migrate(spark: SparkSession, root: str, steps: dict[str, Callable[[SparkSession, str], None]]) -> list[str]:
    """Run the ``steps`` that ``root`` has not seen, in the order of their names, each once; the names of those that ran.

    A step is noted after it ended; one that finds its work done already must leave it so.
    """
    log = f"{root}/_migrations"
    spark.createDataFrame([], "name string, applied_at timestamp").write.mode("ignore").parquet(log)
    done = {r["name"] for r in spark.read.parquet(log).collect()}
    ran = []
    for name in sorted(set(steps) - done):
        steps[name](spark, root)
        spark.sql("select current_timestamp() as applied_at").selectExpr(f"'{name}' as name", "applied_at").write.mode("append").parquet(log)
        ran.append(name)
    return ran


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")
