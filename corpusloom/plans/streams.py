"""Streaming queries, run to their end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.session import shared_dir
from corpusloom.streaming import changes


def stream_change_log(spark, folder):
    """The contents of each resource at their first sight, appended from a stream of observations batch by batch."""
    base = f"{shared_dir(spark)}/corpusloom/{uuid.uuid4().hex}"
    # Several files in no order of time, so that batches bring earlier observations late.
    spark.read.parquet(f"{folder}/resource_version.parquet").repartition(6, F.xxhash64("id")).write.parquet(f"{base}/in")
    changes.append_changes(changes.stream_table(spark, f"{base}/in", "resource_version", 2), f"{base}/log", f"{base}/state")
    return changes.first_seen(spark, f"{base}/log").select("resource_id", "sha256", F.unix_millis("observed_at").alias("observed_ms"))


def queries():
    return {"stream_change_log": stream_change_log}


def oracle_sql():
    return {"stream_change_log": "select resource_id, lower(sha256) as sha256, epoch_ms(min(observed_at)) as observed_ms from resource_version where sha256 is not null group by 1, 2"}
