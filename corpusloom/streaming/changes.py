"""Structured Streaming: the change log by micro-batches, run health, windowed counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.schemas import SCHEMAS


def stream_table(spark: SparkSession, path: str, name: str, files: int = DEFAULT.tick_files) -> DataFrame:
    """A table as a stream, ``files`` files a micro-batch; ``path`` is a folder of files or one file."""
    reader = spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", files)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


#: Partitions of the log of contents by their key.
LOG_PARTS = 16
_LOG = "resource_id string, sha256 string, observed_at timestamp, id string, part int"


def append_changes(stream: DataFrame, log: str, checkpoint: str) -> None:
    """Append to ``log`` the first observation of each (resource, content) of ``stream``, in bounded batches, and end.

    An observation is added unless the log has that content at the same time or earlier, so one that comes late but was
    made earlier is added too, and :func:`first_seen` reads the earliest. A batch that runs again finds its rows in
    the log and adds nothing: the sink is idempotent without a transaction. The log is partitioned by key, and a batch
    reads only the partitions of its keys.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col("sha256").isNotNull()).select("resource_id", F.lower("sha256").alias("sha256"), "observed_at", "id")
        first = rows.groupBy("resource_id", "sha256").agg(F.min(F.struct("observed_at", "id")).alias("r")).select("resource_id", "sha256", "r.*")
        first = first.withColumn("part", F.pmod(F.xxhash64("resource_id", "sha256"), F.lit(LOG_PARTS)).cast("int")).persist()
        parts = [r[0] for r in first.select("part").distinct().collect()]  # at most LOG_PARTS
        have = spark.read.schema(_LOG).parquet(log).where(F.col("part").isin(*parts)).select("resource_id", "sha256", F.col("observed_at").alias("had_at")) if parts else None
        if have is not None:
            known = [first["resource_id"] == have["resource_id"], first["sha256"] == have["sha256"], have["had_at"] <= first["observed_at"]]
            first.join(have, known, "left_anti").repartition("part").write.mode("append").partitionBy("part").parquet(log)
        first.unpersist()

    spark.createDataFrame([], _LOG).write.mode("ignore").partitionBy("part").parquet(log)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_seen(spark: SparkSession, log: str) -> DataFrame:
    """Rows (resource_id, sha256, observed_at, id): the earliest observation of each content in ``log``."""
    rows = spark.read.schema(_LOG).parquet(log)
    return rows.groupBy("resource_id", "sha256").agg(F.min(F.struct("observed_at", "id")).alias("r")).select("resource_id", "sha256", "r.*")


def stale_runs(runs: DataFrame, as_of: datetime, minutes: int = DEFAULT.stale_minutes) -> DataFrame:
    """Rows (id, silent_ms): running runs without a sign of life for ``minutes``; for a stream or a table."""
    quiet = F.unix_millis(F.lit(as_of)) - F.unix_millis("heartbeat_at")
    return runs.where((F.col("status") == "running") & (quiet > minutes * 60_000)).select("id", quiet.alias("silent_ms"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Event counts and sums per window and type with a watermark (an addition; for a stream or a table)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n", F.round("value", 4).alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by ``gap`` without events (an addition; for a stream or a table)."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")


def progress(stream: DataFrame, tell, checkpoint: str, seconds: float = 1.5):
    """Start a query that calls ``tell(batch, number)`` every ``seconds``; ``stop()`` of what it returns ends it."""
    return stream.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
