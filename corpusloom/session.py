"""Session helpers: shared checkpoint folder, durable intermediate tables, size-checked broadcast."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is absent on a one-machine session (tests) is a temporary folder made and set;
    a cluster session without the setting is an error, as a machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``, once an application: a zip in the shared folder."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    _SHIPPED.add(application)
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    target = f"{shared_dir(spark)}/corpusloom/{uuid.uuid4().hex}/corpusloom.zip"
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = files.create(where, True)
    stream.write(bytearray(held.getvalue()))
    stream.close()
    files.deleteOnExit(where)
    spark.sparkContext.addPyFile(target)


_MADE: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables written so far, for a long-lived session between jobs; how many there were.

    Results that still read them must have been written before.
    """
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage with a copy that survives lost executors, and keeps column pruning and filter pushdown for its
    readers. The JVM removes the folder when it ends, :func:`release` before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def _width(df: DataFrame):
    """The approximate bytes of a row: strings by their length, arrays by eight bytes an entry (strings in them by theirs)."""
    parts = [F.lit(0).cast("bigint")]
    for field in df.schema:
        kind, c = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, T.StringType | T.BinaryType):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            parts.append(F.coalesce(F.octet_length(F.array_join(c, "")), F.lit(0)) + 8 * F.greatest(F.size(c), F.lit(0)))
        elif isinstance(kind, T.ArrayType | T.MapType):
            parts.append(8 * F.greatest(F.size(c), F.lit(0)))
        else:
            parts.append(F.lit(8))
    return sum(parts[1:], parts[0])


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only if ``df`` (already materialised) has at most ``rows`` rows and ``size`` bytes.

    Beyond that the caller's join shuffles, and adaptive execution splits skewed keys.
    """
    n, width = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and width <= size else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, in as many partitions as there are cores, where its files give fewer: for costly work on a few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the test tables as a DataFrame."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
