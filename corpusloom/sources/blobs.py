"""Content-addressed storage of bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize


def blob_key(sha: Column, extension: Column) -> Column:
    """``blobs/aa/bb/<sha><extension>``."""
    return F.concat(F.lit("blobs/"), F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), sha, F.coalesce(extension, F.lit("")))


def put_if_absent(bodies: DataFrame, path: str) -> DataFrame:
    """Append the ``bodies`` (sha256, body) that the Parquet store at ``path`` lacks; rows (sha256) of those."""
    one = bodies.dropDuplicates(["sha256"])
    held = listing(bodies.sparkSession, path)
    new = materialize(one if held is None else one.join(held, "sha256", "left_anti"))
    new.write.mode("append").parquet(path)
    return new.select("sha256")


def listing(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows (sha256) of the Parquet store at ``path``, None while it has no file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where) or not any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(where)):
        return None
    return spark.read.parquet(path).select("sha256")
