"""Intermediate tables that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one on a single machine (as in tests), and an
    error on a cluster, whose machines would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-axisframe-")
    return _local[app]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files of any kind; it goes when the driver's JVM ends."""
    path = f"{shared_root(spark)}/axisframe-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends here and a lost executor costs nothing.

    The table goes with `forget`, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/axisframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete durable tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.durable_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
