"""Intermediate tables in the folder that all executors share: they cut lineage and have known sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder of its machine;
    any other session is refused, since its executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/tesserae-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this driver has written so far, once nothing reads them any more; returns how many."""
    jvm, n = spark._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again.

    The lineage ends there, lost executors lose nothing of it, and the planner
    knows its size, so that it broadcasts it below
    spark.sql.autoBroadcastJoinThreshold and shuffles it above.
    """
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
