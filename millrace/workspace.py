"""Where intermediate tables go.

Executors on other machines must be able to read what a job writes, so the folder comes from the
session: `spark.checkpoint.dir`, or what `SparkContext.setCheckpointDir` was given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used by bench, tests and entry on local[*], where driver and executors share one disk.
LOCAL_ROOT = "/tmp/checkpoints/millrace"


def _configured(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_root(spark: SparkSession) -> str:
    root = _configured(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return root.rstrip("/")


def use_local_root(spark: SparkSession) -> None:
    """Sets a folder where none is set and everything runs in one process."""
    if not _configured(spark) and spark.sparkContext.master.startswith("local["):
        spark.sparkContext.setCheckpointDir(LOCAL_ROOT)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the shared root."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once to the shared root and read back.

    For results with several readers: they read files instead of repeating the work, and the
    files outlive the executors that wrote them.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes what `stored` wrote, after the last job that reads it has ended."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
