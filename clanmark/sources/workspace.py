"""Intermediate tables in the shared work folder of the cluster.

Iterative operators cut their lineage by writing a Parquet table and reading it
back.  The folder is the one named by ``spark.checkpoint.dir``, which every executor
can reach, so a lost executor costs nothing that was already written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

_local_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")  # as ``file:`` it must be a mount that all executors share
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_folders[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's part of the work folder."""
    app = spark.sparkContext.applicationId
    return f"{work_folder(spark)}/clanmark-{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the work folder and return a reader of that table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_path = path
    return stored


def release(*tables: DataFrame | None) -> None:
    """Delete materialized tables that no later plan reads (the round before this one)."""
    for table in tables:
        path = getattr(table, "_stored_path", None)
        if path is None:
            continue
        spark = table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
