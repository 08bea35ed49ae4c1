"""Tables in the folder that executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder of a local session. A cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """Written to the shared folder and read again; gone when :func:`drop` says so, or when the application ends."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, store = _place(spark, path)
    store.deleteOnExit(place)
    found = spark.read.schema(df.schema).parquet(path)
    found.shared_at = path
    return found


def drop(*tables: DataFrame) -> None:
    """Delete shared tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "shared_at", None):
            place, store = _place(table.sparkSession, path)
            store.delete(place, True)
            table.shared_at = None
