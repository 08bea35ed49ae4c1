"""Moving rows between stores: insert-if-absent, keep-first dedup, snapshots, the pause flag, reset, spill and its recovery."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.windows import first_writer


def new_rows(rows: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't stored, one of each key. Rows stored before are never changed."""
    return rows.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def new_captures(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Captured rows to append: the first of each (source, ingest_key) not stored; rows without a key always."""
    first = first_writer(batch, ["source", "ingest_key"], ["ts", "id"])
    keyed = first.where("ingest_key IS NOT NULL").join(stored.where("ingest_key IS NOT NULL").select("source", "ingest_key"), ["source", "ingest_key"], "left_anti")
    return keyed.select(batch.columns).unionByName(first.where("ingest_key IS NULL"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_or(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def sync(spark: SparkSession, capture_path: str, analytics_path: str, now_ms: int) -> dict:
    """Append captured traces the analytics table lacks, with prompt_text; counts of rows scanned, inserted, known, and the lag."""
    from tracelake import schemas
    from tracelake.functions.messages import prompt_text_udf

    captured = read_or(spark, capture_path, schemas.schema("capture"))
    stored = read_or(spark, analytics_path, schemas.schema("traces"))
    fresh = new_rows(captured, stored).withColumn("prompt_text", prompt_text_udf("request_json"))
    scanned, newest = captured.agg(F.count("*"), F.max("ts")).first()
    rows = fresh.select([f.name for f in schemas.schema("traces").fields])
    before = stored.count()
    rows.write.mode("append").parquet(analytics_path)
    inserted = spark.read.schema(schemas.schema("traces")).parquet(analytics_path).count() - before
    return {"rows_scanned": scanned, "rows_inserted": inserted, "rows_deduped": scanned - inserted, "lag_seconds": max(0.0, (now_ms - newest) / 1000) if newest is not None else None}


def replace(df: DataFrame, path: str) -> None:
    """Write a snapshot over a table: complete beside it first, then renamed, so a failure leaves the old one."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(beside), at(path))
    fs.delete(at(old), True)


def reset(spark: SparkSession, *paths: str) -> None:
    """Drop tables and streaming checkpoints, so that the next ingest reads everything again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def recover_spill(spark: SparkSession, spill_path: str, capture_path: str) -> int:
    """Append spilled rows that the capture table lacks; their count."""
    from tracelake import schemas

    kind = schemas.schema("capture")
    rows = spark.read.schema(kind).json(spill_path)
    fresh = new_captures(rows, read_or(spark, capture_path, kind))
    n = fresh.count()
    fresh.write.mode("append").parquet(capture_path)
    return n
