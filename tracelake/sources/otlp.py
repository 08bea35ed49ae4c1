"""Token metrics in OTLP JSON: payloads to points, totals, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_POINTS = "array<struct<asInt:string,asDouble:double,timeUnixNano:string,attributes:array<struct<key:string,value:struct<stringValue:string>>>>>"
PAYLOAD = f"struct<resourceMetrics:array<struct<scopeMetrics:array<struct<metrics:array<struct<name:string,sum:struct<dataPoints:{_POINTS}>,gauge:struct<dataPoints:{_POINTS}>>>>>>>>"


def points(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(metric, ts_ms, value, attributes) of the data points of metrics whose name holds ``token``.

    A point's value is its double, else its integer; points without either go. Without a time, ts_ms is 0.
    """
    rows = payloads.select(F.from_json(column, PAYLOAD).alias("p")).select(F.explode("p.resourceMetrics").alias("r")).select(F.explode("r.scopeMetrics").alias("s")).select(F.explode("s.metrics").alias("m"))
    each = rows.where(F.contains("m.name", F.lit("token"))).select(F.col("m.name").alias("metric"), F.explode(F.coalesce("m.sum.dataPoints", "m.gauge.dataPoints")).alias("d"))
    value = F.coalesce("d.asDouble", F.col("d.asInt").try_cast("double"))
    attributes = F.map_from_entries(F.transform(F.coalesce("d.attributes", F.array().cast("array<struct<key:string,value:struct<stringValue:string>>>")), lambda a: F.struct(a["key"], a["value"]["stringValue"])))
    return each.select("metric", F.coalesce(F.floor(F.col("d.timeUnixNano").try_cast("decimal(20,0)") / 1_000_000).cast("bigint"), F.lit(0).cast("bigint")).alias("ts_ms"), value.alias("value"), attributes.alias("attributes")).where("value IS NOT NULL")


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the points in payload files, one a request, that a receiver lands in a folder; what doesn't parse has none."""
    return points(spark.readStream.schema("payload string").option("wholetext", True).text(folder))


def receive(spark: SparkSession, folder: str, path: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Append the points of newly landed payloads to a Parquet table: every so many seconds, or once what is there."""
    writer = landed(spark, folder).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def total_tokens(received: DataFrame) -> DataFrame:
    """(tokens): the sum of received points, 0 without any."""
    return received.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("tokens"))


def completeness(traced: Column, reported: Column) -> Column:
    """Share of reported tokens that traces have, at most 1; without reported tokens 1 for no tokens at all, else 0."""
    return F.when(reported <= 0, F.when(traced == 0, 1.0).otherwise(0.0)).otherwise(F.least(F.try_divide(traced.cast("double"), reported.cast("double")), F.lit(1.0)))
