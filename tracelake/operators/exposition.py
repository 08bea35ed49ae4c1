"""Metric series as the text format that scrapers read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.prefix import percentiles


#: Values below this are added up exactly, to twelve decimal places each.
EXACT = 1e12


def _digits(value):
    """The shortest digits that read back as the value, without an exponent from 1e-4 to 1e16."""
    if value is None or math.isfinite(value):
        return None if value is None else repr(value)
    return "NaN" if math.isnan(value) else "+Inf" if value > 0 else "-Inf"


def _written(value: Column) -> Column:
    return F.udf(_digits, "string")(value)


def _total(value: str) -> Column:
    """The sum of a group, in whole numbers and decimals, so that neither order nor number of rows tells; of larger or non-finite values a plain one."""
    small = F.coalesce(F.abs(value) < EXACT, F.lit(True))
    held = F.when(small, F.col(value))
    whole = F.sum(F.floor(held).cast("decimal(14,0)")).cast("decimal(25,0)")
    rest = F.sum((held - F.floor(held)).cast("decimal(14,12)")).cast("decimal(25,12)")
    return F.when(F.every(small), (whole + rest).cast("double")).otherwise(F.sum(value))


def exposition(rows: DataFrame, prefix: str) -> DataFrame:
    """Sorted lines (line) from rows (name, kind, labels, value): counters add up, gauges take the largest, histograms become quantiles, sum and count."""
    name = F.concat(F.lit(prefix), F.regexp_replace("name", "[^A-Za-z0-9_]", "_"))
    quoted = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), quoted(e["value"]), F.lit('"'))), ",")
    keyed = rows.select(name.alias("name"), "kind", pairs.alias("pairs"), "value")
    sums = keyed.groupBy("name", "kind", "pairs").agg(_total("value").alias("sum"), F.max("value").alias("max"), F.count("value").alias("n"))
    ranks = percentiles(keyed.where("kind = 'histogram'"), ["name", "pairs"], "value", {"q0": 0.5, "q1": 0.9, "q2": 0.99}).drop("n").withColumn("kind", F.lit("histogram"))
    sums = sums.join(ranks, ["name", "pairs", "kind"], "left")
    braced = lambda extra: F.when((F.col("pairs") == "") & F.lit(extra == ""), "").otherwise(F.concat(F.lit("{"), F.concat_ws(",", F.nullif("pairs", F.lit("")), F.lit(extra or None)), F.lit("}")))
    plain = F.array(F.concat("name", braced(""), F.lit(" "), _written(F.when(F.col("kind") == "gauge", F.col("max")).otherwise(F.col("sum")))))
    quantiles = [F.concat("name", braced(f'quantile="{q}"'), F.lit(" "), _written(F.col(f"q{i}"))) for i, q in enumerate((0.5, 0.9, 0.99))]
    summary = F.array(*quantiles, F.concat("name", F.lit("_sum"), braced(""), F.lit(" "), _written(F.round("sum", 6))), F.concat("name", F.lit("_count"), braced(""), F.lit(" "), F.col("n").cast("string")))
    return sums.select(F.explode(F.when(F.col("kind") == "histogram", summary).otherwise(plain)).alias("line")).orderBy("line")
