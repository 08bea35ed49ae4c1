"""Shared helpers: joins that spare hot keys, columns made in batches, stored tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import annotate, ascii_lower, spread_join, stored


def test_spread_join_equals_join(spark):
    rows = spark.range(6000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1500 + 100).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), (F.max("row") * 2).alias("v"))
    keep = table.where("k % 2 = 1")
    got = {tuple(r) for r in spread_join(rows, keep, ["k"], "n", 6000).select("k", "row", "v").collect()}
    want = {tuple(r) for r in rows.join(keep, "k").select("k", "row", "v").collect()}
    assert got == want and len(got) > 2000
    plan = spread_join(rows, keep, ["k"], "n", 6000)._jdf.queryExecution().toString()
    assert "Union" in plan


def test_annotate_passes_odd_columns(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.5)], "`a.b` int, made string, `i0` double")
    out = annotate(df, ["made"], [("made", T.StringType()), ("size", T.LongType())], lambda texts: [[(t or "") + "!" for t in texts], [len(t or "") for t in texts]])
    assert out.columns == ["a.b", "i0", "made", "size"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, None, "a!", 1), (2, 3.5, "!", 0)]
    kept = annotate(df, ["made"], [("__k", T.BooleanType())], lambda texts: [[t is not None for t in texts]], keep=0)
    assert kept.columns == df.columns and kept.count() == 1


def test_ascii_lower_and_stored(spark):
    df = spark.createDataFrame([("ABC É",), ("ABC",), (None,), ("",)], "t string").select(ascii_lower(F.col("t")).alias("t"))
    again = stored(df, "test")
    assert {r.t for r in again.collect()} == {"abc É", "abc", None, ""} and again.schema == df.schema
