"""What a call costs, from tokens and prices of a million tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Null where a count or a price is unknown."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def priced(calls: DataFrame, prices: DataFrame, dearest: bool = False) -> DataFrame:
    """calls (model, tokens_in, tokens_out) with cost_usd by a price list (model, local, price_in, price_out); local models are free.

    Unknown models have none, or with ``dearest`` the prices of the model whose input costs most (then its output). A price list is a rule file's few rows.
    """
    known = calls.join(F.broadcast(prices), "model", "left")
    top = prices.agg(F.max(F.struct("price_in", "price_out")).alias("__top")).select(F.col("__top.price_in").alias("__in"), F.col("__top.price_out").alias("__out"))
    if dearest:
        known = known.crossJoin(F.broadcast(top))  # one row
        known = known.withColumn("price_in", F.coalesce("price_in", "__in")).withColumn("price_out", F.coalesce("price_out", "__out"))
    paid = cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))
    return known.select(*calls.columns, F.when(F.coalesce("local", F.lit(False)), 0.0).otherwise(paid).alias("cost_usd"))
