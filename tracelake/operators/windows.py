"""Ordered operators over sessions, pairs and series: pairing, sampling, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, session: str, order: str, is_human: Column, value: Column, name: str) -> DataFrame:
    """The last human value at or before each row of a session; a human row with a null value resets it to null."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(F.when(is_human, F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"])


def with_parent(rows: DataFrame, session: str, order: list[str]) -> DataFrame:
    """parent_id: the id of the row before in its session."""
    return rows.withColumn("parent_id", F.lag("id").over(Window.partitionBy(session).orderBy(*order)))


def first_writer(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key whose last part isn't null; rows with a null there are never duplicates."""
    w = Window.partitionBy(*key).orderBy(*order)
    keyed = rows.where(F.col(key[-1]).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return keyed.unionByName(rows.where(F.col(key[-1]).isNull()))


def stratified_sample(traces: DataFrame, n: int, seed: str) -> DataFrame:
    """Up to n rows of each archetype: the newest half, and of the rest those that a seeded hash puts first.

    ``source`` says which. Stable for a seed and independent between archetypes.
    """
    w = Window.partitionBy("archetype_id")
    recent = max(1, n // 2)
    ranked = traces.withColumn("__newest", F.row_number().over(w.orderBy(F.desc("ts"), "id")))
    newest = ranked.where(F.col("__newest") <= min(recent, n)).withColumn("pick", F.lit("recent"))
    draw = F.md5(F.concat_ws(":", F.lit(seed), "archetype_id", "id"))
    rest = ranked.where(F.col("__newest") > recent).withColumn("__draw", F.row_number().over(w.orderBy(draw, "id"))).where(F.col("__draw") <= n - recent).drop("__draw").withColumn("pick", F.lit("random"))
    return newest.unionByName(rest).drop("__newest")


def chain_sample(traces: DataFrame, max_chains: int, max_steps: int, seed: str) -> DataFrame:
    """First steps of up to ``max_chains`` sessions (two steps at least) of each archetype, in a seeded order."""
    per = Window.partitionBy("archetype_id", "session_id")
    rows = traces.where("session_id IS NOT NULL").withColumn("__size", F.count("*").over(per)).where("__size >= 2")
    rows = rows.withColumn("step", F.row_number().over(per.orderBy("ts", "id")))
    draw = F.md5(F.concat_ws(":", F.lit(seed), "archetype_id", "session_id"))
    rows = rows.withColumn("chain", F.dense_rank().over(Window.partitionBy("archetype_id").orderBy(draw, "session_id")))
    return rows.where((F.col("chain") <= max_chains) & (F.col("step") <= max_steps)).drop("__size")


def latest(rows: DataFrame, pair: list[str], order: str = "ts") -> DataFrame:
    """All rows with the last ``order`` of their pair; ties stay."""
    return rows.withColumn("__r", F.rank().over(Window.partitionBy(*pair).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def regressions(checks: DataFrame, size: int, floor: float) -> DataFrame:
    """Pairs whose last ``size`` spot checks are there and pass in less than ``floor`` of cases."""
    w = Window.partitionBy("archetype_id", "candidate").orderBy(F.desc("ts"), F.desc("id"))
    last = checks.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= size)
    share = F.avg((F.col("result") == "pass").cast("double"))
    return last.groupBy("archetype_id", "candidate").agg(F.count("*").alias("n"), share.alias("pass_rate")).withColumn("breached", (F.col("n") == size) & (F.col("pass_rate") < floor))


def alerts(evaluations: DataFrame) -> DataFrame:
    """Evaluations that fire: a breach after no breach. Rows without data or with an error neither fire nor resolve."""
    known = evaluations.where(F.col("status").isin("ok", "breach"))
    before = F.lag("status").over(Window.partitionBy("objective").orderBy("ts", "id"))
    return known.withColumn("__before", F.coalesce(before, F.lit("ok"))).where("status = 'breach' AND __before <> 'breach'").drop("__before")


def capped_queue(eligible: DataFrame, queued: DataFrame, cap: int) -> DataFrame:
    """Newest eligible results of each archetype that fit under the cap beside those already queued."""
    there = queued.groupBy("archetype_id").agg(F.count("*").alias("__there"))
    w = Window.partitionBy("archetype_id").orderBy(F.desc("ts"), F.desc("id"))
    rows = eligible.withColumn("__n", F.row_number().over(w)).join(there, "archetype_id", "left")
    return rows.where(F.col("__n") + F.coalesce("__there", F.lit(0)) <= cap).drop("__n", "__there")
