"""Counts by day, kept as rows arrive, and the monitoring reports from them instead of from the whole history.

A rollup is a table of sums that add up: a late row amends its own day, a changed row takes its old version's counts back
and gives its new one's. A window's whole days come from the rollup; of the days that it cuts, at most two, the rows
themselves are counted by the same function, so every report equals that of a full scan, whatever its time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import stats
from tracelake.operators import reports
from tracelake.operators.reports import DAY_MS

TRACES = "day bigint, feature string, key string, n bigint"
OUTCOMES = "day bigint, archetype_id string, candidate string, n bigint, n_pass bigint, latency_sum bigint, n_latency bigint"


def day(ts: Column) -> Column:
    """Days since 1970, in UTC; null for no time."""
    return F.floor((ts - F.pmod(ts, F.lit(DAY_MS))) / DAY_MS).cast("bigint")


def _counted(rows: DataFrame, cells: list[tuple[str, Column, Column]]) -> DataFrame:
    """(day, feature, key, n) over cells (feature, key, n); counts of zero are left out. Combined before the shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), k.cast("string").alias("key"), n.cast("bigint").alias("n")) for f, k, n in cells])).alias("e")
    return rows.select(day(F.col("ts")).alias("day"), each).where("e.n <> 0").groupBy("day", "e.feature", "e.key").agg(F.sum("e.n").alias("n")).where("n <> 0").select("day", "feature", "key", "n")


def trace_counts(traces: DataFrame) -> DataFrame:
    """Counts of traces (with ``empty_response``), all of them as yet unassigned; rows without a time belong to no day and to no window."""
    one, fresh = F.lit(1), (~F.col("quarantined")).cast("int")
    checks = {"rows": one, "fresh": fresh, "unassigned": fresh, "quarantined": F.col("quarantined"), "missing_tokens": F.col("tokens_in").isNull() | F.col("tokens_out").isNull(), "unknown_model": F.col("model") == "unknown", "empty_response": F.col("empty_response")}
    cells = [("archetype", F.lit(None), one), ("model", F.col("model"), one), ("prompt_length", stats.length_bucket(F.col("tokens_in")), one)]
    return _counted(traces.where("ts IS NOT NULL"), cells + [("check", F.lit(k), F.coalesce(n.cast("int"), F.lit(0))) for k, n in checks.items()])


def assignment_counts(traces: DataFrame, after: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """What assignments move: out of unassigned, or of the archetype before, into the one after; a trace is in each once at most.

    ``traces`` must hold those of the assignments; one that has none there moves nothing.
    """
    rows = traces.where("ts IS NOT NULL").select("id", "ts", "quarantined").join(after.select(F.col("trace_id").alias("id"), F.col("archetype_id").alias("to")), "id")
    if before is None:
        rows = rows.withColumns({"from": F.lit(None).cast("string"), "known": F.lit(False)})
    else:
        rows = rows.join(before.select(F.col("trace_id").alias("id"), F.col("archetype_id").alias("from"), F.lit(True).alias("known")), "id", "left")
    first = F.col("known").isNull() | ~F.col("known")
    return _counted(rows, [("archetype", F.col("from"), F.lit(-1)), ("archetype", F.col("to"), F.lit(1)), ("check", F.lit("unassigned"), F.when(first & ~F.col("quarantined"), -1).otherwise(0))])


def all_counts(traces: DataFrame, assignments: DataFrame) -> DataFrame:
    """Counts of traces with their assignments."""
    return merged(trace_counts(traces).unionByName(assignment_counts(traces, assignments)), "day", "feature", "key")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Sums of outcomes (archetype_id, candidate, passed, latency_ms, ts)."""
    rows = outcomes.where("ts IS NOT NULL").withColumn("day", day(F.col("ts")))
    return rows.groupBy("day", "archetype_id", "candidate").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_pass"), F.coalesce(F.sum(F.col("latency_ms").cast("bigint")), F.lit(0)).alias("latency_sum"), F.count("latency_ms").alias("n_latency"))


def merged(rollup: DataFrame, *keys: str) -> DataFrame:
    """A row a key: the sums of all parts. What is written in place of many parts."""
    sums = [c for c in rollup.columns if c not in keys]
    return rollup.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where(" OR ".join(f"{c} <> 0" for c in sums)).select(rollup.columns)


def inside(rollup: DataFrame, rows: DataFrame, count: Callable[[DataFrame], DataFrame], low: int, high: int | None) -> DataFrame:
    """Sums of the rows with ``low`` <= ts <= ``high`` (null: no end), not merged: whole days of the rollup, and cut days from the rows."""
    ts, first = F.col("ts"), -(-low // DAY_MS)
    end = None if high is None else (high + 1) // DAY_MS
    if end is not None and end <= first:
        return count(rows.where((ts >= low) & (ts <= high)))
    whole = rollup.where(F.col("day") >= first) if end is None else rollup.where((F.col("day") >= first) & (F.col("day") < end))
    edges = []
    if low < first * DAY_MS:
        edges.append((ts >= low) & (ts < first * DAY_MS))
    if end is not None and end * DAY_MS <= high:
        edges.append((ts >= end * DAY_MS) & (ts <= high))
    for edge in edges:
        whole = whole.unionByName(count(rows.where(edge)))
    return whole


def rollup_sink(path: str, count: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch's counts are a folder of its query's, so that a batch done again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        count(batch).write.mode("overwrite").parquet(f"{path}/query={query}/batch={number}")

    return write


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """What :func:`rollup_sink` wrote; ``kind`` is TRACES or OUTCOMES."""
    return spark.read.schema(kind).option("recursiveFileLookup", True).parquet(path)


def drift_keys(rollup: DataFrame, traces: DataFrame, assignments: DataFrame, archetypes: DataFrame, now_ms: int, recent_days: int = 7, base_days: int = 28) -> DataFrame:
    """``reports.drift_keys`` from a rollup of traces; archetypes are looked up as they are named and merged now."""
    start, edge = now_ms - (recent_days + base_days) * DAY_MS, now_ms - recent_days * DAY_MS

    def count(rows: DataFrame) -> DataFrame:
        return all_counts(rows, assignments)

    parts = inside(rollup, traces, count, edge, now_ms).withColumn("is_recent", F.lit(True)).unionByName(inside(rollup, traces, count, start, edge - 1).withColumn("is_recent", F.lit(False)))
    sums = parts.where("feature <> 'check'").groupBy("feature", "key").agg(*[F.sum(F.when(x, F.col("n")).otherwise(0)).alias(c) for c, x in (("recent", F.col("is_recent")), ("base", ~F.col("is_recent")))])
    names = archetypes.select(F.col("id").alias("a_id"), "merged_into")
    named = sums.join(names, (F.col("feature") == "archetype") & (F.col("key") == F.col("a_id")), "left")
    key = F.when(F.col("feature") == "archetype", F.coalesce("merged_into", "a_id", F.lit("(unassigned)"))).otherwise(F.col("key"))
    return named.groupBy("feature", key.alias("key")).agg(F.sum("recent").alias("recent"), F.sum("base").alias("base")).where("recent <> 0 OR base <> 0")


def performance(rollup: DataFrame, outcomes: DataFrame, archetypes: DataFrame, now_ms: int, days: int = 7, least: int = 10) -> DataFrame:
    """``reports.performance`` from a rollup of outcomes."""
    edge, start = now_ms - days * DAY_MS, now_ms - 2 * days * DAY_MS
    parts = inside(rollup, outcomes, outcome_counts, edge, now_ms).withColumn("is_recent", F.lit(True)).unionByName(inside(rollup, outcomes, outcome_counts, start, edge - 1).withColumn("is_recent", F.lit(False)))
    total = lambda c, recent: F.sum(F.when(F.col("is_recent") == recent, F.col(c)).otherwise(0))
    sums = parts.groupBy("archetype_id", "candidate").agg(
        total("n", True).alias("n_recent"), total("n_pass", True).alias("pass_recent"), total("n", False).alias("n_previous"), total("n_pass", False).alias("pass_previous"),
        stats.ratio(total("latency_sum", True), total("n_latency", True)).alias("latency_recent"), stats.ratio(total("latency_sum", False), total("n_latency", False)).alias("latency_previous"),
    )
    return reports.performance_scores(sums, archetypes, least)


def data_quality(rollup: DataFrame, traces: DataFrame, assignments: DataFrame, now_ms: int, days: int = 7, limits: dict = reports.QUALITY_LIMITS) -> DataFrame:
    """``reports.data_quality`` from a rollup of traces."""

    def count(rows: DataFrame) -> DataFrame:
        return all_counts(rows, assignments)

    late = inside(rollup, traces, count, now_ms + 300_001, None).where("feature = 'check' AND key = 'rows'").withColumn("key", F.lit("future_timestamp"))
    parts = inside(rollup, traces, count, now_ms - days * DAY_MS, None).where("feature = 'check'").unionByName(late)
    number = lambda k: F.coalesce(F.sum(F.when(F.col("key") == k, F.col("n"))), F.lit(0))
    one = parts.agg(*[x for k in limits for x in (number(k).alias(f"{k}_0"), number("fresh" if k == "unassigned" else "rows").alias(f"{k}_1"))])
    return reports.quality_checks(one, assignments, limits)
