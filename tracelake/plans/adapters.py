"""The driver's tables seen as the trace model, by fixed rules; SQL_VIEWS says the same rules to DuckDB.

Recorded traffic isn't among the test tables, so conversations stand for sessions and events for outcomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: 2024-01-31 00:00 UTC, the report time of the registered queries.
NOW = 1_706_659_200_000
DAY = 86_400_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, d: str) -> DataFrame:
    """One row per assistant turn, with the last user text at or before it."""
    rows = load(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paired = rows.withColumn("prompt_text", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)).where("role = 'assistant'")
    return paired.selectExpr(
        "concat('t', cast(conv_id * 1000 + turn AS string)) AS id", f"{NOW} - (conv_id % 40) * {DAY} + turn * 1000 - CASE WHEN conv_id % 40 = 0 THEN -900000 ELSE 0 END AS ts",
        "CASE conv_id % 3 WHEN 0 THEN 'proxy' WHEN 1 THEN 'transcript' ELSE 'otel' END AS source", "CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'script' WHEN 2 THEN 'chat' ELSE 'codex' END AS tool",
        "CASE WHEN conv_id % 23 = 0 THEN 'unknown' ELSE concat('m', cast(conv_id % 3 AS string)) END AS model", "prompt_text", "text AS response_text",
        "CASE WHEN conv_id % 13 = 0 THEN NULL ELSE length(prompt_text) div 4 END AS tokens_in", "length(text) div 4 AS tokens_out", "100 + (conv_id * 7 + turn * 13) % 900 AS latency_ms",
        "CASE WHEN conv_id % 4 = 0 THEN NULL ELSE length(text) / 1000.0D END AS cost_usd", "concat('s', cast(conv_id AS string)) AS session_id", "conv_id % 17 = 0 AS quarantined", "conv_id", "turn",
    )


def assignments(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d).where("conv_id % 9 <> 0").selectExpr("id AS trace_id", "concat('a', cast(conv_id % 8 AS string)) AS archetype_id", "(conv_id % 10) / 20.0D AS distance", f"{NOW} AS assigned_ts")


def archetypes(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(10).selectExpr("concat('a', cast(id AS string)) AS id", "concat('Label ', cast(id % 6 AS string)) AS label", "id = 0 AS pinned", "CASE WHEN id = 7 THEN 'a1' END AS merged_into", "0L AS created_ts", "0L AS updated_ts")


def events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def replay_results(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type <> 'signup'").selectExpr(
        "concat('r', cast(event_id AS string)) AS id", "concat('a', cast(user_id % 8 AS string)) AS archetype_id", "concat('c', cast(event_id % 3 AS string)) AS candidate", "concat('t', cast((user_id % 100) * 1000 + 1 AS string)) AS source_trace_id",
        "CASE WHEN event_type = 'error' AND user_id % 3 = 0 OR event_id % 29 = 0 THEN 'fail' ELSE 'pass' END AS verdict", "value / 1000.0D AS cost_usd", "cast(event_id % 700 AS int) AS latency_ms",
        "CASE WHEN event_id % 11 = 0 THEN 'chain' ELSE 'suite' END AS grader", "concat('run', cast(event_id % 2 AS string)) AS run_id", "ms AS ts", "event_id",
    )


def spot_checks(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'signup'").selectExpr(
        "concat('k', cast(event_id AS string)) AS id", "concat('a', cast(user_id % 8 AS string)) AS archetype_id", "concat('c', cast(event_id % 3 AS string)) AS candidate", "CASE WHEN event_id % 6 = 0 OR user_id % 8 = 3 AND event_id % 2 = 0 THEN 'fail' ELSE 'pass' END AS result", "ms AS ts",
    )


def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = F.explode(F.expr("array(named_struct('scorer', 'format', 'passed', event_id % 31 <> 0), named_struct('scorer', 'completion', 'passed', event_id % 37 <> 0), named_struct('scorer', 'judge', 'passed', (verdict = 'pass') <> (event_id % 9 = 0)))")).alias("s")
    rows = replay_results(spark, d).select("id", "run_id", "archetype_id", "candidate", "ts", "event_id", scored).where("s.scorer <> 'judge' OR event_id % 5 <> 0")
    return rows.selectExpr("id AS replay_result_id", "run_id", "archetype_id", "candidate", "s.scorer AS scorer", "CASE WHEN s.passed THEN 1.0D ELSE (event_id % 4) / 10.0D END AS value", "s.passed AS passed", "ts")


def human_reviews(spark: SparkSession, d: str) -> DataFrame:
    return replay_results(spark, d).where("event_id % 7 = 0").selectExpr("id AS replay_result_id", "CASE WHEN event_id % 21 = 0 THEN NULL WHEN (verdict = 'pass') <> (event_id % 10 = 0) THEN 'pass' ELSE 'fail' END AS human_verdict", "ts + 1000 AS queued_ts")


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """One for each supplier; of every eight, four are live at the report time, of six archetypes and candidate c0 or c1."""
    return load(spark, d, "supplier").selectExpr("concat('n', cast(s_suppkey AS string)) AS id", "concat('a', cast(s_suppkey % 6 AS string)) AS archetype_id", "concat('c', cast(s_suppkey % 2 AS string)) AS candidate", "'usd' AS currency", "s_acctbal AS value", f"{NOW} + (s_suppkey % 8 - 3) * {DAY} AS expires_ts")


def applied_policies(spark: SparkSession, d: str) -> DataFrame:
    """One for each customer, of eight archetypes and three candidates."""
    return load(spark, d, "customer").selectExpr("concat('p', cast(c_custkey AS string)) AS id", "concat('a', cast(c_custkey % 8 AS string)) AS archetype_id", "concat('c', cast(c_custkey % 3 AS string)) AS candidate", f"{NOW} - (c_custkey % 12) * {DAY} AS applied_ts", f"CASE WHEN c_custkey % 4 = 1 THEN {NOW} - (c_custkey % 400) * 3600000 END AS reverted_ts")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """One for each part: some local and free, the others with two prices a million tokens."""
    return load(spark, d, "part").selectExpr("concat('p', cast(p_partkey AS string)) AS name", "p_size % 7 = 0 AS local", "CASE WHEN p_size % 7 = 0 THEN 0.0D ELSE floor(p_retailprice / 100) / 10.0D END AS price_in", "CASE WHEN p_size % 7 = 0 THEN 0.0D ELSE floor(p_retailprice / 100) / 10.0D * (1 + p_size % 4) END AS price_out", "p_partkey AS position")


def slo_evaluations(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).selectExpr("event_id AS id", "event_type AS objective", "ms AS ts", "value", "value <= 100 AS ok", "CASE WHEN event_id % 19 = 0 THEN 'no_data' WHEN value <= 100 THEN 'ok' ELSE 'breach' END AS status")


SQL_VIEWS = f"""
paired AS (
  SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt_text FROM conversations
), traces AS (
  SELECT 't' || (conv_id * 1000 + turn) AS id, {NOW} - (conv_id % 40) * {DAY} + turn * 1000 - CASE WHEN conv_id % 40 = 0 THEN -900000 ELSE 0 END AS ts,
    CASE conv_id % 3 WHEN 0 THEN 'proxy' WHEN 1 THEN 'transcript' ELSE 'otel' END AS source, CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'script' WHEN 2 THEN 'chat' ELSE 'codex' END AS tool,
    CASE WHEN conv_id % 23 = 0 THEN 'unknown' ELSE 'm' || (conv_id % 3) END AS model, prompt_text, text AS response_text,
    CASE WHEN conv_id % 13 = 0 THEN NULL ELSE length(prompt_text) // 4 END AS tokens_in, length(text) // 4 AS tokens_out, 100 + (conv_id * 7 + turn * 13) % 900 AS latency_ms,
    CASE WHEN conv_id % 4 = 0 THEN NULL ELSE length(text) / 1000.0::DOUBLE END AS cost_usd, 's' || conv_id AS session_id, conv_id % 17 = 0 AS quarantined, conv_id, turn FROM paired WHERE role = 'assistant'
), assignments AS (
  SELECT id AS trace_id, 'a' || (conv_id % 8) AS archetype_id, (conv_id % 10) / 20.0::DOUBLE AS distance FROM traces WHERE conv_id % 9 <> 0
), archetypes AS (
  SELECT 'a' || i AS id, 'Label ' || (i % 6) AS label, i = 0 AS pinned, CASE WHEN i = 7 THEN 'a1' END AS merged_into FROM range(10) r(i)
), ev AS (
  SELECT *, epoch_us(ts) // 1000 AS ms FROM events
), replay_results AS (
  SELECT 'r' || event_id AS id, 'a' || (user_id % 8) AS archetype_id, 'c' || (event_id % 3) AS candidate, 't' || ((user_id % 100) * 1000 + 1) AS source_trace_id,
    CASE WHEN event_type = 'error' AND user_id % 3 = 0 OR event_id % 29 = 0 THEN 'fail' ELSE 'pass' END AS verdict, value / 1000.0::DOUBLE AS cost_usd, (event_id % 700)::INT AS latency_ms,
    CASE WHEN event_id % 11 = 0 THEN 'chain' ELSE 'suite' END AS grader, 'run' || (event_id % 2) AS run_id, ms AS ts, event_id FROM ev WHERE event_type <> 'signup'
), spot_checks AS (
  SELECT 'k' || event_id AS id, 'a' || (user_id % 8) AS archetype_id, 'c' || (event_id % 3) AS candidate, CASE WHEN event_id % 6 = 0 OR user_id % 8 = 3 AND event_id % 2 = 0 THEN 'fail' ELSE 'pass' END AS result, ms AS ts FROM ev WHERE event_type = 'signup'
), eval_scores AS (
  SELECT id AS replay_result_id, run_id, archetype_id, candidate, scorer, CASE WHEN passed THEN 1.0 ELSE (event_id % 4) / 10.0 END::DOUBLE AS value, passed, ts FROM (
    SELECT *, 'format' AS scorer, event_id % 31 <> 0 AS passed FROM replay_results UNION ALL SELECT *, 'completion', event_id % 37 <> 0 FROM replay_results
    UNION ALL SELECT *, 'judge', (verdict = 'pass') <> (event_id % 9 = 0) FROM replay_results WHERE event_id % 5 <> 0)
), human_reviews AS (
  SELECT id AS replay_result_id, CASE WHEN event_id % 21 = 0 THEN NULL WHEN (verdict = 'pass') <> (event_id % 10 = 0) THEN 'pass' ELSE 'fail' END AS human_verdict, ts + 1000 AS queued_ts FROM replay_results WHERE event_id % 7 = 0
), recommendations AS (
  SELECT 'n' || s_suppkey AS id, 'a' || (s_suppkey % 6) AS archetype_id, 'c' || (s_suppkey % 2) AS candidate, 'usd' AS currency, s_acctbal AS value, {NOW} + (s_suppkey % 8 - 3) * {DAY} AS expires_ts FROM supplier
), applied_policies AS (
  SELECT 'p' || c_custkey AS id, 'a' || (c_custkey % 8) AS archetype_id, 'c' || (c_custkey % 3) AS candidate, {NOW} - (c_custkey % 12) * {DAY} AS applied_ts, CASE WHEN c_custkey % 4 = 1 THEN {NOW} - (c_custkey % 400) * 3600000 END AS reverted_ts FROM customer
), candidates AS (
  SELECT 'p' || p_partkey AS name, p_size % 7 = 0 AS local, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE floor(p_retailprice / 100) / 10.0 END::DOUBLE AS price_in, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE floor(p_retailprice / 100) / 10.0 * (1 + p_size % 4) END::DOUBLE AS price_out, p_partkey AS position FROM part
), slo_evaluations AS (
  SELECT event_id AS id, event_type AS objective, ms AS ts, value, value <= 100 AS ok, CASE WHEN event_id % 19 = 0 THEN 'no_data' WHEN value <= 100 THEN 'ok' ELSE 'breach' END AS status FROM ev
)"""
