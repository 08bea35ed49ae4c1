"""Registered queries of the trace operators, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import cost, messages, scorers, stats
from tracelake.functions import text as tx
from tracelake.operators import density, mining, prefix, reports, rollups, similarity, tables, windows
from tracelake.plans import adapters as ad
from tracelake.plans.adapters import DAY, NOW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False, recursive: bool = False):
    """Register a function under its name; ``sql`` stands on the adapters' views unless it is ``plain``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if plain else f"WITH {'RECURSIVE ' * recursive}{ad.SQL_VIEWS}{'' if sql.lstrip().startswith('SELECT') else ','} {sql}"
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- reports ---------------------------------------------------------------------------------------------------------

_WILSON = """CASE WHEN {n} = 0 THEN {none} ELSE {edge}({bound}, ({p} + 3.8416 / (2 * {n}) {sign} 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n})) END"""
_LOW = lambda p, n: _WILSON.format(p=p, n=n, none="0.0", edge="greatest", bound="0.0", sign="-")
_HIGH = lambda p, n: _WILSON.format(p=p, n=n, none="1.0", edge="least", bound="1.0", sign="+")


def _performance(now: int) -> str:
    return f"""outcomes AS (
  SELECT archetype_id, candidate, verdict = 'pass' AS passed, latency_ms, ts FROM replay_results WHERE grader <> 'chain'
  UNION ALL SELECT archetype_id, candidate, result = 'pass', NULL, ts FROM spot_checks
), sums AS (
  SELECT archetype_id, candidate, count(*) FILTER (WHERE ts >= {now - 7 * DAY}) AS n_recent, count(*) FILTER (WHERE ts >= {now - 7 * DAY} AND passed) AS pass_recent,
    count(*) FILTER (WHERE ts < {now - 7 * DAY}) AS n_previous, count(*) FILTER (WHERE ts < {now - 7 * DAY} AND passed) AS pass_previous,
    avg(latency_ms) FILTER (WHERE ts >= {now - 7 * DAY}) AS latency_recent, avg(latency_ms) FILTER (WHERE ts < {now - 7 * DAY}) AS latency_previous
  FROM outcomes WHERE ts BETWEEN {now - 14 * DAY} AND {now} GROUP BY 1, 2
), rates AS (
  SELECT *, pass_recent::DOUBLE / nullif(n_recent, 0) AS p1, pass_previous::DOUBLE / nullif(n_previous, 0) AS p2, (pass_recent + pass_previous)::DOUBLE / (n_recent + n_previous) AS pool FROM sums
), scored AS (
  SELECT *, CASE WHEN n_recent >= 10 AND n_previous >= 10 THEN CASE WHEN pool * (1 - pool) = 0 THEN 0.0 ELSE (p1 - p2) / sqrt(pool * (1 - pool) * (1.0 / n_recent + 1.0 / n_previous)) END END AS z FROM rates
)
SELECT s.archetype_id, candidate, coalesce(a.label, s.archetype_id) AS label, n_recent, pass_recent, n_previous, pass_previous, round(latency_recent, 6) AS latency_recent, round(latency_previous, 6) AS latency_previous,
  round(p1, 6) AS pass_rate, round({_LOW('p1', 'n_recent')}, 6) AS ci_low, round({_HIGH('p1', 'n_recent')}, 6) AS ci_high, round(z, 6) AS z, coalesce(z <= -1.645, false) AS degraded
FROM scored s LEFT JOIN archetypes a ON s.archetype_id = a.id"""


@query(_performance(NOW))
def performance_report(spark, d):
    done = reports.performance(ad.replay_results(spark, d), ad.spot_checks(spark, d), ad.archetypes(spark, d), NOW)
    return rounded(done, "latency_recent", "latency_previous", "pass_rate", "ci_low", "ci_high", "z")


def _drift(now: int) -> str:
    return f"""windowed AS (
  SELECT t.ts >= {now - 7 * DAY} AS is_recent, coalesce(a.merged_into, a.id, '(unassigned)') AS archetype, model,
    CASE WHEN tokens_in IS NULL OR tokens_in <= 0 THEN 'unknown' WHEN tokens_in = 1 THEN '<=1' ELSE '<=' || (1::BIGINT << length(bin(tokens_in - 1))) END AS bucket
  FROM traces t LEFT JOIN assignments s ON t.id = s.trace_id LEFT JOIN archetypes a ON s.archetype_id = a.id WHERE t.ts BETWEEN {now - 35 * DAY} AND {now}
), keyed AS (
  SELECT is_recent, 'archetype' AS feature, archetype AS key FROM windowed UNION ALL SELECT is_recent, 'model', model FROM windowed UNION ALL SELECT is_recent, 'prompt_length', bucket FROM windowed
), counts AS (
  SELECT feature, key, count(*) FILTER (WHERE is_recent) AS recent, count(*) FILTER (WHERE NOT is_recent) AS base FROM keyed GROUP BY 1, 2
), shares AS (
  SELECT *, sum(recent) OVER (PARTITION BY feature) AS n_recent, sum(base) OVER (PARTITION BY feature) AS n_base FROM counts
), rates AS (
  SELECT *, recent::DOUBLE / nullif(n_recent, 0) AS r, base::DOUBLE / nullif(n_base, 0) AS b FROM shares
)"""


_DRIFT = _drift(NOW)


@query(_DRIFT + " SELECT feature, key, recent, base FROM counts")
def drift_mix(spark, d):
    return reports.drift_keys(ad.traces(spark, d), ad.assignments(spark, d), ad.archetypes(spark, d), NOW)


@query(_DRIFT + """, scores AS (
  SELECT feature, max(n_recent)::BIGINT AS n_recent, max(n_base)::BIGINT AS n_base, sum((greatest(r, 1e-4) - greatest(b, 1e-4)) * ln(greatest(r, 1e-4) / greatest(b, 1e-4))) AS psi,
    sum((CASE WHEN r > 0 THEN r * log2(r / ((r + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((r + b) / 2)) ELSE 0 END) / 2) AS js FROM rates GROUP BY 1
)
SELECT feature, n_recent, n_base, CASE WHEN n_recent >= 30 AND n_base >= 30 THEN round(psi, 6) END AS psi, CASE WHEN n_recent >= 30 AND n_base >= 30 THEN round(least(greatest(js, 0), 1), 6) END AS js,
  CASE WHEN n_recent < 30 OR n_base < 30 THEN 'insufficient_data' WHEN psi > 0.25 THEN 'significant' WHEN psi > 0.1 THEN 'moderate' ELSE 'stable' END AS status FROM scores""")
def drift_scores(spark, d):
    return rounded(reports.drift_report(drift_mix(spark, d)), "psi", "js")


@query(_DRIFT + """ SELECT feature, key, round(delta, 6) AS delta, rank FROM (
  SELECT feature, key, delta, row_number() OVER (PARTITION BY feature ORDER BY abs(delta) DESC, key DESC) AS rank FROM (SELECT feature, key, round(coalesce(r, 0) - coalesce(b, 0), 9) AS delta FROM rates)
) WHERE rank <= 5""")
def drift_top_shifts(spark, d):
    return rounded(reports.top_shifts(drift_mix(spark, d)).select("feature", "key", "delta", "rank"), "delta")


def _traces_said(spark: SparkSession, d: str) -> DataFrame:
    return ad.traces(spark, d).withColumn("empty_response", F.trim("response_text") == "")


def _quality(now: int) -> str:
    return f"""rows AS (
  SELECT t.*, trim(response_text) = '' AS empty, s.trace_id IS NOT NULL AS assigned FROM traces t LEFT JOIN (SELECT DISTINCT trace_id FROM assignments) s ON t.id = s.trace_id WHERE ts >= {now - 7 * DAY}
), one AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE quarantined) AS q, count(*) FILTER (WHERE tokens_in IS NULL OR tokens_out IS NULL) AS m, count(*) FILTER (WHERE model = 'unknown') AS u,
    count(*) FILTER (WHERE empty) AS e, count(*) FILTER (WHERE NOT quarantined AND NOT assigned) AS a, count(*) FILTER (WHERE NOT quarantined) AS na, count(*) FILTER (WHERE ts > {now + 300000}) AS f FROM rows
), cells AS (
  SELECT 'quarantined' AS "check", q AS n, n AS total, 0.05 AS threshold FROM one UNION ALL SELECT 'missing_tokens', m, n, 0.02 FROM one UNION ALL SELECT 'unknown_model', u, n, 0.01 FROM one
  UNION ALL SELECT 'empty_response', e, n, 0.20 FROM one UNION ALL SELECT 'unassigned', a, na, 0.20 FROM one UNION ALL SELECT 'future_timestamp', f, n, 0.0 FROM one
)
SELECT "check", n, total, round(n::DOUBLE / nullif(total, 0), 6) AS ratio, threshold::DOUBLE AS threshold, coalesce(n::DOUBLE / nullif(total, 0) <= threshold::DOUBLE, true) AS ok FROM cells"""


@query(_quality(NOW))
def quality_ratios(spark, d):
    return rounded(reports.data_quality(_traces_said(spark, d), ad.assignments(spark, d), NOW), "ratio")


#: A report time in the middle of a day, so that windows cut days.
LATER = NOW + 29_580_123


@query(_drift(LATER) + " SELECT feature, key, recent, base FROM counts")
def drift_mix_rolled(spark, d):
    """The drift counts from a rollup by day, which is written first; the rows are read again for the cut days only."""
    rows, given = _traces_said(spark, d), ad.assignments(spark, d)
    return rollups.drift_keys(tables.shared_table(rollups.all_counts(rows, given), "rollup"), rows, given, ad.archetypes(spark, d), LATER)


@query(_performance(LATER))
def performance_rolled(spark, d):
    rows = reports.outcomes(ad.replay_results(spark, d), ad.spot_checks(spark, d))
    done = rollups.performance(tables.shared_table(rollups.outcome_counts(rows), "rollup"), rows, ad.archetypes(spark, d), LATER)
    return rounded(done, "latency_recent", "latency_previous", "pass_rate", "ci_low", "ci_high", "z")


@query(_quality(LATER))
def quality_rolled(spark, d):
    rows, given = _traces_said(spark, d), ad.assignments(spark, d)
    return rounded(rollups.data_quality(tables.shared_table(rollups.all_counts(rows, given), "rollup"), rows, given, LATER), "ratio")


@query("""pairs AS (
  SELECT j.passed AS judge, h.human_verdict = 'pass' AS human FROM human_reviews h JOIN replay_results r ON h.replay_result_id = r.id JOIN eval_scores j ON j.replay_result_id = r.id AND j.scorer = 'judge' WHERE h.human_verdict IS NOT NULL
), one AS (
  SELECT count(*) FILTER (WHERE judge AND human) AS a, count(*) FILTER (WHERE judge AND NOT human) AS b, count(*) FILTER (WHERE NOT judge AND human) AS c, count(*) FILTER (WHERE NOT judge AND NOT human) AS d, count(*)::DOUBLE AS n FROM pairs
), chance AS (SELECT *, (a + d) / n AS seen, (a + b) / n * ((a + c) / n) + (1 - (a + b) / n) * (1 - (a + c) / n) AS e FROM one)
SELECT n::BIGINT AS n, round(seen, 6) AS agreement, round((seen - e) / (1 - e), 6) AS kappa, round(b::DOUBLE / (b + d), 6) AS false_pass_rate, round(c::DOUBLE / (c + a), 6) AS false_fail_rate FROM chance""")
def review_agreement(spark, d):
    pairs = reports.review_pairs(ad.human_reviews(spark, d), ad.replay_results(spark, d), ad.eval_scores(spark, d))
    return rounded(reports.agreement(pairs), "agreement", "kappa", "false_pass_rate", "false_fail_rate")


@query("""pairs AS (
  SELECT j.passed AS judge, h.human_verdict = 'pass' AS human FROM human_reviews h JOIN replay_results r ON h.replay_result_id = r.id JOIN eval_scores j ON j.replay_result_id = r.id AND j.scorer = 'judge' WHERE h.human_verdict IS NOT NULL AND r.archetype_id = 'a3'
), one AS (
  SELECT count(*) FILTER (WHERE judge AND human) AS a, count(*) FILTER (WHERE judge AND NOT human) AS b, count(*) FILTER (WHERE NOT judge AND human) AS c, count(*) FILTER (WHERE NOT judge AND NOT human) AS d, count(*)::DOUBLE AS n FROM pairs
), chance AS (SELECT *, (a + d) / n AS seen, (a + b) / n * ((a + c) / n) + (1 - (a + b) / n) * (1 - (a + c) / n) AS e FROM one)
SELECT n::BIGINT AS n, round(seen, 6) AS agreement, round((seen - e) / (1 - e), 6) AS kappa, round(b::DOUBLE / (b + d), 6) AS false_pass_rate, round(c::DOUBLE / (c + a), 6) AS false_fail_rate FROM chance""")
def review_agreement_of_one(spark, d):
    pairs = reports.review_pairs(ad.human_reviews(spark, d), ad.replay_results(spark, d), ad.eval_scores(spark, d), "a3")
    return rounded(reports.agreement(pairs), "agreement", "kappa", "false_pass_rate", "false_fail_rate")


@query("""SELECT count(*) AS n, round(avg((quality = 1 AND toxic = 0 OR quality = 0 AND toxic = 1)::INT), 6) AS agreement FROM labels""", plain=True)
def label_agreement(spark, d):
    pairs = ad.load(spark, d, "labels").select((F.col("quality") == 1).alias("judge"), (F.col("toxic") == 0).alias("human"))
    return rounded(reports.agreement(pairs).select("n", "agreement"), "agreement")


_QUEUE = """eligible AS (
  SELECT r.* FROM replay_results r WHERE r.grader <> 'chain' AND r.id NOT IN (SELECT replay_result_id FROM human_reviews)
    AND EXISTS (SELECT 1 FROM eval_scores e WHERE e.replay_result_id = r.id AND e.scorer = 'judge')
    AND NOT EXISTS (SELECT 1 FROM eval_scores e WHERE e.replay_result_id = r.id AND e.scorer <> 'judge' AND NOT e.passed)
), there AS (
  SELECT r.archetype_id, count(*) AS n FROM human_reviews h JOIN replay_results r ON h.replay_result_id = r.id WHERE r.ts >= 1706500000000 GROUP BY 1
)"""


@query(_QUEUE + """ SELECT id, archetype_id FROM (
  SELECT e.id, e.archetype_id, row_number() OVER (PARTITION BY e.archetype_id ORDER BY e.ts DESC, e.id DESC) + coalesce(t.n, 0) AS k FROM eligible e LEFT JOIN there t USING (archetype_id)) WHERE k <= 40""")
def review_enqueue(spark, d):
    results, reviews = ad.replay_results(spark, d), ad.human_reviews(spark, d)
    queued = reviews.join(results, F.col("replay_result_id") == F.col("id")).where("ts >= 1706500000000")
    return windows.capped_queue(reports.reviewable(results, reviews, ad.eval_scores(spark, d)), queued, 40).select("id", "archetype_id")


@query("""SELECT h.replay_result_id, r.archetype_id, coalesce(a.label, r.archetype_id) AS label, r.candidate, e.passed AS judge_passed, t.prompt_text, h.queued_ts
FROM human_reviews h JOIN replay_results r ON h.replay_result_id = r.id JOIN eval_scores e ON e.replay_result_id = r.id AND e.scorer = 'judge' LEFT JOIN traces t ON t.id = r.source_trace_id LEFT JOIN archetypes a ON a.id = r.archetype_id WHERE h.human_verdict IS NULL""")
def review_pending(spark, d):
    return reports.pending_reviews(ad.human_reviews(spark, d), ad.replay_results(spark, d), ad.eval_scores(spark, d), ad.traces(spark, d), ad.archetypes(spark, d))


@query("""SELECT e.archetype_id, candidate, scorer, coalesce(a.label, e.archetype_id) AS label, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_rate
FROM eval_scores e LEFT JOIN archetypes a ON e.archetype_id = a.id GROUP BY 1, 2, 3, 4""")
def scorer_summary(spark, d):
    return rounded(reports.scorer_summary(ad.eval_scores(spark, d), ad.archetypes(spark, d)), "mean_value", "pass_rate")


@query(f"""targets AS (SELECT * FROM (VALUES ('click', 0.9), ('view', 0.95), ('purchase', 1.0), ('nothing', 0.9)) v(objective, target)),
sums AS (SELECT objective, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok FROM slo_evaluations WHERE ts BETWEEN {NOW - 28 * DAY} AND {NOW} GROUP BY 1)
SELECT t.objective, t.target::DOUBLE AS target, coalesce(n, 0) AS n, coalesce(n_ok, 0) AS n_ok, round(n_ok::DOUBLE / n, 6) AS attainment,
  round(CASE WHEN n IS NULL THEN NULL WHEN target >= 1 THEN CASE WHEN n_ok = n THEN 1.0 ELSE 0.0 END ELSE 1 - (1 - n_ok::DOUBLE / n) / (1 - target::DOUBLE) END, 6) AS budget_left FROM targets t LEFT JOIN sums s USING (objective)""")
def slo_compliance(spark, d):
    targets = spark.createDataFrame([("click", 0.9), ("view", 0.95), ("purchase", 1.0), ("nothing", 0.9)], "objective string, target double")
    return rounded(reports.compliance(ad.slo_evaluations(spark, d), targets, NOW), "attainment", "budget_left")


@query("""vals AS (SELECT event_type AS sli, avg(value) AS value FROM events GROUP BY 1), rules AS (SELECT * FROM (VALUES ('r1', 'click', '<=', 40.0), ('r2', 'view', '<', 60.0), ('r3', 'purchase', '>=', 45.0), ('r4', 'error', '>', 100.0), ('r5', 'missing', '==', 0.0)) v(name, sli, op, threshold))
SELECT name, r.sli, op, threshold::DOUBLE AS threshold, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'no_data' WHEN CASE op WHEN '<=' THEN value <= threshold WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold WHEN '>' THEN value > threshold ELSE value = threshold END THEN 'ok' ELSE 'breach' END AS status
FROM rules r LEFT JOIN vals v ON r.sli = v.sli""")
def slo_evaluate(spark, d):
    rules = spark.createDataFrame([("r1", "click", "<=", 40.0), ("r2", "view", "<", 60.0), ("r3", "purchase", ">=", 45.0), ("r4", "error", ">", 100.0), ("r5", "missing", "==", 0.0)], "name string, sli string, op string, threshold double")
    values = ad.load(spark, d, "events").groupBy(F.col("event_type").alias("sli")).agg(F.avg("value").alias("value"))
    return rounded(reports.evaluate(rules, values), "value")


@query("""known AS (SELECT *, lag(status) OVER (PARTITION BY objective ORDER BY ts, id) AS before FROM slo_evaluations WHERE status IN ('ok', 'breach'))
SELECT id, objective, ts FROM known WHERE status = 'breach' AND coalesce(before, 'ok') <> 'breach'""")
def alert_transitions(spark, d):
    return windows.alerts(ad.slo_evaluations(spark, d)).select("id", "objective", "ts")


@query("""SELECT event_type, count(*) AS n, ordered[round_even(0.5 * (n_all - 1), 0)::INT + 1] AS p50, ordered[round_even(0.9 * (n_all - 1), 0)::INT + 1] AS p90, ordered[round_even(0.99 * (n_all - 1), 0)::INT + 1] AS p99
FROM (SELECT event_type, list(value ORDER BY value) AS ordered, count(*) AS n_all FROM events GROUP BY 1), (SELECT 1) GROUP BY event_type, ordered, n_all""".replace("count(*) AS n,", "n_all AS n,", 1), plain=True)
def metric_percentiles(spark, d):
    return prefix.percentiles(ad.load(spark, d, "events"), ["event_type"], "value", {f"p{round(100 * p)}": p for p in (0.5, 0.9, 0.99)})


@query("""SELECT (SELECT count(*) FROM traces) AS traces, (SELECT count(*) FROM traces WHERE quarantined) AS quarantined, (SELECT count(*) FROM assignments) AS assigned, (SELECT count(*) FROM archetypes WHERE merged_into IS NULL) AS archetypes,
  greatest(0, (SELECT count(*) FROM traces) - (SELECT count(*) FROM assignments)) AS unassigned""")
def summary(spark, d):
    return reports.summary(ad.traces(spark, d), ad.assignments(spark, d), ad.archetypes(spark, d))


@query("SELECT coalesce(tool, 'unknown') AS tool, count(*) AS n FROM traces GROUP BY 1")
def traces_by_tool(spark, d):
    return ad.traces(spark, d).groupBy(F.coalesce("tool", F.lit("unknown")).alias("tool")).agg(F.count("*").alias("n"))


@query("SELECT model, count(*) AS n FROM traces GROUP BY 1 ORDER BY n DESC, model LIMIT 10")
def top_models(spark, d):
    return ad.traces(spark, d).groupBy("model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model").limit(10)


@query("SELECT source, count(*) AS n, max(ts) AS last_ts FROM traces GROUP BY 1")
def traces_by_source(spark, d):
    return ad.traces(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("SELECT label, count(*) AS n FROM assignments s JOIN archetypes a ON s.archetype_id = a.id GROUP BY 1")
def counts_by_label(spark, d):
    return ad.assignments(spark, d).join(ad.archetypes(spark, d), F.col("archetype_id") == F.col("id")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT a.id, label, pinned, count(s.trace_id) AS n FROM archetypes a LEFT JOIN assignments s ON s.archetype_id = a.id WHERE merged_into IS NULL GROUP BY 1, 2, 3")
def archetype_counts(spark, d):
    return reports.archetype_counts(ad.archetypes(spark, d), ad.assignments(spark, d))


@query("SELECT t.id, ts, model, tokens_in, tokens_out, latency_ms, cost_usd FROM traces t JOIN assignments s ON t.id = s.trace_id WHERE s.archetype_id = 'a2' ORDER BY ts DESC, t.id LIMIT 50")
def trace_drilldown(spark, d):
    return reports.drill_down(ad.traces(spark, d), ad.assignments(spark, d), "a2").select("id", "ts", "model", "tokens_in", "tokens_out", "latency_ms", "cost_usd")


@query("SELECT id, ts, source, model, prompt_text, response_text FROM traces WHERE id = 't1001' OR id = 't3001'")
def trace_by_id(spark, d):
    return ad.traces(spark, d).where(F.col("id").isin("t1001", "t3001")).select("id", "ts", "source", "model", "prompt_text", "response_text")


@query("SELECT r.id, a.label, r.archetype_id, candidate, value, expires_ts FROM recommendations r JOIN archetypes a ON r.archetype_id = a.id")
def recommendation_list(spark, d):
    names = ad.archetypes(spark, d).select(F.col("id").alias("archetype_id"), "label")
    return ad.recommendations(spark, d).join(names, "archetype_id").select("id", "label", "archetype_id", "candidate", "value", "expires_ts")


@query(f"""SELECT p.id, p.archetype_id, p.candidate FROM applied_policies p WHERE reverted_ts IS NULL AND NOT EXISTS (SELECT 1 FROM recommendations r WHERE r.archetype_id = p.archetype_id AND r.candidate = p.candidate AND r.expires_ts > {NOW})""")
def expired_policies(spark, d):
    return reports.expired_policies(ad.applied_policies(spark, d), ad.recommendations(spark, d), NOW).select("id", "archetype_id", "candidate")


@query(f"SELECT count(*) AS n FROM applied_policies WHERE reverted_ts >= {NOW - 7 * DAY}")
def reverted_recently(spark, d):
    return ad.applied_policies(spark, d).where(F.col("reverted_ts") >= NOW - 7 * DAY).agg(F.count("*").alias("n"))


# --- replay ----------------------------------------------------------------------------------------------------------

_SPRT = f"""outcomes AS (SELECT archetype_id, candidate, run_id, ts, event_id, verdict = 'pass' AS passed FROM replay_results WHERE grader <> 'chain'),
run AS (
  SELECT *, row_number() OVER w AS n, sum(CASE WHEN passed THEN {math.log(0.9 / 0.8)!r} ELSE {math.log((1 - 0.9) / (1 - 0.8))!r} END::DOUBLE) OVER (w ROWS UNBOUNDED PRECEDING) AS llr, sum(passed::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS k
  FROM outcomes WINDOW w AS (PARTITION BY archetype_id, candidate, run_id ORDER BY ts, event_id)
), states AS (
  SELECT *, CASE WHEN llr >= {math.log(0.95 / 0.05)!r} THEN 'pass' WHEN llr <= {math.log(0.05 / 0.95)!r} THEN 'fail' ELSE 'inconclusive' END AS state FROM run
), stops AS (
  SELECT archetype_id, candidate, run_id, coalesce(min(n) FILTER (WHERE state <> 'inconclusive'), max(n)) AS stop FROM states GROUP BY 1, 2, 3
), verdicts AS (
  SELECT s.archetype_id, s.candidate, s.run_id, state, n::INT AS n_samples, k::INT AS n_pass, llr AS log_likelihood_ratio, CASE s.run_id WHEN 'run0' THEN 1 ELSE 2 END AS ts FROM states s JOIN stops t ON s.archetype_id = t.archetype_id AND s.candidate = t.candidate AND s.run_id = t.run_id AND s.n = t.stop
)"""


def _verdicts(spark, d) -> DataFrame:
    rows = ad.replay_results(spark, d).where("grader <> 'chain'").withColumn("passed", F.col("verdict") == "pass")
    done = prefix.sprt(rows, ["archetype_id", "candidate", "run_id"], ["ts", "event_id"])
    return done.withColumn("ts", F.when(F.col("run_id") == "run0", F.lit(1)).otherwise(2))


@query(_SPRT + " SELECT archetype_id, candidate, run_id, state, n_samples, n_pass, round(log_likelihood_ratio, 6) AS log_likelihood_ratio FROM verdicts")
def sprt_verdicts(spark, d):
    return rounded(_verdicts(spark, d).drop("ts"), "log_likelihood_ratio")


@query(_SPRT + " SELECT archetype_id, candidate, run_id, state FROM verdicts v WHERE ts = (SELECT max(ts) FROM verdicts w WHERE w.archetype_id = v.archetype_id AND w.candidate = v.candidate)")
def latest_verdict(spark, d):
    return windows.latest(_verdicts(spark, d), ["archetype_id", "candidate"]).select("archetype_id", "candidate", "run_id", "state")


@query("SELECT s.archetype_id, sum(coalesce(tokens_in, 0) + coalesce(tokens_out, 0))::BIGINT AS tokens, round(least(100, sum(coalesce(tokens_in, 0) + coalesce(tokens_out, 0)) * 100.0 / 50000), 6) AS quota_percent FROM traces t JOIN assignments s ON t.id = s.trace_id GROUP BY 1")
def recommendations_quota(spark, d):
    return rounded(reports.quota_percent(ad.traces(spark, d), ad.assignments(spark, d), 50_000), "quota_percent")


_USD = """front AS (SELECT s.archetype_id, avg(cost_usd) AS frontier, count(*) AS calls FROM traces t JOIN assignments s ON t.id = s.trace_id WHERE cost_usd IS NOT NULL GROUP BY 1),
cand AS (SELECT archetype_id, candidate, avg(cost_usd) AS replayed FROM replay_results GROUP BY 1, 2),
usd AS (SELECT c.archetype_id, candidate, calls, greatest(0, (coalesce(frontier, 0) - coalesce(replayed, 0)) * coalesce(calls, 0)) AS usd_value FROM cand c LEFT JOIN front f ON c.archetype_id = f.archetype_id)"""


@query(_USD + " SELECT archetype_id, candidate, round(usd_value, 6) AS usd_value FROM usd")
def recommendations_usd(spark, d):
    return rounded(reports.usd_value(ad.traces(spark, d), ad.assignments(spark, d), ad.replay_results(spark, d)).select("archetype_id", "candidate", "usd_value"), "usd_value")


@query(_SPRT + "," + _USD + f""", passing AS (SELECT * FROM verdicts v WHERE ts = (SELECT max(ts) FROM verdicts w WHERE w.archetype_id = v.archetype_id AND w.candidate = v.candidate) AND state = 'pass'),
fresh AS (SELECT *, n_pass::DOUBLE / n_samples AS p FROM passing v WHERE NOT EXISTS (SELECT 1 FROM recommendations r WHERE r.archetype_id = v.archetype_id AND r.candidate = v.candidate AND r.expires_ts > {NOW})),
quota AS (SELECT s.archetype_id, least(100, sum(coalesce(tokens_in, 0) + coalesce(tokens_out, 0)) * 100.0 / 50000) AS q FROM traces t JOIN assignments s ON t.id = s.trace_id GROUP BY 1)
SELECT f.archetype_id, f.candidate, CASE WHEN coalesce(calls, 0) > 0 THEN 'usd' ELSE 'quota' END AS currency, round(CASE WHEN coalesce(calls, 0) > 0 THEN coalesce(usd_value, 0) ELSE coalesce(q, 0) END, 6) AS value,
  round(p, 6) AS pass_rate, round({_LOW('p', 'n_samples')}, 6) AS pass_rate_ci_low, round({_HIGH('p', 'n_samples')}, 6) AS pass_rate_ci_high, {NOW} AS created_ts, {NOW + 45 * DAY} AS expires_ts
FROM fresh f LEFT JOIN usd u ON u.archetype_id = f.archetype_id AND u.candidate = f.candidate LEFT JOIN quota q ON q.archetype_id = f.archetype_id""")
def recommendations_new(spark, d):
    t, s, r = ad.traces(spark, d), ad.assignments(spark, d), ad.replay_results(spark, d)
    done = reports.recommend(_verdicts(spark, d), ad.recommendations(spark, d), reports.quota_percent(t, s, 50_000), reports.usd_value(t, s, r), NOW)
    return rounded(done, "value", "pass_rate", "pass_rate_ci_low", "pass_rate_ci_high")


@query("""last AS (SELECT *, row_number() OVER (PARTITION BY archetype_id, candidate ORDER BY ts DESC, id DESC) AS k FROM spot_checks)
SELECT archetype_id, candidate, count(*) AS n, round(avg((result = 'pass')::INT), 6) AS pass_rate, count(*) = 20 AND avg((result = 'pass')::INT) < 0.8 AS breached FROM last WHERE k <= 20 GROUP BY 1, 2""")
def regression_window(spark, d):
    return rounded(windows.regressions(ad.spot_checks(spark, d), 20, 0.8), "pass_rate")


_POOL = """pool AS (SELECT t.*, s.archetype_id FROM traces t JOIN assignments s ON t.id = s.trace_id JOIN archetypes a ON s.archetype_id = a.id AND a.merged_into IS NULL WHERE NOT quarantined)"""


def _pool(spark, d) -> DataFrame:
    return reports.assigned_traces(ad.traces(spark, d).where("NOT quarantined"), ad.assignments(spark, d), ad.archetypes(spark, d))


@query(_POOL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY archetype_id ORDER BY ts DESC, id) AS newest FROM pool),
drawn AS (SELECT *, row_number() OVER (PARTITION BY archetype_id ORDER BY md5('7:' || archetype_id || ':' || id), id) AS draw FROM ranked WHERE newest > 5)
SELECT archetype_id, id, 'recent' AS pick FROM ranked WHERE newest <= 5 UNION ALL SELECT archetype_id, id, 'random' FROM drawn WHERE draw <= 5""")
def seeded_sample(spark, d):
    return windows.stratified_sample(_pool(spark, d), 10, "7").select("archetype_id", "id", "pick")


@query(_POOL + """, sized AS (SELECT *, count(*) OVER (PARTITION BY archetype_id, session_id) AS size, row_number() OVER (PARTITION BY archetype_id, session_id ORDER BY ts, id) AS step FROM pool WHERE session_id IS NOT NULL),
drawn AS (SELECT *, dense_rank() OVER (PARTITION BY archetype_id ORDER BY md5('7:' || archetype_id || ':' || session_id), session_id) AS chain FROM sized WHERE size >= 2)
SELECT archetype_id, session_id, id, step, chain FROM drawn WHERE chain <= 3 AND step <= 4""")
def chain_sample(spark, d):
    return windows.chain_sample(_pool(spark, d), 3, 4, "7").select("archetype_id", "session_id", "id", "step", "chain")


@query("SELECT s.archetype_id, count(*) AS n FROM assignments s JOIN archetypes a ON s.archetype_id = a.id WHERE merged_into IS NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def top_archetypes(spark, d):
    names = reports.active(ad.archetypes(spark, d)).select(F.col("id").alias("archetype_id"))
    return ad.assignments(spark, d).join(names, "archetype_id").groupBy("archetype_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "archetype_id").limit(5)


_LADDER = [("local-small", True, 0.0, 0.0, 0), ("mid", False, 0.5, 1.5, 1), ("cheap", False, 0.2, 0.6, 2), ("tie", False, 0.6, 1.4, 3)]


@query("""ladder AS (SELECT * FROM (VALUES ('local-small'), ('mid'), ('cheap'), ('tie')) v(candidate))
SELECT t.id, ladder.candidate FROM traces t CROSS JOIN ladder WHERE NOT EXISTS (SELECT 1 FROM replay_results r WHERE r.source_trace_id = t.id AND ladder.candidate = CASE r.candidate WHEN 'c0' THEN 'mid' WHEN 'c1' THEN 'cheap' ELSE 'tie' END)""")
def worklist(spark, d):
    ladder = spark.createDataFrame([(x[0],) for x in _LADDER], "candidate string")
    done = ad.replay_results(spark, d).select(F.col("source_trace_id").alias("id"), F.when(F.col("candidate") == "c0", "mid").when(F.col("candidate") == "c1", "cheap").otherwise("tie").alias("candidate"))
    return ad.traces(spark, d).select("id").crossJoin(F.broadcast(ladder)).join(done, ["id", "candidate"], "left_anti")  # the ladder is four rows


@query("SELECT name, row_number() OVER (ORDER BY local DESC, (price_in + price_out) / 2, position) AS place FROM candidates")
def candidate_order(spark, d):
    """Candidates as they are tried: local ones first, then by mean price, in the order given where that is equal."""
    rows = ad.candidates(spark, d).selectExpr("name", "NOT local AS remote", "(price_in + price_out) / 2 AS price", "position")
    return prefix.numbered(rows, ["remote", "price", "position"], "place").select("name", "place")


# what is left of a budget over the whole work list, which has no groups
@query("""before AS (SELECT *, coalesce(sum(cost_usd) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM replay_results)
SELECT id, round(b + cost_usd, 6) AS spent FROM before WHERE b < (SELECT sum(cost_usd) / 3 FROM replay_results)""")
def run_budget(spark, d):
    rows = ad.replay_results(spark, d)
    third = rows.agg(F.sum("cost_usd") / 3).first()[0] or 0.0
    return rounded(prefix.within_budget(rows, third, ["ts", "event_id"]).select("id", "spent"), "spent")


@query("""before AS (SELECT *, coalesce(sum(cost_usd) OVER (PARTITION BY archetype_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM replay_results)
SELECT archetype_id, id, round(b + cost_usd, 6) AS spent FROM before WHERE b < 2.0""")
def budget_cap(spark, d):
    return rounded(prefix.within_budget(ad.replay_results(spark, d), 2.0, ["ts", "event_id"], ["archetype_id"]).select("archetype_id", "id", "spent"), "spent")


@query("""before AS (SELECT *, coalesce(sum(cost_usd) OVER (PARTITION BY source_trace_id, candidate ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM replay_results)
SELECT id, round(b + cost_usd, 6) AS spent FROM before WHERE b < 0.1""")
def chain_budget(spark, d):
    return rounded(prefix.within_budget(ad.replay_results(spark, d), 0.1, ["ts", "event_id"], ["source_trace_id", "candidate"]).select("id", "spent"), "spent")


@query("""SELECT event_id, event_type AS model, CASE event_type WHEN 'view' THEN 0.0 WHEN 'click' THEN round(value / 1e6 * 3.0 + value * 2 / 1e6 * 15.0, 9) WHEN 'error' THEN round(value / 1e6 * 0.5 + value * 2 / 1e6 * 1.5, 9) END AS cost
FROM events""", plain=True)
def call_cost(spark, d):
    prices = spark.createDataFrame([("view", True, 9.0, 9.0), ("click", False, 3.0, 15.0), ("error", False, 0.5, 1.5)], "model string, local boolean, price_in double, price_out double")
    calls = ad.load(spark, d, "events").select("event_id", F.col("event_type").alias("model"), F.col("value").alias("tokens_in"), (F.col("value") * 2).alias("tokens_out"))
    return cost.priced(calls, prices).select("event_id", "model", F.round("cost_usd", 9).alias("cost"))


# --- ingest ----------------------------------------------------------------------------------------------------------

@query("SELECT id, session_id, lag(id) OVER (PARTITION BY session_id ORDER BY conv_id, turn) AS parent_id, prompt_text FROM traces")
def trace_pairing(spark, d):
    return windows.with_parent(ad.traces(spark, d), "session_id", ["conv_id", "turn"]).select("id", "session_id", "parent_id", "prompt_text")


@query("""rows AS (SELECT event_id, event_type AS source, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 997)::VARCHAR END AS ingest_key FROM events)
SELECT event_id, source, ingest_key FROM (SELECT *, row_number() OVER (PARTITION BY source, ingest_key ORDER BY event_id) AS k FROM rows) WHERE ingest_key IS NULL OR k = 1""")
def ingest_dedup(spark, d):
    rows = ad.load(spark, d, "events").select("event_id", F.col("event_type").alias("source"), F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 997).cast("string")).alias("ingest_key"))
    return windows.first_writer(rows, ["source", "ingest_key"], ["event_id"])


@query("SELECT t.id, t.ts FROM traces t WHERE t.id NOT IN (SELECT id FROM traces WHERE conv_id % 3 = 1)")
def sync_new_rows(spark, d):
    from tracelake.sources.sync import new_rows

    rows = ad.traces(spark, d)
    return new_rows(rows, rows.where("conv_id % 3 = 1")).select("id", "ts")


@query("SELECT event_id, 'tokens.' || event_type AS metric, ms AS ts_ms, ((props::JSON)->>'k')::DOUBLE AS value FROM ev WHERE (props::JSON)->>'k' IS NOT NULL")
def otlp_points(spark, d):
    from tracelake.sources.otlp import points

    dot = "to_json(named_struct('resourceMetrics', array(named_struct('scopeMetrics', array(named_struct('metrics', array(named_struct('name', concat('tokens.', event_type), 'sum', named_struct('dataPoints', array(named_struct('asInt', get_json_object(props, '$.k'), 'timeUnixNano', concat(cast(ms AS string), '000000'), 'attributes', array(named_struct('key', 'event', 'value', named_struct('stringValue', cast(event_id AS string)))))))))))))))"
    payloads = ad.events(spark, d).selectExpr(f"{dot} AS payload")
    return points(payloads).select(F.col("attributes")["event"].cast("bigint").alias("event_id"), "metric", "ts_ms", "value")


@query("SELECT event_type, round(CASE WHEN o <= 0 THEN CASE WHEN t = 0 THEN 1.0 ELSE 0.0 END ELSE least(t / o, 1.0) END, 6) AS completeness FROM (SELECT event_type, sum(CASE WHEN event_id % 3 > 0 THEN value ELSE 0 END) AS t, sum(value) AS o FROM events GROUP BY 1)", plain=True)
def completeness(spark, d):
    from tracelake.sources.otlp import completeness as share

    rows = ad.load(spark, d, "events").groupBy("event_type").agg(F.sum(F.when(F.col("event_id") % 3 > 0, F.col("value")).otherwise(0.0)).alias("t"), F.sum("value").alias("o"))
    return rows.select("event_type", F.round(share(F.col("t"), F.col("o")), 6).alias("completeness"))


# --- text ------------------------------------------------------------------------------------------------------------

@query("SELECT conv_id, turn, text AS prompt_text FROM conversations WHERE role = 'user'", plain=True)
def prompt_text(spark, d):
    rows = ad.load(spark, d, "conversations").where("role = 'user'")
    raw = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))))
    return rows.select("conv_id", "turn", messages.prompt_text_udf(raw).alias("prompt_text"))


@query("SELECT conv_id, turn, text || chr(10) || '[tool result] ok' AS message_text FROM conversations WHERE text <> ''", plain=True)
def message_text(spark, d):
    rows = ad.load(spark, d, "conversations").where("text <> ''")
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("content")), F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("ok").alias("content"))))
    return rows.select("conv_id", "turn", messages.content_text_udf(block).alias("message_text"))


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _scrubbing() -> str:
    """Steps s0 to s10: the text after each pattern, with a column that tells whether the pattern met what the ones before left."""
    steps = ["s0 AS (SELECT doc_id, text, text AS s, '' AS flags FROM documents)"]
    for i, (name, pattern) in enumerate(tx.SECRETS.items()):
        steps.append(f"s{i + 1} AS (SELECT doc_id, text, regexp_replace(s, {_literal(pattern)}, '[REDACTED:{name}]', 'g') AS s, flags || CASE WHEN regexp_matches(s, {_literal(pattern)}) THEN ',{name}' ELSE '' END AS flags FROM s{i})")
    return "WITH " + ", ".join(steps)


@query(_scrubbing() + " SELECT doc_id, s <> text AS changed, sha256(s) AS scrubbed_sha256 FROM s10", plain=True)
def redact_scrub(spark, d):
    rows = ad.load(spark, d, "documents").withColumn("s", tx.scrub(F.col("text")))
    return rows.select("doc_id", (F.col("s") != F.col("text")).alias("changed"), F.sha2("s", 256).alias("scrubbed_sha256"))


@query(_scrubbing() + " SELECT doc_id, coalesce(flags[2:], '') AS flags FROM s10", plain=True)
def redact_flags(spark, d):
    return ad.load(spark, d, "documents").select("doc_id", F.array_join(tx.secret_flags(F.col("text")), ",").alias("flags"))


@query("""WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_\\-]{20,}')) AS token FROM documents)
SELECT doc_id, token, round(list_sum([-(c::DOUBLE) / length(token) * log2(c::DOUBLE / length(token)) FOR c IN map_values(histogram_of)]), 6) AS bits FROM (SELECT doc_id, token, (SELECT histogram(ch) FROM (SELECT unnest(string_split(token, '')) AS ch)) AS histogram_of FROM tokens)""", plain=True)
def entropy_scan(spark, d):
    rows = ad.load(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(tx.LONG_TOKEN), F.lit(0))).alias("token"))
    return rows.select("doc_id", "token", F.round(tx.entropy(F.col("token")), 6).alias("bits"))


# long tokens that scrubbing left, no pattern knows, and whose characters are spread enough
@query(_scrubbing() + f""", tokens AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(s, {_literal(tx.LONG_TOKEN)}))) AS token FROM s10),
chars AS (SELECT doc_id, token, count(*) AS c FROM (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM tokens WHERE NOT ({" OR ".join(f"regexp_matches(token, {_literal(p)})" for p in tx.SECRETS.values())})) GROUP BY doc_id, token, ch),
bits AS (SELECT doc_id, token, sum(-(c::DOUBLE / length(token)) * log2(c::DOUBLE / length(token))) AS h FROM chars GROUP BY 1, 2)
SELECT count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM bits WHERE h >= {tx.ENTROPY_LIMIT})) AS quarantined FROM documents""", plain=True)
def quarantine_rate(spark, d):
    rows = tx.redacted(ad.load(spark, d, "documents").select("text"), "text", "r")
    return rows.agg(F.count("*").alias("n"), F.count_if("r.quarantined").alias("quarantined"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents", plain=True)
def tokens_per_doc(spark, d):
    return ad.load(spark, d, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("bigint").alias("n"))


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN n_chars <= 0 THEN 'unknown' WHEN n_chars = 1 THEN '<=1' ELSE '<=' || (1::BIGINT << length(bin(n_chars - 1))) END AS bucket FROM documents) GROUP BY 1", plain=True)
def length_buckets(spark, d):
    return ad.load(spark, d, "documents").groupBy(stats.length_bucket(F.col("n_chars")).alias("bucket")).agg(F.count("*").alias("n"))


_EMBED = """tokens AS (SELECT conv_id * 1000 + turn AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM conversations WHERE role = 'user'),
counts AS (SELECT id, ('0x' || right(md5(token), 2))::INT AS bucket, count(*) AS n FROM tokens GROUP BY 1, 2),
vectors AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM counts)"""


def _vectors(spark, d) -> DataFrame:
    rows = ad.load(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return mining.hash_embedding(rows)


@query(f"WITH {_EMBED} SELECT id, bucket, round(weight, 6) AS weight FROM vectors", plain=True)
def hash_embedding(spark, d):
    return rounded(_vectors(spark, d), "weight")


@query(f"""WITH {_EMBED.split("counts AS")[0]}
parts AS (SELECT id, md5(token) AS h FROM tokens), counts AS (SELECT id, ((('0x' || h[1:8])::UBIGINT::UHUGEINT * 79228162514264337593543950336 + ('0x' || h[9:16])::UBIGINT::UHUGEINT * 18446744073709551616 + ('0x' || h[17:24])::UBIGINT::UHUGEINT * 4294967296 + ('0x' || h[25:32])::UBIGINT::UHUGEINT) % 300)::INT AS bucket, count(*) AS n FROM parts GROUP BY 1, 2)
SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS weight FROM counts""", plain=True)
def hash_embedding_wide(spark, d):
    rows = ad.load(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rounded(mining.hash_embedding(rows, 300), "weight")


@query(f"WITH {_EMBED} SELECT a.id AS a, b.id AS b, round(sum(a.weight * b.weight), 6) AS similarity FROM vectors a JOIN vectors b ON a.bucket = b.bucket AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.weight * b.weight) >= 0.8", plain=True)
def similar_prompts(spark, d):
    return rounded(similarity.similar_pairs(_vectors(spark, d), 0.8), "similarity")


_PAIRS = "pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35)"


def _embeddings(spark, d) -> DataFrame:
    return ad.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _dense(spark, d) -> DataFrame:
    return similarity.dense_pairs(_embeddings(spark, d), 0.35)


@query(f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs", plain=True)
def similar_pairs(spark, d):
    return rounded(_dense(spark, d), "similarity")


_COMPONENTS = f"""WITH RECURSIVE {_PAIRS}, links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a), comps AS (SELECT id, min(r) AS component FROM reach GROUP BY 1)"""


@query(_COMPONENTS + " SELECT id, component FROM comps", plain=True)
def components(spark, d):
    return mining.components(ad.load(spark, d, "embeddings").select(F.col("vec_id").alias("id")), similarity.dense_links(_embeddings(spark, d), 0.35))


@query(_COMPONENTS + " SELECT id, CASE WHEN count(*) OVER (PARTITION BY component) >= 3 THEN component ELSE -1 END AS cluster FROM comps", plain=True)
def noise_points(spark, d):
    return mining.clusters(components(spark, d))


@query()
def density_clusters(spark, d):
    return density.density_clusters(_embeddings(spark, d), 3, 0.2)


_MEMBERS = f"WITH {_EMBED}, members AS (SELECT DISTINCT id, (id // 1000) % 10 AS cluster FROM vectors), total AS (SELECT cluster, bucket, sum(weight) AS s FROM vectors JOIN members USING (id) GROUP BY 1, 2), scores AS (SELECT m.cluster, v.id, sum(weight * (s - weight)) AS score FROM vectors v JOIN members m ON v.id = m.id JOIN total t ON t.cluster = m.cluster AND t.bucket = v.bucket GROUP BY 1, 2), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, id) AS k FROM scores) WHERE k = 1)"


def _members(vectors: DataFrame) -> DataFrame:
    return vectors.select("id").distinct().withColumn("cluster", (F.floor(F.col("id") / 1000) % 10).cast("bigint"))


@query(_MEMBERS + " SELECT cluster, id, round(score, 6) AS score FROM best", plain=True)
def medoids(spark, d):
    v = _vectors(spark, d)
    return rounded(mining.medoids(v, _members(v)), "score")


@query(_MEMBERS + """ SELECT v.id, m.cluster, round(greatest(0.0, 1 - sum(v.weight * coalesce(c.weight, 0))), 6) AS distance FROM vectors v JOIN members m ON v.id = m.id JOIN best b ON b.cluster = m.cluster LEFT JOIN vectors c ON c.id = b.id AND c.bucket = v.bucket GROUP BY 1, 2""", plain=True)
def assignment_distance(spark, d):
    v = _vectors(spark, d)
    return rounded(mining.distances(v, _members(v), mining.medoids(v, _members(v))), "distance")


# cluster by cluster: each takes the best of what those before it left
@query("WITH RECURSIVE " + _MEMBERS.removeprefix("WITH ") + """, near AS (
  SELECT x.cluster, 'a' || y.cluster AS archetype_id, sum(v.weight * w.weight) AS similarity FROM best x JOIN vectors v ON v.id = x.id JOIN vectors w ON w.bucket = v.bucket JOIN best y ON y.id = w.id AND y.cluster % 2 = 0 GROUP BY 1, 2 HAVING sum(v.weight * w.weight) >= 0.75
), turns AS (
  SELECT row_number() OVER (ORDER BY cluster) AS k, cluster, list(archetype_id ORDER BY similarity DESC, archetype_id) AS wish FROM near GROUP BY cluster
), greedy AS (
  SELECT 0::BIGINT AS k, []::VARCHAR[] AS taken, NULL::BIGINT AS cluster, NULL::VARCHAR AS archetype_id
  UNION ALL
  SELECT t.k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, t.cluster, pick FROM (
    SELECT t.k, g.taken, t.cluster, list_filter(t.wish, lambda a: NOT list_contains(g.taken, a))[1] AS pick FROM greedy g JOIN turns t ON t.k = g.k + 1) t
)
SELECT cluster, archetype_id FROM greedy WHERE archetype_id IS NOT NULL""", plain=True)
def identity_match(spark, d):
    v = _vectors(spark, d)
    mid = mining.medoids(v, _members(v)).select("cluster", "id")
    a = mid.join(v, "id").select("cluster", "bucket", F.col("weight").alias("wa"))
    b = mid.where("cluster % 2 = 0").join(v, "id").select(F.concat(F.lit("a"), "cluster").alias("archetype_id"), "bucket", F.col("weight").alias("wb"))
    return mining.match_identities(a.join(b, "bucket").groupBy("cluster", "archetype_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity")))


@query("""WITH first AS (SELECT * FROM (SELECT lang AS cluster, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE lang IS NOT NULL) WHERE n <= 5),
each AS (SELECT cluster, n, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token, unnest(range(len(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS pos FROM first),
counts AS (SELECT cluster, token, count(*) AS c, min(n * 1000000 + pos) AS place FROM each WHERE length(token) > 2 AND token NOT IN (SELECT unnest(string_split('"""
       + " ".join(tx.STOP_WORDS) + """', ' '))) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, place) AS r FROM counts)
SELECT cluster, string_agg(upper(left(token, 1)) || substr(token, 2), ' ' ORDER BY r) AS label FROM top WHERE r <= 3 GROUP BY 1""", plain=True)
def keyword_labels(spark, d):
    rows = ad.load(spark, d, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("cluster"), F.col("doc_id").alias("id"), "text")
    return mining.keyword_labels(rows)


# --- scorers ---------------------------------------------------------------------------------------------------------

_CASES = """cases AS (SELECT id, prompt_text AS request, response_text AS reference, CASE WHEN conv_id % 6 = 0 THEN '' WHEN conv_id % 6 = 1 THEN 'Sorry, I cannot do that' WHEN conv_id % 6 = 2 THEN prompt_text WHEN conv_id % 6 = 3 THEN prompt_text || ' ' || response_text WHEN conv_id % 6 = 4 THEN replace(response_text, 'th', 'd') ELSE response_text END AS candidate FROM traces)"""


def _cases(spark, d) -> DataFrame:
    return ad.traces(spark, d).selectExpr("id", "prompt_text AS request", "response_text AS reference", "CASE WHEN conv_id % 6 = 0 THEN '' WHEN conv_id % 6 = 1 THEN 'Sorry, I cannot do that' WHEN conv_id % 6 = 2 THEN prompt_text WHEN conv_id % 6 = 3 THEN concat(prompt_text, ' ', response_text) WHEN conv_id % 6 = 4 THEN replace(response_text, 'th', 'd') ELSE response_text END AS candidate")


@query(_CASES + """ SELECT id, NOT (trim(candidate) = '' OR regexp_matches(left(candidate, 200), '(?i)^\\s*sorry\\b') AND NOT regexp_matches(left(reference, 200), '(?i)^\\s*sorry\\b')) AS passed FROM cases""")
def completion_check(spark, d):
    return _cases(spark, d).select("id", scorers.completion(F.col("candidate"), F.col("reference"), F.lit(0)).alias("passed"))


@query(_CASES + """, sets AS (SELECT id, list_distinct(regexp_extract_all(lower(reference), '[a-z0-9]+')) AS f, list_distinct(regexp_extract_all(lower(candidate), '[a-z0-9]+')) AS c FROM cases)
SELECT id, CASE WHEN len(f) = 0 THEN len(c) = 0 ELSE len(list_intersect(f, c))::DOUBLE / len(f) >= 0.5 END AS passed FROM sets""")
def heuristic_judge(spark, d):
    return _cases(spark, d).select("id", scorers.heuristic_judge(F.col("reference"), F.col("candidate")).alias("passed"))


# the answer's details are those of the patterns; without closing punctuation, two characters at least
@query("WITH pages AS (SELECT page_id, url, html, 'see ' || url || ' and page_' || page_id || '_x and 12.34 `code here`' AS candidate FROM pages), found AS (SELECT page_id, unnest("
       + " || ".join(f"regexp_extract_all(candidate, {_literal(p)}, {g})" for p, g in tx.SPECIFICS) + """) AS detail FROM pages),
clean AS (SELECT DISTINCT page_id, rtrim(trim(detail), '.,;:') AS detail FROM found WHERE length(rtrim(trim(detail), '.,;:')) >= 2),
counts AS (SELECT p.page_id, count(*) AS n, count(*) FILTER (WHERE NOT contains(lower(p.url || chr(10) || p.html), lower(c.detail))) AS missing FROM clean c JOIN pages p ON c.page_id = p.page_id GROUP BY 1)
SELECT p.page_id, round(CASE WHEN n >= 2 THEN 1 - missing::DOUBLE / n END, 6) AS value FROM pages p LEFT JOIN counts c ON p.page_id = c.page_id""", plain=True)
def grounding(spark, d):
    pages = ad.load(spark, d, "pages").selectExpr("page_id", "url AS request", "html AS reference", "concat('see ', url, ' and page_', cast(page_id AS string), '_x and 12.34 `code here`') AS candidate")
    return pages.select("page_id", F.round(scorers.grounding(F.col("candidate"), F.col("request"), F.col("reference")), 6).alias("value"))


@query()
def format_check(spark, d):
    rows = _cases(spark, d).withColumn("reference", F.when(F.length("reference") % 3 == 0, F.to_json(F.struct("id"))).otherwise(F.col("reference")))
    return rows.select("id", scorers.format_check(F.col("reference"), F.col("candidate")).alias("passed"))


# the table of the longest common subsequence row by row: a row is the running greatest of its place in the row before, one more
# than the place before that where the names are equal
@query(_CASES + """, seqs AS (
  SELECT id, regexp_extract_all(lower(reference), '[a-z0-9]+') AS r, regexp_extract_all(lower(candidate), '[a-z0-9]+') AS c FROM cases
), names AS (
  SELECT id, unnest(r) AS token, unnest(range(len(r))) + 1 AS i FROM seqs
), others AS (
  SELECT id, unnest(c) AS token, unnest(range(len(c))) + 1 AS j FROM seqs
), cells AS (
  SELECT id, 0::BIGINT AS i, j, 0::BIGINT AS v FROM others
  UNION ALL
  SELECT id, i, j, max(x) OVER (PARTITION BY id ORDER BY j) FROM (
    SELECT s.id, s.i + 1 AS i, s.j, CASE WHEN left(n.token, 2) = left(o.token, 2) THEN coalesce(lag(s.v) OVER (PARTITION BY s.id ORDER BY s.j), 0) + 1 ELSE s.v END AS x
    FROM cells s JOIN names n ON n.id = s.id AND n.i = s.i + 1 JOIN others o ON o.id = s.id AND o.j = s.j)
), lengths AS (
  SELECT s.id, max(v) AS n FROM cells s JOIN seqs q ON s.id = q.id AND s.i = len(q.r) GROUP BY 1
), same AS (
  SELECT n.id, avg((n.token = o.token)::INT) AS share FROM names n JOIN others o ON n.id = o.id AND n.i = o.j AND left(n.token, 2) = left(o.token, 2) GROUP BY 1
)
SELECT q.id, CASE WHEN len(r) + len(c) > 0 THEN round(0.7 * 2 * coalesce(n, 0) / (len(r) + len(c)) + 0.3 * coalesce(share, 0), 6) END AS value FROM seqs q LEFT JOIN lengths l ON q.id = l.id LEFT JOIN same s ON q.id = s.id""", recursive=True)
def trajectory(spark, d):
    calls = F.transform(tx.tokens(F.col("reference")), lambda t: F.struct(F.left(t, F.lit(2)).alias("name"), F.array(t).alias("input_keys")))
    other = F.transform(tx.tokens(F.col("candidate")), lambda t: F.struct(F.left(t, F.lit(2)).alias("name"), F.array(t).alias("input_keys")))
    told = _cases(spark, d).select("id", calls.alias("made"), other.alias("asked"))
    return told.select("id", F.round(scorers.trajectory(F.col("made"), F.col("asked")), 6).alias("value"))


@query()
def suite_grades(spark, d):
    return scorers.grade(_cases(spark, d)).select("id", "scorer", F.round("value", 6).alias("value"), "passed", "verdict")


@query("""SELECT event_id, round(value * CASE event_type WHEN 'view' THEN 1.0 ELSE 4.0 END / 1e6 + event_id % 50 * CASE event_type WHEN 'view' THEN 5.0 ELSE 20.0 END / 1e6, 9) AS cost_usd,
event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 = 0 AS passed, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 'judge_error:JudgeError' END AS detail FROM events""", plain=True)
def judge_verdicts(spark, d):
    prices = spark.createDataFrame([("view", False, 1.0, 5.0), ("click", False, 4.0, 20.0)], "model string, local boolean, price_in double, price_out double")
    said = "CASE WHEN event_id % 5 = 0 THEN 'unsure, it would passable' WHEN event_id % 3 = 0 THEN 'Not a FAIL: pass.' ELSE 'PASS? no, fail' END AS text"
    answers = ad.load(spark, d, "events").selectExpr("event_id", "event_type AS model", said, "CASE WHEN event_id % 7 = 0 THEN 'refusal' ELSE 'end_turn' END AS stop_reason", "value AS tokens_in", "event_id % 50 AS tokens_out")
    return scorers.judge_verdicts(answers, prices).select("event_id", F.round("cost_usd", 9).alias("cost_usd"), "passed", "detail")


@query("SELECT doc_id, length(coalesce(text, '')) BETWEEN 200 AND 2000 AS short, NOT contains(coalesce(text, ''), '@') AS plain, length(coalesce(text, '')) BETWEEN 200 AND 2000 AND (lang IS DISTINCT FROM 'en' OR NOT contains(coalesce(text, ''), '@')) AS all_pass FROM documents", plain=True)
def deterministic_checks(spark, d):
    rows = ad.load(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    checks = {"short": lambda t: tx.within_length(t, 200, 2000), "plain": lambda t: ~F.contains(t, F.lit("@"))}
    found = rows.select("doc_id", scorers.deterministic_checks(F.col("text"), checks, {"plain": F.col("lang").eqNullSafe("en")}).alias("v"))
    return found.select("doc_id", F.col("v")[0]["passed"].alias("short"), F.col("v")[1]["passed"].alias("plain"), scorers.all_pass(F.col("v")).alias("all_pass"))


@query("SELECT candidate, count(*) AS n, count(*) FILTER (WHERE verdict = 'pass') AS n_pass, round(avg(cost_usd), 6) AS mean_cost FROM replay_results WHERE grader <> 'chain' GROUP BY 1")
def pass_rates(spark, d):
    return rounded(ad.replay_results(spark, d).where("grader <> 'chain'").groupBy("candidate").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "pass").alias("n_pass"), F.avg("cost_usd").alias("mean_cost")), "mean_cost")


@query("""WITH ordered AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n, sum(value) AS s FROM events GROUP BY 1),
ranks AS (SELECT event_type, unnest([0.5, 0.9, 0.99]) AS q, v, n FROM ordered)
SELECT 'trace_event_value{type="' || event_type || '",quantile="' || q::DOUBLE || '"} ' || v[round_even(q::DOUBLE * (n - 1), 0)::INT + 1] AS line FROM ranks
UNION ALL SELECT 'trace_event_value_sum{type="' || event_type || '"} ' || round(s, 6) FROM ordered UNION ALL SELECT 'trace_event_value_count{type="' || event_type || '"} ' || n FROM ordered""", plain=True)
def prometheus_text(spark, d):
    from tracelake.operators.exposition import exposition

    rows = ad.load(spark, d, "events").select(F.lit("event.value").alias("name"), F.lit("histogram").alias("kind"), F.create_map(F.lit("type"), F.col("event_type")).alias("labels"), "value")
    return exposition(rows, "trace_")
