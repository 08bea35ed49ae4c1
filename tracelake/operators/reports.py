"""Monitoring reports: drift, data quality, performance, judge agreement, objectives, recommendations, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import stats
from tracelake.operators.windows import latest

DAY_MS = 86_400_000
OPERATORS = {"<=": lambda v, t: v <= t, "<": lambda v, t: v < t, ">=": lambda v, t: v >= t, ">": lambda v, t: v > t, "==": lambda v, t: v == t}


def active(archetypes: DataFrame) -> DataFrame:
    return archetypes.where("merged_into IS NULL")


def assigned_traces(traces: DataFrame, assignments: DataFrame, archetypes: DataFrame) -> DataFrame:
    """Traces with the active archetype they are assigned to; archetypes are few, so Spark may broadcast them."""
    labels = active(archetypes).select(F.col("id").alias("archetype_id"), "label")
    return traces.join(assignments, traces.id == assignments.trace_id).drop("trace_id").join(labels, "archetype_id")


def drift_keys(traces: DataFrame, assignments: DataFrame, archetypes: DataFrame, now_ms: int, recent_days: int = 7, base_days: int = 28) -> DataFrame:
    """(feature, key, recent, base): counts of archetype, model and length bucket in the two windows before now."""
    start, edge = now_ms - (recent_days + base_days) * DAY_MS, now_ms - recent_days * DAY_MS
    merged = archetypes.select(F.col("id").alias("a_id"), "merged_into")
    rows = traces.where((F.col("ts") >= start) & (F.col("ts") <= now_ms)).join(assignments.select("trace_id", "archetype_id"), F.col("id") == F.col("trace_id"), "left").join(merged, F.col("archetype_id") == F.col("a_id"), "left")
    keyed = rows.select(
        (F.col("ts") >= edge).alias("is_recent"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), k.alias("key")) for f, k in (("archetype", F.coalesce("merged_into", "a_id", F.lit("(unassigned)"))), ("model", F.col("model")), ("prompt_length", stats.length_bucket(F.col("tokens_in"))))])).alias("e"),
    )
    return keyed.groupBy("e.feature", "e.key").agg(F.count_if("is_recent").alias("recent"), F.count_if(~F.col("is_recent")).alias("base"))


def drift_report(keys: DataFrame, least: int = 30) -> DataFrame:
    """A row a feature: totals, PSI, Jensen-Shannon divergence, status."""
    w = Window.partitionBy("feature")
    shares = keys.withColumn("n_recent", F.sum("recent").over(w)).withColumn("n_base", F.sum("base").over(w))
    r, b = stats.ratio(F.col("recent"), F.col("n_recent")), stats.ratio(F.col("base"), F.col("n_base"))
    each = shares.groupBy("feature").agg(F.max("n_recent").alias("n_recent"), F.max("n_base").alias("n_base"), F.sum(stats.psi_term(r, b)).alias("psi"), F.sum(stats.js_term(r, b)).alias("js"))
    enough = (F.col("n_recent") >= least) & (F.col("n_base") >= least)
    status = F.when(~enough, "insufficient_data").when(F.col("psi") > 0.25, "significant").when(F.col("psi") > 0.1, "moderate").otherwise("stable")
    return each.select("feature", "n_recent", "n_base", F.when(enough, F.col("psi")).alias("psi"), F.when(enough, F.least(F.greatest("js", F.lit(0.0)), F.lit(1.0))).alias("js"), status.alias("status"))


def top_shifts(keys: DataFrame, k: int = 5) -> DataFrame:
    """The k keys of each feature whose share moved most, larger keys first among equals."""
    w = Window.partitionBy("feature")
    r, b = stats.ratio(F.col("recent"), F.sum("recent").over(w)), stats.ratio(F.col("base"), F.sum("base").over(w))
    moved = keys.withColumn("delta", F.round(F.coalesce(r, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)), 9))
    return moved.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.abs("delta")), F.desc("key")))).where(F.col("rank") <= k)


QUALITY_LIMITS = {"quarantined": 0.05, "missing_tokens": 0.02, "unknown_model": 0.01, "empty_response": 0.20, "unassigned": 0.20, "future_timestamp": 0.0}


def data_quality(traces: DataFrame, assignments: DataFrame, now_ms: int, days: int = 7, limits: dict = QUALITY_LIMITS) -> DataFrame:
    """(check, n, total, ratio, threshold, ok) over rows of the last days, later ones included; one pass.

    traces have ``empty_response``. Unassigned counts rows that aren't quarantined, and is null while there is no assignment.
    """
    rows = traces.where(F.col("ts") >= now_ms - days * DAY_MS).join(assignments.select("trace_id").distinct(), F.col("id") == F.col("trace_id"), "left")
    fresh = ~F.col("quarantined")
    parts = {
        "quarantined": (F.col("quarantined"), F.lit(True)),
        "missing_tokens": (F.col("tokens_in").isNull() | F.col("tokens_out").isNull(), F.lit(True)),
        "unknown_model": (F.col("model") == "unknown", F.lit(True)),
        "empty_response": (F.col("empty_response"), F.lit(True)),
        "unassigned": (fresh & F.col("trace_id").isNull(), fresh),
        "future_timestamp": (F.col("ts") > now_ms + 300_000, F.lit(True)),
    }
    sums = [F.count_if(x).alias(f"{k}_{i}") for k, pair in parts.items() for i, x in enumerate(pair)]
    return quality_checks(rows.agg(*sums), assignments, limits)


def quality_checks(sums: DataFrame, assignments: DataFrame, limits: dict) -> DataFrame:
    """A row a check from one row of sums, ``<check>_0`` being the rows found and ``<check>_1`` those looked at."""
    any_assigned = assignments.limit(1).agg((F.count("*") > 0).alias("any_assigned"))
    one = sums.crossJoin(F.broadcast(any_assigned))  # one row each
    cells = [F.struct(F.lit(k).alias("check"), F.col(f"{k}_0").alias("n"), F.col(f"{k}_1").alias("total"), F.lit(float(limits[k])).alias("threshold")) for k in limits]
    out = one.select("any_assigned", F.explode(F.array(*cells)).alias("c")).select("any_assigned", "c.*")
    share = F.when((F.col("check") == "unassigned") & ~F.col("any_assigned"), None).otherwise(stats.ratio(F.col("n"), F.col("total")))
    return out.select("check", "n", "total", share.alias("ratio"), "threshold").withColumn("ok", F.coalesce(F.col("ratio") <= F.col("threshold"), F.lit(True)))


def outcomes(results: DataFrame, checks: DataFrame) -> DataFrame:
    """Replay outcomes that aren't chains, and spot checks, which have no latency."""
    replays = results.where("grader <> 'chain'").select("archetype_id", "candidate", (F.col("verdict") == "pass").alias("passed"), "latency_ms", "ts")
    spots = checks.select("archetype_id", "candidate", (F.col("result") == "pass").alias("passed"), F.lit(None).cast("int").alias("latency_ms"), "ts")
    return replays.unionByName(spots)


def performance(results: DataFrame, checks: DataFrame, archetypes: DataFrame, now_ms: int, days: int = 7, least: int = 10) -> DataFrame:
    """A row an archetype and candidate: this window against the one before, with interval, z and whether it is worse."""
    edge, start = now_ms - days * DAY_MS, now_ms - 2 * days * DAY_MS
    recent = F.col("ts") >= edge
    rows = outcomes(results, checks).where((F.col("ts") >= start) & (F.col("ts") <= now_ms))
    sums = rows.groupBy("archetype_id", "candidate").agg(
        F.count_if(recent).alias("n_recent"), F.count_if(recent & F.col("passed")).alias("pass_recent"),
        F.count_if(~recent).alias("n_previous"), F.count_if(~recent & F.col("passed")).alias("pass_previous"),
        F.avg(F.when(recent, F.col("latency_ms"))).alias("latency_recent"), F.avg(F.when(~recent, F.col("latency_ms"))).alias("latency_previous"),
    )
    return performance_scores(sums, archetypes, least)


def performance_scores(sums: DataFrame, archetypes: DataFrame, least: int = 10) -> DataFrame:
    """Rates, intervals and z from the counts of both windows."""
    labels = archetypes.select(F.col("id").alias("archetype_id"), "label")
    named = sums.join(labels, "archetype_id", "left").withColumn("label", F.coalesce("label", "archetype_id"))
    low, high = stats.wilson(F.col("pass_recent"), F.col("n_recent"))
    z = stats.two_proportion_z(F.col("pass_recent"), F.col("n_recent"), F.col("pass_previous"), F.col("n_previous"))
    z = F.when((F.col("n_recent") >= least) & (F.col("n_previous") >= least), z)
    return named.withColumn("pass_rate", stats.ratio(F.col("pass_recent"), F.col("n_recent"))).withColumn("ci_low", low).withColumn("ci_high", high).withColumn("z", z).withColumn("degraded", F.coalesce(F.col("z") <= -1.645, F.lit(False)))


def agreement(pairs: DataFrame) -> DataFrame:
    """One row from rows (judge, human) of booleans: n, agreement, kappa, false pass and false fail rates."""
    j, h = F.col("judge"), F.col("human")
    one = pairs.agg(F.count_if(j & h).alias("both"), F.count_if(j & ~h).alias("only_judge"), F.count_if(~j & h).alias("only_human"), F.count_if(~j & ~h).alias("neither"))
    n = F.col("both") + F.col("only_judge") + F.col("only_human") + F.col("neither")
    cells = [F.col(c) for c in ("both", "only_judge", "only_human", "neither")]
    return one.select(n.alias("n"), stats.ratio(F.col("both") + F.col("neither"), n).alias("agreement"), stats.kappa(*cells).alias("kappa"), stats.ratio(F.col("only_judge"), F.col("only_judge") + F.col("neither")).alias("false_pass_rate"), stats.ratio(F.col("only_human"), F.col("only_human") + F.col("both")).alias("false_fail_rate"))


def review_pairs(reviews: DataFrame, results: DataFrame, scores: DataFrame, archetype: str | None = None) -> DataFrame:
    """(judge, human) of reviewed results, of one archetype if it is given."""
    results = results if archetype is None else results.where(F.col("archetype_id") == archetype)
    judged = scores.where("scorer = 'judge'").select("replay_result_id", F.col("passed").alias("judge"))
    done = reviews.where("human_verdict IS NOT NULL").select("replay_result_id", (F.col("human_verdict") == "pass").alias("human"))
    ids = results.select(F.col("id").alias("replay_result_id"))
    return done.join(ids, "replay_result_id").join(judged, "replay_result_id").select("judge", "human")


def reviewable(results: DataFrame, reviews: DataFrame, scores: DataFrame) -> DataFrame:
    """Results a judge has seen, that failed no rule-based scorer, are no chain and aren't queued."""
    judged = scores.where("scorer = 'judge'").select(F.col("replay_result_id").alias("id")).distinct()
    failed = scores.where("scorer <> 'judge' AND NOT passed").select(F.col("replay_result_id").alias("id"))
    queued = reviews.select(F.col("replay_result_id").alias("id"))
    return results.where("grader <> 'chain'").join(judged, "id", "left_semi").join(failed, "id", "left_anti").join(queued, "id", "left_anti")


def pending_reviews(reviews: DataFrame, results: DataFrame, scores: DataFrame, traces: DataFrame, archetypes: DataFrame) -> DataFrame:
    """The review queue, oldest first: results with the judge's score, prompt and label where they are known."""
    judged = scores.where("scorer = 'judge'").select("replay_result_id", F.col("passed").alias("judge_passed"))
    names = archetypes.select(F.col("id").alias("archetype_id"), "label")
    prompts = traces.select(F.col("id").alias("source_trace_id"), "prompt_text")
    queue = reviews.where("human_verdict IS NULL").join(results.withColumnRenamed("id", "replay_result_id"), "replay_result_id").join(judged, "replay_result_id")
    return queue.join(prompts, "source_trace_id", "left").join(names, "archetype_id", "left").select("replay_result_id", "archetype_id", F.coalesce("label", "archetype_id").alias("label"), "candidate", "judge_passed", "prompt_text", "queued_ts").orderBy("queued_ts", "replay_result_id")


def scorer_summary(scores: DataFrame, archetypes: DataFrame) -> DataFrame:
    names = archetypes.select(F.col("id").alias("archetype_id"), "label")
    sums = scores.groupBy("archetype_id", "candidate", "scorer").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    return sums.join(names, "archetype_id", "left").withColumn("label", F.coalesce("label", "archetype_id"))


def evaluate(rules: DataFrame, values: DataFrame) -> DataFrame:
    """Status of each rule (name, sli, op, threshold) by its indicator's value: ok, breach, or no_data."""
    v, t = F.col("value"), F.col("threshold")
    healthy = F.lit(None).cast("boolean")
    for op, test in OPERATORS.items():
        healthy = F.when(F.col("op") == op, test(v, t)).otherwise(healthy)
    status = F.when(v.isNull(), "no_data").when(healthy, "ok").otherwise("breach")
    return rules.join(values, "sli", "left").withColumn("status", status)


def compliance(evaluations: DataFrame, targets: DataFrame, now_ms: int, days: int = 28) -> DataFrame:
    """Attainment and left error budget of each objective with a target; nulls without evaluations in the window."""
    inside = evaluations.where((F.col("ts") >= now_ms - days * DAY_MS) & (F.col("ts") <= now_ms))
    sums = inside.groupBy("objective").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))
    rows = targets.join(sums, "objective", "left").fillna(0, ["n", "n_ok"]).withColumn("attainment", stats.ratio(F.col("n_ok"), F.col("n")))
    return rows.withColumn("budget_left", stats.error_budget(F.col("attainment"), F.col("target")))


def quota_percent(traces: DataFrame, assignments: DataFrame, quota: int) -> DataFrame:
    """Percent of a token quota that each archetype's traces use, at most 100; 0 for no quota."""
    used = traces.join(assignments, traces.id == assignments.trace_id).groupBy("archetype_id").agg(F.coalesce(F.sum(F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))), F.lit(0)).alias("tokens"))
    share = F.least(F.lit(100.0), F.col("tokens") * 100.0 / quota) if quota > 0 else F.lit(0.0)
    return used.withColumn("quota_percent", share)


def usd_value(traces: DataFrame, assignments: DataFrame, results: DataFrame) -> DataFrame:
    """What replacing the priced calls of an archetype by a candidate saves in all; never negative."""
    front = traces.where("cost_usd IS NOT NULL").join(assignments, traces.id == assignments.trace_id).groupBy("archetype_id").agg(F.avg("cost_usd").alias("frontier"), F.count("*").alias("calls"))
    cand = results.groupBy("archetype_id", "candidate").agg(F.avg("cost_usd").alias("replayed"))
    rows = cand.join(front, "archetype_id", "left")
    saved = (F.coalesce("frontier", F.lit(0.0)) - F.coalesce("replayed", F.lit(0.0))) * F.coalesce("calls", F.lit(0))
    return rows.withColumn("usd_value", F.greatest(F.lit(0.0), saved))


def recommend(verdicts: DataFrame, live: DataFrame, quota: DataFrame, usd: DataFrame, now_ms: int, days: int = 45) -> DataFrame:
    """New recommendations in one pass: pairs whose latest verdict passes and that no live recommendation names."""
    passing = latest(verdicts, ["archetype_id", "candidate"]).where("state = 'pass'")
    fresh = passing.join(live.where(F.col("expires_ts") > now_ms).select("archetype_id", "candidate"), ["archetype_id", "candidate"], "left_anti")
    low, high = stats.wilson(F.col("n_pass"), F.col("n_samples"))
    rows = fresh.join(usd.select("archetype_id", "candidate", "usd_value", "calls"), ["archetype_id", "candidate"], "left").join(quota.select("archetype_id", "quota_percent"), "archetype_id", "left")
    priced = F.coalesce("calls", F.lit(0)) > 0
    return rows.select(
        "archetype_id", "candidate", F.when(priced, "usd").otherwise("quota").alias("currency"), F.when(priced, F.coalesce("usd_value", F.lit(0.0))).otherwise(F.coalesce("quota_percent", F.lit(0.0))).alias("value"),
        stats.ratio(F.col("n_pass"), F.col("n_samples")).alias("pass_rate"), low.alias("pass_rate_ci_low"), high.alias("pass_rate_ci_high"), F.lit(now_ms).alias("created_ts"), F.lit(now_ms + days * DAY_MS).alias("expires_ts"),
    )


def expired_policies(policies: DataFrame, recommendations: DataFrame, now_ms: int) -> DataFrame:
    """Applied policies, not reverted, that no live recommendation backs."""
    live = recommendations.where(F.col("expires_ts") > now_ms).select("archetype_id", "candidate")
    return policies.where("reverted_ts IS NULL").join(live, ["archetype_id", "candidate"], "left_anti")


def summary(traces: DataFrame, assignments: DataFrame, archetypes: DataFrame) -> DataFrame:
    """One row of totals; zeros on an empty store."""
    t = traces.agg(F.count("*").alias("traces"), F.count_if("quarantined").alias("quarantined"))
    a = assignments.agg(F.count("*").alias("assigned"))
    k = active(archetypes).agg(F.count("*").alias("archetypes"))
    one = t.crossJoin(a).crossJoin(k)  # one row each
    return one.withColumn("unassigned", F.greatest(F.lit(0), F.col("traces") - F.col("assigned")))


def archetype_counts(archetypes: DataFrame, assignments: DataFrame) -> DataFrame:
    """Active archetypes with the count of their traces, those without included."""
    counts = assignments.groupBy(F.col("archetype_id").alias("id")).agg(F.count("trace_id").alias("n"))
    return active(archetypes).select("id", "label", "pinned").join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def drill_down(traces: DataFrame, assignments: DataFrame, archetype: str, limit: int = 50) -> DataFrame:
    """The newest traces of an archetype; limit is 1 to 500."""
    if not 1 <= limit <= 500:
        raise ValueError("limit is 1 to 500")
    return traces.join(assignments, traces.id == assignments.trace_id).where(F.col("archetype_id") == archetype).orderBy(F.desc("ts"), "id").limit(limit)
