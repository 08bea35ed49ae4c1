"""Service-level indicators by name, and objectives evaluated from them."""

from __future__ import annotations

import shutil
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.prefix import percentiles
from tracelake.operators import reports


@dataclass
class Context:
    """The tables and the time that indicators look at; reports are made once and kept for the evaluation."""

    tables: dict[str, DataFrame]
    now_ms: int
    folder: str = "/"
    _made: dict = field(default_factory=dict)

    def once(self, name: str, make: Callable[[], object]):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def drift(self) -> dict:
        t = self.tables
        return self.once("drift", lambda: {r["feature"]: r["psi"] for r in reports.drift_report(reports.drift_keys(t["traces"], t["assignments"], t["archetypes"], self.now_ms)).collect()})

    def quality(self) -> dict:
        return self.once("quality", lambda: {r["check"]: r["ratio"] for r in reports.data_quality(self.tables["traces"], self.tables["assignments"], self.now_ms).collect()})

    def judge(self) -> dict:
        t = self.tables
        return self.once("judge", lambda: reports.agreement(reports.review_pairs(t["human_reviews"], t["replay_results"], t["eval_scores"])).first().asDict())

    def degraded(self) -> float | None:
        t = self.tables

        def count():
            done = reports.performance(t["replay_results"], t["spot_checks"], t["archetypes"], self.now_ms)
            known, bad = done.agg(F.count("z"), F.count_if("degraded")).first()
            return float(bad) if known else None

        return self.once("degraded", count)

    def counter(self, name: str) -> float:
        return float(self.tables["metrics"].where((F.col("name") == name) & (F.col("kind") == "counter")).agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0])


INDICATORS: dict[str, Callable[[Context], float | None]] = {}


def indicator(name: str):
    def add(f):
        INDICATORS[name] = f
        return f

    return add


for _name in ("fail_open_events_total", "spill_rows_total", "judge_errors_total"):
    INDICATORS[_name] = lambda c, n=_name: c.counter(n)


@indicator("capture_lag_seconds")
def capture_lag(c: Context):
    return c.tables["metrics"].where("name = 'capture_lag_seconds' AND kind = 'gauge'").agg(F.max("value")).first()[0]


@indicator("proxy_added_latency_p99_ms")
def proxy_latency(c: Context):
    return c.tables["metrics"].where("name = 'proxy_added_latency_ms' AND kind = 'histogram'").transform(lambda rows: percentiles(rows, [], "value", {"p99": 0.99})).first()["p99"]


@indicator("operation_error_ratio")
def error_ratio(c: Context):
    calls = c.counter("operations_total")
    return c.counter("operation_errors_total") / calls if calls else None


@indicator("disk_free_gb")
def disk_free(c: Context):
    return shutil.disk_usage(c.folder).free / 1e9


@indicator("etl_lag_seconds")
def etl_lag(c: Context):
    """How far the newest analytics row is behind the newest captured one."""
    newest = lambda t: c.tables[t].agg(F.max("ts")).first()[0] if t in c.tables else None
    captured, synced = newest("capture"), newest("traces")
    return None if captured is None else max(0.0, (captured - (synced or 0)) / 1000)


INDICATORS |= {
    "archetype_mix_psi": lambda c: c.drift().get("archetype"), "prompt_length_psi": lambda c: c.drift().get("prompt_length"), "unassigned_traces_ratio": lambda c: c.quality().get("unassigned"), "missing_token_counts_ratio": lambda c: c.quality().get("missing_tokens"),
    "degraded_candidate_pairs": lambda c: c.degraded(), "judge_human_agreement": lambda c: c.judge()["agreement"], "judge_kappa": lambda c: c.judge()["kappa"], "judge_false_pass_rate": lambda c: c.judge()["false_pass_rate"],
    "policies_reverted_7d": lambda c: float(c.tables["applied_policies"].where(F.col("reverted_ts") >= c.now_ms - 7 * reports.DAY_MS).count()),
    "expired_applied_policies": lambda c: float(reports.expired_policies(c.tables["applied_policies"], c.tables["recommendations"], c.now_ms).count()),
}


def values(spark: SparkSession, context: Context, names: list[str]) -> DataFrame:
    """(sli, value, error): one scalar an indicator; a failing one has its error and no value."""
    rows = []
    for name in names:
        try:
            found, error = INDICATORS[name](context), None
        except Exception as e:  # an indicator that fails must not hide the others
            found, error = None, f"{type(e).__name__}: {e}"[:200]
        rows.append((name, None if found is None else float(found), error))
    return spark.createDataFrame(rows, "sli string, value double, error string")


def evaluate(spark: SparkSession, context: Context, rules: DataFrame) -> DataFrame:
    """Rules with value and status: ok, breach, no_data or error."""
    names = [r["sli"] for r in rules.select("sli").distinct().collect()]
    done = reports.evaluate(rules, values(spark, context, names))
    return done.withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status"))).withColumn("ts", F.lit(context.now_ms))
