"""Table schemas of the trace model, with versions: new columns are additive and read as null from old files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_KINDS = {"L": T.LongType(), "I": T.IntegerType(), "D": T.DoubleType(), "S": T.StringType(), "B": T.BooleanType()}


def _struct(spec: str) -> T.StructType:
    """``name:kind`` pairs; an exclamation mark says not null."""
    fields = (x.split(":") for x in spec.split())
    return T.StructType([T.StructField(n, _KINDS[k[0]], not k.endswith("!")) for n, k in fields])


#: By table and schema version; the last version is the current one.
VERSIONS: dict[str, list[str]] = {
    "traces": [
        "id:S! ts:L! source:S! tool:S model:S! request_json:S! response_json:S! tokens_in:I tokens_out:I latency_ms:I cost_usd:D session_id:S parent_id:S redaction_flags:S quarantined:B! prompt_text:S",
        "notes:S",
    ],
    "capture": ["id:S! ts:L! source:S! tool:S model:S! request_json:S! response_json:S! tokens_in:I tokens_out:I latency_ms:I cost_usd:D session_id:S parent_id:S redaction_flags:S quarantined:B! ingest_key:S parser_version:S", "notes:S"],
    "archetype_assignments": ["trace_id:S! archetype_id:S! distance:D assigned_ts:L!"],
    "archetypes": ["id:S! label:S! pinned:B! merged_into:S created_ts:L! updated_ts:L! medoid_trace_id:S"],
    "replay_results": ["id:S! archetype_id:S! candidate:S! source_trace_id:S! verdict:S! cost_usd:D! latency_ms:I grader:S! run_id:S! ts:L!", "", "response_text:S"],
    "sprt_verdicts": ["archetype_id:S! candidate:S! run_id:S! state:S! n_samples:I! n_pass:I! log_likelihood_ratio:D! ts:L!"],
    "recommendations": ["id:S! archetype_id:S! candidate:S! currency:S! value:D! pass_rate:D! pass_rate_ci_low:D! pass_rate_ci_high:D! latency_delta_ms:I created_ts:L! expires_ts:L!"],
    "applied_policies": ["id:S! archetype_id:S! candidate:S! writer:S! diff:S! previous_content:S! applied_ts:L! reverted_ts:L revert_reason:S"],
    "spot_checks": ["id:S! archetype_id:S! candidate:S! trace_id:S! result:S! ts:L!"],
    "eval_scores": ["replay_result_id:S! run_id:S! archetype_id:S! candidate:S! scorer:S! value:D! passed:B! detail:S ts:L!"],
    "human_reviews": ["replay_result_id:S! human_verdict:S note:S queued_ts:L! reviewed_ts:L"],
    "slo_evaluations": ["objective:S! ts:L! value:D ok:B!"],
}


def schema(table: str, version: int | None = None) -> T.StructType:
    return _struct(" ".join(VERSIONS[table][:version]))


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table under the current schema; files of an older version have null in later columns."""
    return spark.read.schema(schema(table)).parquet(path)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))
