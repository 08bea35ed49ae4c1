"""Reports from rollups against those of a full scan: late rows, changed assignments, any report time, streams."""

import random

import pytest

from tracelake.operators import reports, rollups
from tracelake.streaming import capture

DAY = reports.DAY_MS
NOW = 1_706_659_200_000


@pytest.fixture(scope="module")
def model(spark):
    dice = random.Random(5)
    steps = [0, -7 * DAY, -35 * DAY, -35 * DAY - 1, -7 * DAY - 1, 299_999, 300_000, 300_001, 9 * DAY]
    ts = lambda: None if dice.random() < 0.02 else NOW + (dice.choice(steps) if dice.random() < 0.2 else -dice.randrange(40 * DAY))
    traces = [(f"t{i}", ts(), dice.choice(["m0", "m1", "unknown", None]), dice.choice([None, 0, 1, 2, 900]), dice.choice([None, 5]), dice.random() < 0.2, dice.random() < 0.3) for i in range(3000)]
    given = [(r[0], f"a{dice.randrange(6)}") for r in traces if dice.random() < 0.8] + [("gone", "a0")]
    names = [(f"a{i}", "a1" if i == 4 else None, f"L{i}") for i in range(5)]  # a5 is known to no table
    outcomes = [(f"a{dice.randrange(4)}", dice.choice(["x", "y", None]), dice.random() < 0.7, dice.choice([None, dice.randrange(900)]), ts()) for _ in range(3000)]
    return (
        spark.createDataFrame(traces, "id string, ts bigint, model string, tokens_in int, tokens_out int, quarantined boolean, empty_response boolean").cache(), spark.createDataFrame(given, "trace_id string, archetype_id string").cache(),
        spark.createDataFrame(names, "id string, merged_into string, label string").cache(), spark.createDataFrame(outcomes, "archetype_id string, candidate string, passed boolean, latency_ms int, ts bigint").cache(),
    )


def same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    tidy = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect()), key=repr)
    assert tidy(left) == tidy(right)


def full_performance(rows, names, now):
    results = rows.selectExpr("'suite' AS grader", "archetype_id", "candidate", "CASE WHEN passed THEN 'pass' ELSE 'fail' END AS verdict", "latency_ms", "ts")
    return reports.performance(results, rows.where("false").selectExpr("archetype_id", "candidate", "'pass' AS result", "ts"), names, now)


@pytest.mark.parametrize("now", [NOW, NOW - 20 * DAY + 12_345_678])
def test_reports_equal_full_scans(model, now):
    traces, given, names, outcomes = model
    counts = rollups.all_counts(traces, given).cache()
    same(rollups.drift_keys(counts, traces, given, names, now), reports.drift_keys(traces, given, names, now))
    same(rollups.data_quality(counts, traces, given, now), reports.data_quality(traces, given, now))
    sums = rollups.inside(counts, traces, lambda rows: rollups.all_counts(rows, given), now + 1, now + DAY // 2)  # within a day or over one midnight
    assert sums.where("key = 'rows'").groupBy().sum("n").first()[0] == (traces.where(f"ts BETWEEN {now + 1} AND {now + DAY // 2}").count() or None)
    same(rollups.performance(rollups.outcome_counts(outcomes), outcomes, names, now), full_performance(outcomes, names, now))


def test_parts_late_rows_and_changes_add_up(spark, model):
    traces, given, _, outcomes = model
    early, late = traces.where("crc32(id) % 3 <> 0"), traces.where("crc32(id) % 3 = 0")
    first = given.where("crc32(trace_id) % 2 = 0").selectExpr("trace_id", "'a0' AS archetype_id")
    parts = rollups.trace_counts(early).unionByName(rollups.trace_counts(late)).unionByName(rollups.assignment_counts(traces, first)).unionByName(rollups.assignment_counts(traces, given, first))
    same(rollups.merged(parts, "day", "feature", "key"), rollups.all_counts(traces, given))
    halves = rollups.outcome_counts(outcomes.where("passed")).unionByName(rollups.outcome_counts(outcomes.where("NOT passed")))
    same(rollups.merged(halves, "day", "archetype_id", "candidate"), rollups.outcome_counts(outcomes))


def test_rollup_of_a_stream(spark, model, tmp_path):
    traces = model[0]
    at, out = f"file://{tmp_path}/in", f"file://{tmp_path}/rollup"
    sink = rollups.rollup_sink(out, rollups.trace_counts)
    for k in range(3):  # the third arrival holds the oldest rows as well
        traces.where(f"crc32(id) % 3 = {k}").write.mode("append").parquet(at)
        capture.start(spark.readStream.schema(traces.schema).parquet(at), sink, f"file://{tmp_path}/check", once=True).awaitTermination()
    found = rollups.read(spark, out, rollups.TRACES)
    same(rollups.merged(found, "day", "feature", "key"), rollups.trace_counts(traces))
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", "q")
    for _ in range(2):  # a batch that is done again counts once
        rollups.rollup_sink(f"{out}2", rollups.trace_counts)(traces, 0)
    same(rollups.read(spark, f"{out}2", rollups.TRACES), rollups.trace_counts(traces))


def test_empty(spark, model):
    traces, given, names, outcomes = (x.where("false") for x in model)
    counts = rollups.all_counts(traces, given)
    assert counts.count() == 0 and rollups.drift_keys(counts, traces, given, names, NOW).count() == 0
    same(rollups.data_quality(counts, traces, given, NOW), reports.data_quality(traces, given, NOW))
    assert rollups.performance(rollups.outcome_counts(outcomes), outcomes, names, NOW).count() == 0
