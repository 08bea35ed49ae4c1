"""The store end to end: bootstrap, ingest, sync, routes on empty and filled tables, clusters, work."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_sources import NOW, assistant, user
from tracelake import schemas
from tracelake.functions import cost, messages
from tracelake.plans.api import Store, bootstrap


def test_store(spark, tmp_path):
    spark.sql("DROP DATABASE IF EXISTS store_test CASCADE")
    spark.sql(f"CREATE DATABASE store_test LOCATION 'file://{tmp_path}/db'")
    bootstrap(spark, "store_test")
    bootstrap(spark, "store_test")
    s = Store(spark, "store_test")
    assert s.summary().first().traces == 0 and s.archetypes().count() == 0 and s.traces().count() == 0 and s.recommendations().columns and all(r.ready for r in s.readyz().collect())
    assert s.monitor(NOW)["quality"].where("ratio IS NOT NULL").count() == 0 and s.evals()[1].first().kappa is None
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(6):
        text = ("fix the python traceback error in module " if k < 3 else "refund the invoice payment of customer ") + str(k)
        (folder / f"s{k}.jsonl").write_text(user(text + (" key AKIA" + "B" * 16 if k == 0 else "")) + "\n" + assistant(f"a{k}") + "\n")
    assert s.ingest(str(folder), NOW)["captured"] == 6 and s.ingest(str(folder), NOW)["captured"] == 0
    assert s.sync(NOW)["rows_inserted"] == 6 and s.sync(NOW)["rows_inserted"] == 0
    row = s.table("traces").where("session_id = 's0'").first()
    assert "AKIA" not in row.request_json + row.prompt_text and json.loads(row.redaction_flags) == ["aws_access_key_id"]
    members, medoids = s.cluster(0.5)
    assert members.where("cluster <> -1").select("cluster").distinct().count() == 2 and medoids.count() == 2
    assert s.summary().first().traces == 6 and s.traces(limit=3).count() == 3 and s.trace(row.id).count() == 1
    with pytest.raises(ValueError):
        s.traces(limit=501)
    done = s.assign_archetypes(NOW)
    assert len(done["new"]) == 2 and not done["matched"] and done["unassigned_traces_ratio"] == 0 and done["archetype_count"] == 2
    named = {r.label for r in s.table("archetypes").collect()}
    assert len(named) == 2 and all(named) and s.table("archetype_assignments").where("distance BETWEEN 0 AND 0.5").count() == 6
    again = s.assign_archetypes(NOW + 5, label=lambda texts: "never asked")
    assert sorted(again["matched"]) == done["new"] and not again["new"] and s.table("archetypes").where(f"updated_ts = {NOW + 5}").count() == 2 and s.table("archetype_assignments").count() == 6

    def call(candidate, prompt):
        if candidate == "broken":
            raise RuntimeError
        return {"text": "hi" if candidate == "good" else "I'm sorry", "cost_usd": 0.5, "latency_ms": 7}

    ladder = spark.createDataFrame([("good",), ("bad",), ("broken",)], "name string")
    assert s.run(ladder, call, 4, "7", "r1", NOW) == 18 and s.run(ladder, call, 4, "7", "r2", NOW) == 0  # what is saved isn't asked for again
    kept = {(r.candidate, r.verdict): r.n for r in s.table("replay_results").groupBy("candidate", "verdict").agg(F.count("*").alias("n")).collect()}
    assert set(kept) >= {("bad", "fail"), ("broken", "fail")} and kept["good", "pass"] == 6 and s.table("eval_scores").where("scorer = 'completion'").count() == 12
    bare = s.table("traces").withColumn("prompt_text", F.when(F.col("session_id") == "s1", F.lit(None)).otherwise(F.col("prompt_text")))
    s._overwrite("traces", bare)
    assert s.table("traces").where("prompt_text IS NULL").count() == 1 and s.sync(NOW)["rows_inserted"] == 0 and s.table("traces").where("prompt_text IS NULL").count() == 0
    for name in ("archetypes", "archetype_assignments", "replay_results"):
        s._overwrite(name, s.table(name).where("false"))
    spark.createDataFrame([("A", "L", False, None, 0, 0, None)], schemas.schema("archetypes")).write.insertInto("store_test.archetypes")
    spark.createDataFrame([(r.id, "A", 0.1, 0) for r in s.table("traces").collect()], schemas.schema("archetype_assignments")).write.insertInto("store_test.archetype_assignments")
    assert s.work(spark.createDataFrame([("c0",), ("c1",)], "name string"), 4, "7").count() == 8
    spark.sql("DROP DATABASE store_test CASCADE")


def test_prices(spark):
    prices = spark.createDataFrame([("m", False, 2.0, 4.0), ("own", True, 0.0, 0.0)], "model string, local boolean, price_in double, price_out double")
    calls = spark.createDataFrame([("m", 1_000_000, 125_000), ("own", 5, 5), ("other", 1_000_000, 0), ("m", None, 1)], "model string, tokens_in int, tokens_out int")
    assert [r.cost_usd for r in cost.priced(calls, prices).collect()] == [2.5, 0.0, None, None] and [r.cost_usd for r in cost.priced(calls, prices, dearest=True).collect()][2] == 2.0


def test_judge_fails_closed(spark):
    def judge(rubric, frontier, candidate):
        if not candidate:
            raise RuntimeError
        return frontier == candidate

    df = spark.createDataFrame([("r", "a", "a"), ("r", "a", "b"), ("r", "a", None)], "r string, f string, c string")
    got = [tuple(x.j) for x in df.select(messages.judge_udf(judge)("r", "f", "c").alias("j")).collect()]
    assert got == [(True, None), (False, None), (False, "judge_error:RuntimeError")]
    assert messages.user_content('{"content": "x"}') == "x" and messages.user_content('{"a": 1}') == {"a": 1} and messages.user_content("raw") == "raw"
    v = spark.createDataFrame([("ab",), (None,)], "t string").select(messages.embedder_udf(lambda ts: [[len(t)] for t in ts])("t").alias("v")).collect()
    assert [r.v for r in v] == [[2.0], [0.0]]
