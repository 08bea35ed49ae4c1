"""Sources, sinks, streaming and replay on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake import schemas
from tracelake.operators import indicators, mining, prefix, replay, similarity, windows
from tracelake.operators.exposition import exposition
from tracelake.sources import otlp, rules, sync, transcripts
from tracelake.streaming import capture

NOW = 1_800_000_000_000


def user(text, n=0):
    return json.dumps({"type": "user", "uuid": f"u{n}", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": text}})


def assistant(uuid, second=1):
    return json.dumps({"type": "assistant", "uuid": uuid, "timestamp": f"2024-01-01T00:00:0{second}.500Z", "message": {"role": "assistant", "model": "m1", "content": [{"type": "text", "text": "hi"}], "usage": {"input_tokens": 5, "output_tokens": 7}}})


def test_transcripts(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    tool = [{"type": "tool_result", "content": "r"}]
    (tmp_path / "deep" / "s1.jsonl").write_text("\n".join([user("first"), assistant("a1"), user(tool), assistant("a2", 2), "{bad", '{"type": "summary"}', "", user([{"type": "text", "text": "next"}]), assistant("a3", 3), assistant("half")[:30]]))
    (tmp_path / "s2.jsonl").write_text(assistant("b1") + "\n")
    found, counts = transcripts.scan(spark, str(tmp_path), NOW)
    rows = {r.ingest_key: r for r in found.collect()}
    assert set(rows) == {"a1", "a2", "a3", "b1"} and counts["parse_errors"] == 1 and counts["unknown_lines"] == 1 and counts["watched"] == 2
    assert [rows[k].prompt_text for k in ("a1", "a2", "a3", "b1")] == ["first", "first", "next", None]
    assert rows["a2"].parent_id == rows["a1"].id and rows["b1"].parent_id is None and rows["a1"].tokens_out == 7 and rows["a1"].ts == 1704067201500
    again, _ = transcripts.scan(spark, str(tmp_path), NOW)
    assert {r.id for r in again.collect()} == {r.id for r in rows.values()}


def test_chat_export(spark, tmp_path):
    talk = {"uuid": "c1", "chat_messages": [{"uuid": "1", "sender": "human", "text": "q"}, {"uuid": "2", "sender": "assistant", "content": [{"text": "x", "type": "text"}], "created_at": "2024-01-01T00:00:00Z"}, {"uuid": "3", "sender": "human", "text": ""}, {"uuid": "4", "sender": "assistant", "text": "z"}]}
    (tmp_path / "a.json").write_text(json.dumps({"conversations": [talk]}))
    (tmp_path / "b.json").write_text(json.dumps([talk | {"uuid": "c2"}]))
    (tmp_path / "c.json").write_text("{nothing")
    rows = {(r.session_id, r.ingest_key): r for r in transcripts.chat_export(spark, str(tmp_path), NOW).collect()}
    assert set(rows) == {(c, k) for c in ("c1", "c2") for k in "24"}
    assert rows["c1", "2"].prompt_text == "q" and rows["c1", "4"].prompt_text == "" and rows["c1", "4"].parent_id == rows["c1", "2"].id and rows["c1", "4"].ts == NOW


def test_otlp(spark):
    point = {"asInt": "150", "timeUnixNano": "1700000000123456789", "attributes": [{"key": "model", "value": {"stringValue": "m"}}]}
    payload = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "llm.token.usage", "sum": {"dataPoints": [point, {"attributes": []}]}}, {"name": "other", "sum": {"dataPoints": [point]}}, {"name": "tokens", "gauge": {"dataPoints": [{"asDouble": 2.5}]}}]}]}]}
    got = sorted(otlp.points(spark.createDataFrame([(json.dumps(payload),), ("bad",)], "payload string")).collect(), key=lambda r: r.value)
    assert [(r.metric, r.ts_ms, r.value) for r in got] == [("tokens", 0, 2.5), ("llm.token.usage", 1700000000123, 150.0)] and got[1].attributes == {"model": "m"}


def captured(spark, rows):
    full = [(i, ts, "transcript", None, "m", '{"content": "hello"}', "{}", 1, 2, None, None, "s", None, None, False, key, "1", None) for i, ts, key in rows]
    return spark.createDataFrame(full, schemas.schema("capture"))


def test_capture_and_sync(spark, tmp_path):
    table, spill, traces = (f"file://{tmp_path}/{x}" for x in ("capture", "spill", "traces"))
    sink = capture.capture_sink(table, spill, f"file://{tmp_path}/paused")
    sink(captured(spark, [("1", 1, "k1"), ("2", 2, "k1"), ("3", 3, None), ("4", 4, None)]), 0)
    sink(captured(spark, [("5", 5, "k1"), ("6", 6, "k2")]), 1)
    (tmp_path / "paused").write_text("")
    sink(captured(spark, [("9", 9, "k9")]), 2)
    assert sorted(r.id for r in schemas.read(spark, table, "capture").collect()) == ["1", "3", "4", "6"]
    first, second = sync.sync(spark, table, traces, NOW), sync.sync(spark, table, traces, NOW)
    assert (first["rows_inserted"], second["rows_inserted"], second["rows_deduped"]) == (4, 0, 4)
    assert {r.prompt_text for r in schemas.read(spark, traces, "traces").collect()} == {"hello"}
    captured(spark, [("7", 7, "k7"), ("8", 8, "k2")]).write.json(spill)
    assert sync.recover_spill(spark, spill, table) == 1 and sync.recover_spill(spark, spill, table) == 0
    sync.replace(schemas.read(spark, table, "capture").where("id = '1'"), table)
    assert schemas.read(spark, table, "capture").count() == 1
    sync.reset(spark, table)
    assert not sync.exists(spark, table)


def test_stream_of_first_captures(spark, tmp_path):
    """Keys of earlier batches, of the table before the start, and of a query that went on after a stop don't pass again."""
    table, landing = f"file://{tmp_path}/capture", f"file://{tmp_path}/landing"
    known = captured(spark, [("old", 0, "k0")])

    def run(*batches):
        for rows in batches:
            captured(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schemas.schema("capture")).option("maxFilesPerTrigger", 1).parquet(landing)
        q = capture.start(capture.first_captures(stream, known), capture.append_sink(table, f"file://{tmp_path}/spill"), f"file://{tmp_path}/check", once=True, rocksdb=True)
        q.awaitTermination()
        return sorted(r.id for r in schemas.read(spark, table, "capture").collect()), [p["numInputRows"] for p in q.recentProgress]

    got, _ = run([("2", 2, "k1"), ("1", 1, "k1"), ("3", 3, None), ("4", 4, None), ("5", 5, "k0")], [("6", 6, "k1"), ("7", 7, "k2"), ("8", 8, None)])
    assert got == ["1", "3", "4", "7", "8"]
    got, _ = run([("9", 9, "k2"), ("10", 10, "k3"), ("11", 11, "k0")])
    assert got == ["1", "10", "3", "4", "7", "8"]
    assert spark.conf.get(capture.STATE_STORE, None) is None or "RocksDB" not in spark.conf.get(capture.STATE_STORE)
    plan = capture.first_captures(spark.readStream.schema(schemas.schema("capture")).parquet(landing))._jdf.queryExecution().logical().toString()
    assert "capture/" not in plan and "Join" not in plan  # no look at the table


def test_old_files_read_under_the_current_schema(spark, tmp_path):
    spark.createDataFrame([("r", "a", "c", "t", "pass", 0.0, 1, "g", "run", 1)], schemas.schema("replay_results", 1)).write.parquet(f"{tmp_path}/t")
    assert schemas.read(spark, f"{tmp_path}/t", "replay_results").first().response_text is None


def test_tail_stream(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    file = folder / "s1.jsonl"
    run = lambda: (q := capture.start(capture.paired(capture.tail(spark, str(folder))), lambda b, n: b.write.mode("append").parquet(out), f"file://{tmp_path}/check", once=False), q.processAllAvailable(), q.stop())
    file.write_text(user("one") + "\n" + assistant("a1") + "\n" + assistant("a2")[:20])
    run()
    with file.open("a") as f:
        f.write(assistant("a2")[20:] + "\n" + user("two") + "\n" + assistant("a3") + "\n")
    run()
    rows = {r.id: r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {"s1:a1", "s1:a2", "s1:a3"} and [rows[f"s1:a{i}"].prompt_text for i in (1, 2, 3)] == ["one", "one", "two"] and rows["s1:a3"].parent_id == "s1:a2"


def test_alert_stream_equals_batch(spark, tmp_path):
    rows = [(i, "o", i, s) for i, s in enumerate(["breach", "breach", "no_data", "ok", "breach", "error", "breach"])]
    df = spark.createDataFrame(rows, "id bigint, objective string, ts bigint, status string")
    assert [r.id for r in windows.alerts(df).orderBy("id").collect()] == [0, 4]
    df.repartition(1).write.parquet(f"{tmp_path}/in")
    out = []
    q = capture.start(capture.alerts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), lambda b, n: out.extend(r.id for r in b.collect()), f"file://{tmp_path}/check", once=True)
    q.awaitTermination()
    assert sorted(out) == [0, 4]


def test_sprt(spark):
    cases = {"a": "T", "b": "TT", "c": "FF", "d": "TFTF", "e": "TTTT"}
    rows = [(k, i, x == "T") for k, s in cases.items() for i, x in enumerate(s)]
    got = {r.pair: (r.state, r.n_samples) for r in prefix.sprt(spark.createDataFrame(rows, "pair string, n int, passed boolean"), ["pair"], ["n"], 0.9, 0.1).collect()}
    assert got == {"a": ("inconclusive", 1), "b": ("pass", 2), "c": ("fail", 2), "d": ("inconclusive", 4), "e": ("pass", 2)}
    with pytest.raises(ValueError):
        prefix.sprt(spark.createDataFrame(rows, "pair string, n int, passed boolean"), ["pair"], ["n"], 0.5, 0.9)


def test_regressions_and_budget(spark):
    rows = [(f"{k}{i}", "a", k, "pass" if i < good else "fail", i) for k, n, good in (("few", 5, 0), ("half", 20, 10), ("fine", 20, 20)) for i in range(n)]
    got = {r.candidate: r.breached for r in windows.regressions(spark.createDataFrame(rows, "id string, archetype_id string, candidate string, result string, ts int"), 20, 0.8).collect()}
    assert got == {"few": False, "half": True, "fine": False}
    spend = prefix.within_budget(spark.createDataFrame([(i, 2.0) for i in range(5)], "n int, cost_usd double"), 3.0, ["n"])
    assert [r.spent for r in spend.orderBy("n").collect()] == [2.0, 4.0]


def test_replay(spark, tmp_path):
    work = spark.createDataFrame([(f"t{i}", "a", "c", f"p{i}") for i in range(5)], "id string, archetype_id string, candidate string, prompt_text string")
    call = lambda candidate, prompt: {"text": prompt.upper(), "cost_usd": 2.0, "latency_ms": 5}
    assert replay.replay(work, call, budget=3.0).count() == 2 and replay.replay(work, call).count() == 5
    done = replay.replay(work, call, budget=3.0)
    assert replay.pending(work, done).count() == 3
    tries = []

    def limited(x):
        tries.append(x)
        if len(tries) < 3:
            raise replay.RateLimited
        return x

    assert replay.call_with_retries(limited, 1, sleep=lambda s: None) == 1
    steps = spark.createDataFrame([("s", "c", i, f"q{i}", "ref") for i in range(3)], "session_id string, candidate string, step int, prompt_text string, reference string")
    chain = replay.replay_chains(steps, lambda c, history: {"text": str(len(history)), "cost_usd": 1.0}).first()
    assert (chain.steps, chain.response_text, chain.cost_usd) == (3, "5", 3.0)

    def fails(c, history):
        raise RuntimeError

    assert replay.replay_chains(steps, fails).count() == 0


def test_writers_and_policies(spark, tmp_path):
    for kind in ("litellm", "nanoclaw", "claude_code"):
        path = tmp_path / kind
        path.write_text("# mine\nmodel_list: []\n" if kind == "litellm" else '{"rules":  []}')
        before = path.read_text()
        w = replay.RuleWriter(path, kind)
        assert "c1" in w.preview("L", "c1") and path.read_text() == before
        assert w.write("L", "c0") == before
        w.write("L", "c1")
        assert "c0" not in path.read_text()
        w.revert(before)
        assert path.read_text() == before
    row = spark.createDataFrame([("n1", "a", "c")], "id string, archetype_id string, candidate string").first()
    policy = replay.apply_policy(w, row, "L", NOW)
    table = spark.createDataFrame([policy], schemas.schema("applied_policies"))
    after = replay.revert_policy(w, table, policy["id"], "worse", NOW + 1)
    assert after.first().revert_reason == "worse" and path.read_text() == before
    with pytest.raises(KeyError):
        replay.revert_policy(w, after, policy["id"], "again", NOW)
    reviews = spark.createDataFrame([("r1", None, None, 1, None)], schemas.schema("human_reviews"))
    assert replay.record_review(reviews, "r1", "pass", 5).first().reviewed_ts == 5
    with pytest.raises(KeyError):
        replay.record_review(reviews, "zz", "pass", 5)


def test_rules_and_indicators(spark, tmp_path):
    from pathlib import Path

    folder = Path(rules.__file__).parent.parent / "rules"
    table = rules.objectives(spark, str(folder / "objectives.yaml"), set(indicators.INDICATORS))
    assert table.count() == 17 and table.where("kind = 'slo'").count() == 4 and rules.candidates(spark, str(folder / "candidates.yaml")).count() == 6
    bad = tmp_path / "r.yaml"
    for text in ("{name: x, sli: nope, op: '<=', threshold: 1}", "{name: x, sli: disk_free_gb, op: '~', threshold: 1}", "{name: x, sli: disk_free_gb, op: '<=', threshold: 1, kind: slo}"):
        bad.write_text(f"objectives:\n  - {text}\n")
        with pytest.raises(ValueError):
            rules.objectives(spark, str(bad), set(indicators.INDICATORS))
    names = {"traces": "traces", "assignments": "archetype_assignments", "archetypes": "archetypes", "replay_results": "replay_results", "spot_checks": "spot_checks", "eval_scores": "eval_scores", "human_reviews": "human_reviews", "applied_policies": "applied_policies", "recommendations": "recommendations", "capture": "capture"}
    tables = {k: schemas.empty(spark, v) for k, v in names.items()}
    tables["traces"] = tables["traces"].withColumn("empty_response", F.lit(False))
    tables["metrics"] = spark.createDataFrame([("operations_total", "counter", 10.0), ("operation_errors_total", "counter", 1.0), ("proxy_added_latency_ms", "histogram", 3.0)], "name string, kind string, value double")
    got = {r.name: r.status for r in indicators.evaluate(spark, indicators.Context(tables, NOW), table).collect()}
    assert got["pipeline_errors"] == "breach" and got["proxy_overhead"] == "ok" and got["capture_lag"] == "no_data" and got["judge_trustworthiness"] == "no_data" and got["fail_open_triggered"] == "ok" and "error" not in got.values()


def test_exposition(spark):
    rows = spark.createDataFrame([("a.b", "counter", {"x": 'q"'}, 1.0), ("a.b", "counter", {"x": 'q"'}, 2.0), ("g", "gauge", {}, 1.0), ("g", "gauge", {}, 5.0), ("h", "histogram", {}, 1.0), ("h", "histogram", {}, 3.0)], "name string, kind string, labels map<string,string>, value double")
    got = [r.line for r in exposition(rows, "t_").collect()]
    assert 't_a_b{x="q\\""} 3.0' in got and "t_g 5.0" in got and "t_h_count 2" in got and "t_h_sum 4.0" in got and 't_h{quantile="0.99"} 3.0' in got


def test_mining(spark):
    topics = {i: ("python error traceback import module" if i < 3 else "invoice payment refund customer money") + f" x{i}" for i in range(6)}
    v = mining.hash_embedding(spark.createDataFrame([*topics.items(), (9, "")], "id bigint, text string"))
    ids = spark.createDataFrame([(i,) for i in [*topics, 9]], "id bigint")
    found = mining.clusters(mining.components(ids, similarity.similar_links(v, 0.5)))
    assert {r.id: r.cluster for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 9: -1}
    centres = mining.medoids(v, found)
    assert {r.cluster: r.id for r in centres.collect()}.keys() == {0, 3}
    assert all(0 <= r.distance < 0.5 for r in mining.distances(v, found, centres).collect())
    pairs = spark.createDataFrame([(0, "a", 0.9), (0, "b", 0.8), (3, "a", 0.95), (3, "c", 0.7)], "cluster bigint, archetype_id string, similarity double")
    assert [tuple(r) for r in mining.match_identities(pairs).collect()] == [(0, "a")]
    labels = mining.keyword_labels(spark.createDataFrame([(1, 1, "the python error"), (1, 2, "python ERROR trace"), (2, 3, "a of")], "cluster bigint, id bigint, text string"))
    assert {r.cluster: r.label for r in labels.collect()} == {1: "Python Error Trace", 2: "Unlabeled"}
    path = mining.components(spark.range(40), spark.createDataFrame([(i, i + 1) for i in range(38)] + [(5, 3)], "a bigint, b bigint"))
    assert {r.id: r.component for r in path.collect()} == {i: 0 for i in range(39)} | {39: 39}


def test_received_payloads_are_appended_once(spark, tmp_path):
    from tracelake.sources import otlp

    def payload(n):
        return json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "token.usage", "sum": {"dataPoints": [{"asInt": str(n), "timeUnixNano": "5000000"}]}}, {"name": "other", "sum": {"dataPoints": [{"asInt": "9"}]}}]}]}]})

    folder = tmp_path / "landed"
    folder.mkdir()
    at = (str(folder), str(tmp_path / "points"), str(tmp_path / "state"))
    (folder / "a.json").write_text(payload(3))
    (folder / "b.json").write_text("{broken")
    otlp.receive(spark, *at).awaitTermination()
    (folder / "c.json").write_text(payload(4))
    otlp.receive(spark, *at).awaitTermination()
    rows = spark.read.parquet(at[1])
    assert sorted((r.metric, r.ts_ms, r.value) for r in rows.collect()) == [("token.usage", 5, 3.0), ("token.usage", 5, 4.0)]
    assert otlp.total_tokens(rows).first().tokens == 7.0 and otlp.total_tokens(rows.limit(0)).first().tokens == 0.0


def test_spans_nest_and_never_fail_the_work(spark, tmp_path):
    from tracelake.sources import spans

    path = str(tmp_path / "deep" / "spans.jsonl")
    log = spans.SpanLog(path)
    with log.span("run", n=1), log.span("call") as found:
        found["cost"] = 0.5
    with pytest.raises(KeyError), log.span("bad"):
        raise KeyError
    rows = {r.name: r for r in spans.read(spark, path).collect()}
    assert rows["call"].parent_span_id == rows["run"].span_id and rows["call"].trace_id == rows["run"].trace_id != rows["bad"].trace_id
    assert rows["run"].parent_span_id is None and rows["run"].start_time_ns <= rows["call"].start_time_ns <= rows["call"].end_time_ns <= rows["run"].end_time_ns
    assert rows["call"].attributes == {"cost": "0.5"} and rows["bad"].status == "ERROR" and rows["run"].status == "UNSET"
    (tmp_path / "file").write_text("")
    with spans.SpanLog(str(tmp_path / "file" / "x")).span("kept"):
        pass


def test_exposition_of_large_and_odd_numbers(spark):
    """No exponent below 1e16, exact sums, and the names that scrapers know (before: 1.23456789E7, a sum by the order of rows, Infinity)."""
    rows = [("g", "gauge", {}, 12345678.9), ("c", "counter", {}, float("inf")), ("s", "counter", {}, 2e15), ("t", "counter", {}, 0.0005)]
    rows += [("h", "histogram", {}, v) for v in (99999999.3, -0.1, 0.1, 0.1, 0.1)]
    got = [r.line for r in exposition(spark.createDataFrame(rows, "name string, kind string, labels map<string,string>, value double"), "").collect()]
    assert {"g 12345678.9", "c +Inf", "s 2000000000000000.0", "t 0.0005", "h_sum 99999999.5", 'h{quantile="0.99"} 99999999.3'} <= set(got)
