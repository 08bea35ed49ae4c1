"""Column functions against hand-computed values and plain Python."""

import json
import math
import random
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.functions import messages, scorers, stats
from tracelake.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def values(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    return [r.v for r in df.select("n", make(F.col("t")).alias("v")).orderBy("n").collect()]


def test_secrets(spark):
    body = "A" * 16
    texts = ["key AKIA" + body + " x", "AIza" + "b" * 35, "eyJab.eyJcd.ef", "-----BEGIN RSA KEY-----\nabc\n-----END RSA KEY-----", "xoxb-" + "1" * 12, "ghp_" + "a" * 36, "sk-" + "a" * 24, "sk-ant-" + "a-" * 12, "password = " + "q" * 18, "plain", None]
    flags = values(spark, texts, tx.secret_flags)
    assert [f[0] if f else f for f in flags] == ["aws_access_key_id", "gcp_api_key", "jwt", "pem_block", "slack_token", "github_token", "openai_key", "anthropic_key", "generic_kv_secret", [], []]
    assert values(spark, texts, tx.scrub)[0] == "key [REDACTED:aws_access_key_id] x"
    digest = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    got = values(spark, [digest], tx.redact)[0]
    assert got.text == digest and got.quarantined and got.flags == ["entropy_quarantine"]
    assert messages.redact_payload(json.dumps({"k": [digest, {"AKIA" + body: "AKIA" + body}]}))["flags"] == ["aws_access_key_id", "entropy_quarantine"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcXYZ019é ", max_size=40), min_size=1, max_size=6))
def test_entropy_and_tokens(spark, texts):
    want = [-sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) if t else 0.0 for t in texts]
    assert all(abs(a - b) < 1e-9 for a, b in zip(values(spark, texts, tx.entropy), want, strict=True))


def test_statistics(spark):
    low, high = stats.wilson(F.lit(18), F.lit(31))
    assert abs(value(spark, low) - 0.4077) < 1e-3 and abs(value(spark, high) - 0.7358) < 1e-3
    assert [value(spark, x) for x in stats.wilson(F.lit(0), F.lit(0))] == [0.0, 1.0]
    z = lambda *x: value(spark, stats.two_proportion_z(*map(F.lit, x)))
    assert z(5, 5, 5, 5) == 0.0 and z(1, 0, 1, 2) is None and z(18, 31, 29, 30) < -1.645
    k = lambda *x: value(spark, stats.kappa(*map(F.lit, x)))
    assert abs(k(20, 5, 10, 15) - 0.4) < 1e-12 and k(9, 0, 0, 0) == 1.0 and k(0, 0, 0, 0) is None and abs(k(1, 1, 1, 1)) < 1e-12
    assert abs(value(spark, stats.error_budget(F.lit(0.95), F.lit(0.9))) - 0.5) < 1e-9 and value(spark, stats.error_budget(F.lit(0.95), F.lit(1.0))) == 0.0
    ranks = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda x: x)
    assert [value(spark, stats.nearest_rank(ranks, p)) for p in (0.5, 0.9, 0.99)] == [51, 90, 99]


def test_length_buckets(spark):
    sizes = [None, 0, -3, 1, 2, 3, 4, 5, 512, 513, 2**29, 2**29 + 1, 2**39]
    df = spark.createDataFrame(list(enumerate(sizes)), "n int, t bigint")
    got = [r.v for r in df.select("n", stats.length_bucket(F.col("t")).alias("v")).orderBy("n").collect()]
    assert got == ["unknown"] * 3 + [f"<={2 ** max(0, (s - 1).bit_length())}" for s in sizes[3:]]


def test_message_shapes():
    blocks = [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_result", "content": [{"type": "text", "text": "ok"}]}, {"type": "text", "text": "c"}, {"type": "image"}]
    assert messages.content_text(blocks) == "ab\n[tool result] ok\nc" and messages.content_text(None) == "" and messages.content_text(5) == "5"
    assert messages.human_text(blocks) == "a\nb\nc" and messages.human_text([blocks[2]]) is None
    raw = json.dumps({"system": "s", "messages": [{"role": "assistant", "content": "x"}, {"role": "user", "content": ""}, {"role": "tool", "content": "t"}, {"role": "assistant", "content": [{"type": "text", "text": "y"}]}]})
    assert messages.request_messages(raw) == [{"role": "user", "content": "(empty)"}, {"role": "assistant", "content": "y"}]
    assert messages.request_text(raw) == "user: (empty)\n\nassistant: y" and messages.system_prompt(raw) == "s" and messages.request_messages("not json") == [{"role": "user", "content": "not json"}]
    both = messages.response(json.dumps({"choices": [{"message": {"content": "hi", "tool_calls": [{"function": {"name": "f", "arguments": '{"b": 1, "a": 2}'}}, {"function": {"name": "g", "arguments": "[]"}}]}}]}))
    assert both["text"] == "hi" and [(c["name"], c["input_keys"]) for c in both["tool_calls"]] == [("f", ["a", "b"]), ("g", [])]
    assert messages.inferred_tools(both["tool_calls"]) == [{"name": "f", "keys": ["a", "b"]}, {"name": "g", "keys": []}]
    assert messages.usage(json.dumps({"x": [{"usage": {"prompt_tokens": 12, "completion_tokens": 34}}]})) == {"tokens_in": 12, "tokens_out": 34}
    assert messages.sse_events("event: a\ndata: 1\ndata: 2\n\ndata: x") == [{"event": "a", "data": "1\n2"}, {"event": None, "data": "x"}]
    assert json.loads(messages.response_body("text/event-stream", "data: {\"a\": 1}\n\n")) == {"events": [{"event": None, "data": {"a": 1}}]} and json.loads(messages.response_body(None, "boo")) == {"raw_text": "boo"}
    assert messages.is_json("NaN") and not messages.is_json("1 2") and messages.parses_as_python("x = 1") and not messages.parses_as_python("x =")


def test_scorers(spark):
    df = spark.createDataFrame([(1, "{}", "[1]"), (2, "{}", "no"), (3, "--- a\n+++ b\n@@ -1 +1 @@", "text"), (4, "```python\nx = 1\n```", "```py\ny = 2\n```"), (5, "```python\nx = 1\n```", "none"), (6, "plain", "plain")], "n int, r string, c string")
    assert [r.v for r in df.select("n", scorers.format_check(F.col("r"), F.col("c")).alias("v")).orderBy("n").collect()] == [True, False, False, True, False, None]
    done = lambda c, r: value(spark, scorers.completion(F.lit(c), F.lit(r), F.lit(0)))
    assert done("yes", "ok") and not done(" ", "ok") and not done("I'm sorry, no", "ok") and done("Sorry", "sorry too")
    calls = lambda *x: F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, k)).alias("input_keys")) for n, k in x])
    t = lambda a, b: value(spark, scorers.trajectory(a, b))
    assert t(calls(("f", "ab")), calls(("f", "ab"))) == 1.0 and abs(t(calls(("f", "ab")), calls(("f", "a"))) - 0.85) < 1e-9 and t(calls(("f", "a")), calls(("g", "a"))) == 0.0
    assert value(spark, scorers.grounding(F.lit("see a_b and 42 and 77"), F.lit("a_b 42"), F.lit("x"))) == 1 - 1 / 3 and value(spark, scorers.grounding(F.lit("one 42"), F.lit(""), F.lit(""))) is None
    assert value(spark, scorers.heuristic_judge(F.lit("a b c d"), F.lit("A x B"))) and not value(spark, scorers.heuristic_judge(F.lit("a b c d"), F.lit("a"))) and value(spark, scorers.heuristic_judge(F.lit("!!"), F.lit("")))
    assert value(spark, tx.verdict_word(F.lit("pass? no: FAIL. Passed"))) == "FAIL" and value(spark, tx.verdict_word(F.lit("none"))) is None


def test_lcs(spark):
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(3)
    pairs = [("", ""), ("abc", ""), ("", "abc"), ("abcbdab", "bdcaba"), ("aaaa", "aa"), ("xyz", "abc"), ([None, "a"], [None, "a", None])]
    pairs += [([rng.choice("abcd"[:k]) for _ in range(rng.randint(0, 150))], [rng.choice("abcd"[:k]) for _ in range(rng.randint(0, 150))]) for k in (1, 2, 3, 4) for _ in range(15)]
    df = spark.createDataFrame([(i, list(a), list(b)) for i, (a, b) in enumerate(pairs)] + [(999, None, ["a"])], "n int, a array<string>, b array<string>")
    assert [r.v for r in df.select("n", tx.lcs_length(F.col("a"), F.col("b")).alias("v")).orderBy("n").collect()] == [plain(*p) for p in pairs] + [None]


def test_lcs_of_ten_thousand_calls():
    rng = random.Random(4)
    a, b = ([f"tool{rng.randint(0, 40)}" for _ in range(10_000)] for _ in range(2))
    began = time.time()
    n = tx.common_subsequence(a, b)
    assert time.time() - began < 1 and n == tx.common_subsequence(b, a) and 1000 < n < 10_000


def test_ulid(spark):
    made = value(spark, tx.ulid(F.lit(1_700_000_000_123), F.lit("x")))
    assert len(made) == 26 and value(spark, tx.ulid_millis(F.lit(made))) == 1_700_000_000_123
    assert value(spark, tx.ulid(F.lit(1_700_000_000_124), F.lit("x"))) > made


def test_components_of_paths_stars_and_crowds(spark):
    import random

    from tracelake.operators.mining import components

    rng = random.Random(4)
    names = rng.sample(range(10**6), 2400)
    path = [(names[i], names[i + 1]) for i in range(400)]
    star = [(names[500], names[k]) for k in range(501, 900)]
    crowd = [(names[1000 + rng.randrange(600)], names[1000 + rng.randrange(600)]) for _ in range(900)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in path + star + crowd] + path[:5]
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame([(n,) for n in names], "id bigint"), spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.id: r.component for r in got} == {n: root(n) for n in names} and len(got) == len(names)


def test_events_and_content_by_the_rules():
    assert messages.sse_events("event: ping\n\ndata: 1\ndata: 2\n\nevent: x\ndata: {}") == [{"event": None, "data": "1\n2"}, {"event": "x", "data": "{}"}]
    result = {"type": "tool_result", "content": "R"}
    said = lambda *blocks: messages.content_text(list(blocks))
    assert said(result, {"type": "text", "text": ""}) == "[tool result] R\n" and said({"type": "text", "text": ""}, result) == "[tool result] R"
    assert said("a", "b", result, result, "", "c") == "ab\n[tool result] R\n[tool result] R\nc" and said({"type": "image"}) == ""


def test_secret_flags_see_what_patterns_before_left(spark):
    text = "key AKIA" + "B" * 16 + " and password = abcdefghijklmnop1234 and token: " + "AKIA" + "C" * 16
    rows = spark.createDataFrame([(text,), ("nothing",), (None,)], "t string").select(tx.secret_flags(F.col("t")).alias("f"), tx.redact(F.col("t")).alias("r"), tx.scrub(F.col("t")).alias("s")).collect()
    assert rows[0].f == ["aws_access_key_id", "generic_kv_secret"] and rows[0].r.text == rows[0].s and rows[0].r.flags == rows[0].f
    assert rows[1].f == [] and rows[1].r.text == "nothing" and rows[2].f == []


def test_redaction_of_a_table_is_that_of_its_texts(spark):
    key = "A" + "KIA" + "ABCDEFGHIJKLMNOP"
    texts = [None, "", "plain", f"{key} and password = abcdefgh12345678", "sk-" + "ant-" + "a1b2c3d4e5f6g7h8i9j0k1", "deadbeef0123456789abcdef0123456789abcdefXYZ", f"token: {key}{key}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "`a.b` int, __r0 string")
    got = tx.redacted(rows, "__r0", "r")
    assert got.columns == ["a.b", "__r0", "r"]
    want = rows.select("`a.b`", tx.redact(F.col("__r0")).alias("r"))
    assert sorted(map(str, got.select("`a.b`", "r").collect())) == sorted(map(str, want.collect()))


def test_whole_suite_and_injected_judge(spark):
    calls = "array(named_struct('name', 'f', 'input_keys', array('a')))"
    cases = spark.sql(f"SELECT 1 AS id, 'q' AS request, 'yes' AS reference, '' AS candidate, {calls} AS reference_calls, {calls} AS candidate_calls UNION ALL SELECT 2, 'q', 'yes', 'yes', {calls}, array()")
    got = {(r.id, r.scorer): r for r in scorers.grade(cases, F.lit(True)).collect()}
    assert got[1, "trajectory"].value == 1.0 and got[1, "completion"].passed and got[1, "judge"].verdict == "pass"
    assert not got[2, "trajectory"].passed and got[2, "completion"].verdict == "fail" and (2, "format") not in got


def test_checks_judge_prompt_and_cost(spark):
    checks = {"json": messages.is_json_udf, "short": lambda t: tx.within_length(t, 1, 5)}
    rows = spark.createDataFrame([("[1]", True), ("[1, 2, 3]", True), ("no", False), (None, True)], "t string, j boolean").withColumn("v", scorers.deterministic_checks(F.col("t"), checks, {"json": F.col("j")})).withColumn("ok", scorers.all_pass(F.col("v"))).collect()
    assert [r.ok for r in rows] == [True, False, True, False] and [x.check_name for x in rows[0].v] == ["json", "short"]
    asked = value(spark, scorers.judge_prompt(F.lit("r {candidate}"), F.lit("good"), F.lit("other")))
    assert asked.count("other") == 1 and "r {candidate}" in asked and asked.index("good") < asked.index("other")
    answers = spark.createDataFrame([(1, "a", "no, FAIL. Or pass", "end", 1000, 10), (2, "x", "PASS then fail", "end", 1000, 10), (3, "a", "PASS", "refusal", 0, 10), (4, "b", "hm", None, 1, 1)], "id int, model string, text string, stop_reason string, tokens_in bigint, tokens_out bigint")
    prices = spark.createDataFrame([("a", False, 1.0, 2.0), ("b", False, 3.0, 1.0)], "model string, local boolean, price_in double, price_out double")
    got = {r.id: (r.passed, r.detail, round(r.cost_usd, 9)) for r in scorers.judge_verdicts(answers, prices).collect()}
    failed = "judge_error:JudgeError"
    assert got == {1: (True, None, 0.00102), 2: (False, None, 0.00301), 3: (False, failed, 0.00002), 4: (False, failed, 0.000004)}


def test_replay_tools_and_headers(spark):
    calls = [{"name": "f", "input_keys": ["b", "a"]}, {"name": "f", "input_keys": ["c"]}, {"name": "", "input_keys": []}]
    assert json.loads(messages.replay_tools('{"tools": [{"name": "g"}, {"name": ""}, 3]}', calls)) == [{"name": "g"}]
    assert json.loads(messages.replay_tools('{"tools": []}', calls)) == []
    made = json.loads(messages.replay_tools("not json", calls))
    assert [t["name"] for t in made] == ["f"] and list(made[0]["input_schema"]["properties"]) == ["a", "b", "c"]
    assert json.loads(messages.replay_tools(None, None)) == []
    headers = F.create_map(*[F.lit(x) for x in ("Host", "h", "X-Own", "1", "Transfer-Encoding", "chunked", "te", "x")])
    assert value(spark, messages.end_to_end_headers(headers)) == {"X-Own": "1"}


def test_embedding_of_any_width(spark):
    import hashlib

    from tracelake.operators.mining import hash_embedding

    words = ["alpha", "beta", "gamma", "alpha"]
    for dims in (1, 7, 256, 300, 2**31):
        want = {}
        for w in words:
            b = int(hashlib.md5(w.encode()).hexdigest(), 16) % dims
            want[b] = want.get(b, 0) + 1
        norm = sum(n * n for n in want.values()) ** 0.5
        got = hash_embedding(spark.createDataFrame([(1, " ".join(words)), (2, "--")], "id int, text string"), dims).collect()
        assert {r.bucket: round(r.weight, 9) for r in got} == {b: round(n / norm, 9) for b, n in want.items()} and {r.id for r in got} == {1}
