"""Scorers of a candidate answer against a stored one, as column expressions, and the suite that grades by them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import cost, messages
from tracelake.functions import text as tx

#: Scorers in order: whether a failure fails the answer.
GATING = {"format": True, "completion": True, "trajectory": True, "grounding": False, "judge": True}
TRAJECTORY_LEAST, GROUNDING_LEAST, JUDGE_LEAST = 0.7, 0.8, 0.5


def _all_parse(blocks: Column) -> Column:
    # one value per row crosses to Python: blocks that parse one by one also parse as bodies of functions in a row
    return messages.all_parse_udf(blocks)


def format_check(reference: Column, candidate: Column) -> Column:
    """Whether the answer has the stored answer's format: JSON, a unified diff, or Python blocks; null for none of these."""
    blocks, own = tx.python_blocks(reference), tx.python_blocks(candidate)
    is_code = (F.size(blocks) > 0) & _all_parse(blocks)
    return F.when(messages.is_json_udf(reference), messages.is_json_udf(candidate)).when(tx.is_unified_diff(reference), tx.is_unified_diff(candidate)).when(is_code, (F.size(own) > 0) & _all_parse(own))


def completion(candidate: Column, reference: Column, calls: Column) -> Column:
    """An answer that says or calls something, and refuses only where the stored one does."""
    empty = (F.trim(candidate) == "") & (calls == 0)
    return ~(empty | tx.is_refusal(candidate) & ~tx.is_refusal(reference))


def trajectory(reference: Column, candidate: Column) -> Column:
    """Of arrays of (name, input_keys): 0.7 for the order of calls, 0.3 for the arguments of equal calls in equal places; null without calls."""
    names = lambda calls: F.transform(calls, lambda c: c["name"])
    m, n = F.size(reference), F.size(candidate)
    order = 2 * tx.lcs_length(names(reference), names(candidate)) / (m + n)
    alike = lambda a, b: F.when(a["input_keys"] == b["input_keys"], F.lit(1.0)).otherwise(tx.jaccard(a["input_keys"], b["input_keys"]))
    least = F.least(m, n)
    same = F.zip_with(F.slice(reference, 1, least), F.slice(candidate, 1, least), lambda a, b: F.when(a["name"] == b["name"], alike(a, b)))
    # sum and number in one pass
    total = F.aggregate(same, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda acc, p: F.struct((acc["sum"] + F.coalesce(p, F.lit(0.0))).alias("sum"), (acc["n"] + p.isNotNull().cast("int")).alias("n")))
    arguments = F.coalesce(F.aggregate(F.array(total), F.lit(None).cast("double"), lambda _, t: F.try_divide(t["sum"], t["n"])), F.lit(0.0))
    return F.when(m + n > 0, 0.7 * order + 0.3 * arguments)


def grounding(candidate: Column, request: Column, reference: Column) -> Column:
    """Share of the answer's details that the request or the stored answer holds; null below two details."""
    details = tx.specifics(candidate)
    known = F.lower(F.concat(request, F.lit("\n"), reference))
    missing = F.size(F.filter(details, lambda s: ~F.contains(known, F.lower(s))))
    return F.when(F.size(details) >= 2, 1 - missing / F.size(details))


def heuristic_judge(reference: Column, candidate: Column) -> Column:
    """Half of the stored answer's distinct tokens at least; without any, the answer must have none either."""
    want, got = F.array_distinct(tx.tokens(reference)), F.array_distinct(tx.tokens(candidate))
    return F.when(F.size(want) == 0, F.size(got) == 0).otherwise(F.size(F.array_intersect(want, got)) / F.size(want) >= JUDGE_LEAST)


def deterministic_checks(text: Column, checks: dict[str, Callable[[Column], Column]], applies: dict[str, Column] | None = None) -> Column:
    """Array of struct(check_name, passed, applicable), in the order of ``checks``, functions from the text to a boolean column.

    ``applies`` says by check whether it applies to a row; without a word it does. A check that gives null didn't pass.
    """
    applies = applies or {}
    return F.array(*[F.struct(F.lit(name).alias("check_name"), F.coalesce(check(text), F.lit(False)).alias("passed"), F.coalesce(applies.get(name, F.lit(True)), F.lit(False)).alias("applicable")) for name, check in checks.items()])


def all_pass(verdicts: Column) -> Column:
    """Whether every check that applies passed; without any, yes."""
    return F.forall(verdicts, lambda v: v["passed"] | ~v["applicable"])


#: Instructions to a judge that is asked in words; a change of them needs a new version, which goes into the stamps of verdicts.
JUDGE_VERSION = "v1"
JUDGE_PROMPT = """Two answers to one request are given. The first is known to be good. Decide by the rubric whether the
second may stand in for it.

Rubric:
{rubric}

Known good answer:
{frontier}

Answer to decide on:
{candidate}

Say PASS if it may, FAIL if not. Say nothing but that one word.
"""


def judge_prompt(rubric: Column, frontier: Column, candidate: Column, template: str = JUDGE_PROMPT) -> Column:
    """What a judge is asked: the template with its places filled; what is filled in is never read as a place."""
    parts = re.split(r"\{(rubric|frontier|candidate)\}", template)
    given = {"rubric": rubric, "frontier": frontier, "candidate": candidate}
    return F.concat(*[F.coalesce(given[p], F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def judge_verdicts(answers: DataFrame, prices: DataFrame) -> DataFrame:
    """``answers`` (model, text, stop_reason, tokens_in, tokens_out, ...) with cost_usd, passed and detail.

    The last PASS or FAIL word decides. A refusal, or an answer without such a word, fails with a detail; it costs all the
    same. A model that the price list lacks costs as much as the dearest in it.
    """
    failed = F.coalesce(F.col("stop_reason") == "refusal", F.lit(False)) | tx.verdict_word(F.col("text")).isNull()
    told = cost.priced(answers, prices, dearest=True)
    return told.withColumn("passed", F.when(failed, False).otherwise(tx.verdict_word(F.col("text")) == "PASS")).withColumn("detail", F.when(failed, "judge_error:JudgeError"))


def grade(cases: DataFrame, judge: Column | None = None) -> DataFrame:
    """Long rows (id, scorer, value, passed, verdict) of cases (id, request, reference, candidate); scorers that don't apply have none.

    Cases may have ``reference_calls`` and ``candidate_calls``, arrays of (name, input_keys): then the order and arguments
    of calls are scored, and an answer that only calls is complete. ``judge`` is a boolean column that takes the place of
    :func:`heuristic_judge` (a null of it: not judged). A failure of a scorer that gates fails the answer.
    """
    has = {"reference_calls", "candidate_calls"} <= set(cases.columns)
    calls = F.coalesce(F.size("candidate_calls"), F.lit(0)) if has else F.lit(0)
    none = F.array().cast("array<struct<name:string,input_keys:array<string>>>")
    order = trajectory(F.coalesce("reference_calls", none), F.coalesce("candidate_calls", none)) if has else F.lit(None).cast("double")
    wide = cases.select(
        "id",
        format_check(F.col("reference"), F.col("candidate")).alias("s_format"),
        completion(F.col("candidate"), F.col("reference"), calls).alias("s_completion"),
        order.alias("s_trajectory"),
        grounding(F.col("candidate"), F.col("request"), F.col("reference")).alias("s_grounding"),
        (heuristic_judge(F.col("reference"), F.col("candidate")) if judge is None else judge).alias("s_judge"),
    )
    least = {"trajectory": TRAJECTORY_LEAST, "grounding": GROUNDING_LEAST}

    def score(name: str) -> Column:
        own = F.col(f"s_{name}")
        return F.struct(F.lit(name).alias("scorer"), own.cast("double").alias("value"), (own >= least[name] if name in least else own).alias("passed"), F.lit(GATING[name]).alias("gating"))

    scores = F.filter(F.array(*map(score, GATING)), lambda s: s["value"].isNotNull())
    good = F.forall("scores", lambda s: s["passed"] | ~s["gating"])
    return wide.select("id", scores.alias("scores")).select("id", F.when(good, "pass").otherwise("fail").alias("verdict"), F.explode("scores").alias("s")).select("id", "s.scorer", "s.value", "s.passed", "verdict")
