"""Replay of samples through candidates: calls with retries, budgets, resume, chains; writers of routing rules."""

from __future__ import annotations

import difflib
import json
import time
from collections.abc import Callable
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

RESULT = "id string, archetype_id string, candidate string, source_trace_id string, response_text string, cost_usd double, latency_ms int, error string"


class RateLimited(Exception):
    """A provider asks for a pause."""


def call_with_retries(call: Callable, *args, retries: int = 3, pause: float = 0.1, sleep: Callable = time.sleep):
    """``call(*args)``, again after pauses that double while the provider is rate-limited; the last refusal is raised."""
    for attempt in range(retries + 1):
        try:
            return call(*args)
        except RateLimited:
            if attempt == retries:
                raise
            sleep(pause * 2**attempt)


def pending(work: DataFrame, done: DataFrame) -> DataFrame:
    """Work (id, candidate) without a result: the results table itself is the checkpoint."""
    return work.join(done.select(F.col("source_trace_id").alias("id"), "candidate"), ["id", "candidate"], "left_anti")


def replay(work: DataFrame, call: Callable[[str, str], dict], budget: float | None = None, spent: float = 0.0) -> DataFrame:
    """Results of ``call(candidate, prompt_text) -> {text, cost_usd, latency_ms}`` for work (id, archetype_id, candidate, prompt_text).

    Without a budget partitions run side by side. With one, rows run in order in a single task, as the rule
    "stop once the budget is spent" needs the cost of each call before the next; work lists are small then.
    """

    def run(frames):
        total = spent
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                if budget is not None and total >= budget:
                    break
                try:
                    got, error = call_with_retries(call, r.candidate, r.prompt_text), None
                except Exception as e:  # one failed call leaves the others
                    got, error = {}, type(e).__name__
                total += got.get("cost_usd") or 0.0
                rows.append((f"{r.id}:{r.candidate}", r.archetype_id, r.candidate, r.id, got.get("text"), got.get("cost_usd", 0.0), got.get("latency_ms"), error))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield out.astype({"latency_ms": "Int32"})

    ordered = work.repartition(1).sortWithinPartitions("id", "candidate") if budget is not None else work
    return ordered.select("id", "archetype_id", "candidate", "prompt_text").mapInPandas(run, RESULT)


def replay_chains(steps: DataFrame, call: Callable[[str, list], dict], budget: float | None = None) -> DataFrame:
    """One result per session and candidate from steps (session_id, candidate, step, prompt_text, reference).

    The history holds the candidate's own answers. The last step that ran is what will be graded; a chain whose
    first call fails has no result, and a budget stops a chain as it stops a list.
    """
    schema = "session_id string, candidate string, steps int, response_text string, reference string, cost_usd double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        history, total, last = [], 0.0, None
        for n, r in enumerate(frame.sort_values("step").itertuples(), 1):
            if budget is not None and total >= budget:
                break
            history.append({"role": "user", "content": r.prompt_text})
            try:
                got = call_with_retries(call, r.candidate, list(history))
            except Exception:
                break
            history.append({"role": "assistant", "content": got["text"]})
            total += got.get("cost_usd") or 0.0
            last = (r.session_id, r.candidate, n, got["text"], r.reference, total)
        return pd.DataFrame([last] if last else [], columns=[c.split()[0] for c in schema.split(", ")])

    return steps.groupBy("session_id", "candidate").applyInPandas(run, schema)


class RuleWriter:
    """A routing rule in a configuration file: ``preview`` shows a diff, ``write`` returns the file as it was, ``revert`` restores it."""

    def __init__(self, path: str | Path, kind: str):
        if kind not in ("litellm", "nanoclaw", "claude_code"):
            raise ValueError(f"unknown writer {kind}")
        self.path, self.kind = Path(path), kind

    def _text(self) -> str:
        return self.path.read_text() if self.path.exists() else ""

    def _load(self) -> dict:
        text = self._text()
        if self.kind == "litellm":
            return (yaml.safe_load(text) or {}) if text else {"model_list": []}
        return json.loads(text) if text else ({"rules": []} if self.kind == "nanoclaw" else {})

    def _dump(self, data: dict) -> str:
        return yaml.safe_dump(data, sort_keys=True) if self.kind == "litellm" else json.dumps(data, indent=2, sort_keys=True)

    def _with_rule(self, label: str, candidate: str) -> dict:
        data = self._load()
        if self.kind == "litellm":
            settings = data.setdefault("router_settings", {})
            settings["routing_rules"] = {**settings.get("routing_rules", {}), label: candidate}
        elif self.kind == "nanoclaw":
            data["rules"] = [r for r in data.get("rules", []) if r.get("archetype") != label] + [{"archetype": label, "route_to": candidate}]
        else:
            data["model"] = candidate
        return data

    def preview(self, label: str, candidate: str) -> str:
        lines = [self._dump(x).splitlines() for x in (self._load(), self._with_rule(label, candidate))]
        return "\n".join(difflib.unified_diff(*lines, fromfile="before", tofile="after", lineterm=""))

    def write(self, label: str, candidate: str) -> str:
        before, after = self._text(), self._dump(self._with_rule(label, candidate))
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(after)
        return before

    def revert(self, previous: str) -> None:
        self.path.write_text(previous)


def apply_policy(writer: RuleWriter, recommendation: Row, label: str, now_ms: int) -> dict:
    """Write a recommendation's rule; the row for applied_policies."""
    diff = writer.preview(label, recommendation["candidate"])
    before = writer.write(label, recommendation["candidate"])
    return {"id": f"p-{recommendation['id']}-{now_ms}", "archetype_id": recommendation["archetype_id"], "candidate": recommendation["candidate"], "writer": writer.kind, "diff": diff, "previous_content": before, "applied_ts": now_ms, "reverted_ts": None, "revert_reason": None}


def revert_policy(writer: RuleWriter, policies: DataFrame, which: str, reason: str, now_ms: int) -> DataFrame:
    """The policies table after ``which`` is taken back; unknown and already reverted ones raise."""
    row = policies.where((F.col("id") == which) & F.col("reverted_ts").isNull()).first()
    if row is None:
        raise KeyError(which)
    writer.revert(row["previous_content"])
    hit = F.col("id") == which
    return policies.withColumn("reverted_ts", F.when(hit, F.lit(now_ms)).otherwise(F.col("reverted_ts"))).withColumn("revert_reason", F.when(hit, F.lit(reason)).otherwise(F.col("revert_reason")))


def record_review(reviews: DataFrame, which: str, verdict: str, now_ms: int) -> DataFrame:
    """The reviews table with a person's verdict; an id that isn't queued raises."""
    if verdict not in ("pass", "fail"):
        raise ValueError("verdict is pass or fail")
    if not reviews.where(F.col("replay_result_id") == which).limit(1).count():
        raise KeyError(which)
    hit = F.col("replay_result_id") == which
    return reviews.withColumn("human_verdict", F.when(hit, F.lit(verdict)).otherwise(F.col("human_verdict"))).withColumn("reviewed_ts", F.when(hit, F.lit(now_ms)).otherwise(F.col("reviewed_ts")))
