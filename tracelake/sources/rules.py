"""Rule files (YAML): candidates and objectives. A user's file replaces the defaults as a whole."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from tracelake.operators.reports import OPERATORS

CANDIDATE = "name string, provider string, model string, local boolean, price_in double, price_out double, position int"
OBJECTIVE = "name string, sli string, op string, threshold double, kind string, severity string, target double, window_days int, description string"


def _read(path: str, key: str) -> list[dict]:
    found = yaml.safe_load(Path(path).read_text()) or {}
    return found.get(key, []) if isinstance(found, dict) else found


def candidates(spark: SparkSession, path: str) -> DataFrame:
    rows = [(r["name"], r.get("provider"), r.get("model"), bool(r.get("local", False)), float(r.get("price_per_mtok_in", 0)), float(r.get("price_per_mtok_out", 0)), i) for i, r in enumerate(_read(path, "candidates"))]
    return spark.createDataFrame(rows, CANDIDATE)


def objectives(spark: SparkSession, path: str, indicators: set[str]) -> DataFrame:
    """Checked rules: known comparison, known indicator, and a target for every slo."""
    rows = []
    for r in _read(path, "objectives"):
        if r["op"] not in OPERATORS:
            raise ValueError(f"{r['name']}: unknown comparison {r['op']}")
        if r["sli"] not in indicators:
            raise ValueError(f"{r['name']}: unknown indicator {r['sli']}")
        if r.get("kind", "alert") == "slo" and r.get("target") is None:
            raise ValueError(f"{r['name']}: an slo needs a target")
        rows.append((r["name"], r["sli"], r["op"], float(r["threshold"]), r.get("kind", "alert"), r.get("severity", "warning"), r.get("target"), int(r.get("window_days", 28)), r.get("description", "")))
    return spark.createDataFrame(rows, OBJECTIVE)
