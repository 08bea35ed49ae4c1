"""Every registered query of the trace model against its SQL on the smallest tables."""

import ast
import json
import os
import re

import duckdb
import pytest

from tests.test_density import brute
from tracelake.functions import text as tx
from tracelake.plans import adapters
from tracelake.plans import queries as plans

FOLDER = os.environ.get("TRACELAKE_TABLES", "/root/testdata/sf0.001")


def tidy(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: ("nan" if x != x else round(x, 6) + 0.0) if isinstance(x, float) else int(x) if isinstance(x, bool) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return con


def parses(f, text):
    try:
        f(text)
    except (ValueError, SyntaxError):
        return False
    return True


def same_format(reference, candidate):
    blocks = lambda t: re.findall(r"```(?:python|py)\s*\n(.*?)```", t, re.DOTALL)
    diff = lambda t: "---" in t and "+++" in t and bool(re.search(tx.DIFF_HUNK, t))
    code = lambda t: bool(blocks(t)) and all(parses(ast.parse, b) for b in blocks(t))
    for known in (lambda t: parses(json.loads, t), diff, code):
        if known(reference):
            return known(candidate)
    return None


def cases(con):
    return con.execute(f"WITH {adapters.SQL_VIEWS}, {plans._CASES} SELECT id, request, reference, candidate FROM cases").fetchall()


def formats(con):
    told = [(i, json.dumps({"id": i}, separators=(",", ":")) if len(r) % 3 == 0 else r, c) for i, _, r, c in cases(con)]
    return [(i, same_format(r, c)) for i, r, c in told]


def suite(con):
    """Every scorer in plain Python; cases have no calls."""
    refuses = lambda t: bool(re.search(tx.REFUSAL, t[:200]))
    words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    out = []
    for i, request, reference, candidate in cases(con):
        scores = {"format": same_format(reference, candidate), "completion": not (not candidate.strip(" ") or refuses(candidate) and not refuses(reference))}
        found = {d for p, group in tx.SPECIFICS for m in re.finditer(p, candidate) if len(d := m[group].strip(" ").rstrip(".,;:")) >= 2}
        known = f"{request}\n{reference}".lower()
        scores["grounding"] = 1 - sum(d.lower() not in known for d in found) / len(found) if len(found) >= 2 else None
        want = words(reference)
        scores["judge"] = len(want & words(candidate)) / len(want) >= 0.5 if want else not words(candidate)
        passed = {k: v >= 0.8 if k == "grounding" else v for k, v in scores.items() if v is not None}
        verdict = "pass" if all(v for k, v in passed.items() if k != "grounding") else "fail"
        out += [(i, k, round(float(scores[k]), 6), passed[k], verdict) for k in passed]
    return out


def density(con):
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    return list(brute(rows, 3, 0.2).items())


#: Rows of the queries that SQL can't say, by plain Python, in the order of the queries' columns.
PLAIN = {"format_check": formats, "suite_grades": suite, "density_clusters": density}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", plans.QUERIES)
def test_query(spark, oracle, name):
    got = plans.QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in got.collect()]
    if name not in plans.SQL:
        assert rows and tidy(rows, got.columns) == tidy(PLAIN[name](oracle), got.columns)
        return
    want = oracle.execute(plans.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert tidy(rows, got.columns) == tidy(want.fetchall(), columns)


def test_trajectory_compares_all_tokens(spark, monkeypatch):
    rows = [(1, "", "aa bb cc dd ee ff gg hh", "aa bb cc dd ee ff xx yy"), (2, "", "aa bb cc dd ee ff gg hh", "aa bb cc dd ee ff gg hh")]
    monkeypatch.setattr(plans, "_cases", lambda s, d: s.createDataFrame(rows, "id int, request string, reference string, candidate string"))
    assert {r.id: r.value for r in plans.trajectory(spark, "").collect()} == {1: 0.825, 2: 1.0}
