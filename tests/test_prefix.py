"""Percentiles, budgets, sequential tests and matching in pieces and rounds against plain loops, with one group that holds most rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import mining, prefix


@pytest.fixture()
def many_pieces(spark, monkeypatch):
    """As on large tables: ranges aren't put together because they are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def nearest(values, p):
    values = sorted(values)
    return values[round(p * (len(values) - 1))] if values else None


def test_percentiles(spark, many_pieces):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.gauss(0, 5), 1.0, float(rng.randint(0, 4))])) for _ in range(6000)]
    rows += [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 9)), rng.random()])) for _ in range(300)]
    rows += [("one", 3.5), ("none", None), ("none", None), ("two", 1.0), ("two", 2.0)]
    shares = {"low": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99, "top": 1.0}
    frame = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.n, *[r[s] for s in shares]) for r in prefix.percentiles(frame, ["g"], "x", shares).collect()}
    want = {g: (len(v := [x for k, x in rows if k == g and x is not None]), *[nearest(v, p) for p in shares.values()]) for g in {g for g, _ in rows}}
    assert got == want
    whole = prefix.percentiles(frame, [], "x", shares).first()
    assert tuple(whole) == (len(v := [x for _, x in rows if x is not None]), *[nearest(v, p) for p in shares.values()])
    assert prefix.percentiles(frame.where("false"), ["g"], "x", shares).count() == 0
    assert prefix.cut(frame, ["g"], ["x"]).where("g = 'hot'").select(prefix.PIECE).distinct().count() > 3


@pytest.mark.parametrize("by", [None, ["g"]])
def test_budget(spark, many_pieces, by):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 0.0, rng.randint(1, 8) / 4])) for i in range(4000)]
    frame = spark.createDataFrame(rows, "n int, g string, cost_usd double")
    for budget in (0.0, 0.1, 37.5, 1000.0, 1e9):
        spent, want = {}, []
        for i, g, cost in rows:
            key = g if by else 0
            if spent.get(key, 0.0) < budget:
                spent[key] = spent.get(key, 0.0) + (cost or 0.0)
                want.append((i, spent[key]))
        got = sorted((r.n, r.spent) for r in prefix.within_budget(frame, budget, ["n"], by).collect())
        assert got == want
    assert prefix.within_budget(frame, 5.0, ["n"], by).columns == ["n", "g", "cost_usd", "spent"]


def serial(outcomes, p0=0.9, p1=0.8):
    n = k = 0
    for passed in outcomes:
        n, k = n + 1, k + bool(passed)
        llr = k * math.log(p0 / p1) + (n - k) * math.log((1 - p0) / (1 - p1))
        if abs(llr) >= math.log(0.95 / 0.05):
            return ("pass" if llr > 0 else "fail", n, k)
    return ("inconclusive", n, k)


def test_sequential_test_of_a_hot_pair(spark, many_pieces):
    rng = random.Random(3)
    pairs = {"even": [rng.random() < 0.855 for _ in range(9000)], "late": [i % 20 > 2 for i in range(8000)] + [False] * 40, "pass": [True] * 60, "fail": [False] * 9, "short": [True, None, False], None: [rng.random() < 0.8 for _ in range(500)]}
    rows = [(name, i, v) for name, outcomes in pairs.items() for i, v in enumerate(outcomes)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "pair string, n int, passed boolean")
    got = {r.pair: (r.state, r.n_samples, r.n_pass) for r in prefix.sprt(frame, ["pair"], ["n"]).collect()}
    assert got == {name: serial(outcomes) for name, outcomes in pairs.items()}
    assert prefix.cut(frame, ["pair"], ["n"]).where("pair = 'late'").select(prefix.PIECE).distinct().count() > 2
    with pytest.raises(ValueError):
        prefix.sprt(frame, ["pair"], ["n"], 0.8, 0.9)


def test_long_sequential_test_stops_where_the_loop_does(spark, many_pieces):
    """A million outcomes of one pair that stays undecided for most of them."""
    passed = (F.col("id") % 20 >= 3) & (F.col("id") < 900_000)
    one = spark.range(1_000_000).select(F.lit("x").alias("pair"), F.col("id").alias("n"), passed.alias("passed"))
    low, high = math.log(0.1 / 0.2), math.log(0.9 / 0.8)
    assert abs(17 * high + 3 * low) < 0.1  # hardly moves: decided late or at the end
    ids = np.arange(1_000_000)
    hit = (ids % 20 >= 3) & (ids < 900_000)
    way = np.cumsum(hit) * high + np.cumsum(~hit) * low
    stop = int(np.argmax(np.abs(way) >= math.log(19)))
    got = prefix.sprt(one, ["pair"], ["n"]).first()
    assert (got.state, got.n_samples, got.n_pass) == ("pass" if way[stop] > 0 else "fail", stop + 1, int(hit[: stop + 1].sum()))


def greedy(rows, least):
    taken, found = set(), {}
    for cluster, archetype, similarity in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        if similarity >= least and cluster not in found and archetype not in taken:
            found[cluster] = archetype
            taken.add(archetype)
    return found


@pytest.mark.parametrize(("clusters", "archetypes", "pairs"), [(40, 30, 600), (3000, 2500, 100_000)])
def test_matching_is_the_serial_one(spark, clusters, archetypes, pairs):
    rng = random.Random(clusters)
    rows = list({(c, a): (c, a, rng.randint(60, 100) / 100) for c, a in ((rng.randrange(clusters), f"a{rng.randrange(archetypes)}") for _ in range(pairs))}.values())
    frame = spark.createDataFrame(rows, "cluster bigint, archetype_id string, similarity double")
    assert {r.cluster: r.archetype_id for r in mining.match_identities(frame, 0.75).collect()} == greedy(rows, 0.75)


def test_matching_of_equal_wishes_and_none(spark):
    rows = [(c, a, {"x": 0.9, "y": 0.8, "z": 0.8}[a]) for c in range(4) for a in "xyz"]
    schema = "cluster bigint, archetype_id string, similarity double"
    assert {r.cluster: r.archetype_id for r in mining.match_identities(spark.createDataFrame([*rows, *rows], schema)).collect()} == {0: "x", 1: "y", 2: "z"}
    assert mining.match_identities(spark.createDataFrame([], schema)).count() == 0
