"""Similarity joins against all pairs, with copies, and what they look at."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.operators import mining, similarity


def sparse_rows(n=160, seed=1):
    """Vectors of topics over 400 buckets of very unequal frequency, one bucket that all have, copies, and an empty one (no rows)."""
    rng = random.Random(seed)
    rows = {}
    for i in range(n):
        topic = random.Random(f"{seed}{i % 25}")
        f = {0: rng.uniform(0.05, 0.5)}
        for _ in range(12):
            f[min(int(topic.expovariate(0.01)), 399)] = topic.uniform(0.5, 1) * rng.uniform(0.8, 1.2)
        for _ in range(rng.randint(0, 6)):
            f[rng.randint(0, 399)] = rng.uniform(0, 0.8)
        norm = sum(w * w for w in f.values()) ** 0.5
        rows[i] = {b: w / norm for b, w in f.items()}
    for i in range(n, n + 40):
        rows[i] = rows[7] if i % 2 else rows[11]
    return rows


def sparse_frame(spark, rows):
    return spark.createDataFrame([(i, b, w) for i, f in rows.items() for b, w in f.items()], "id bigint, bucket int, weight double")


def brute_sparse(rows, least):
    ids = sorted(rows)
    dot = lambda x, y: sum(w * y[b] for b, w in x.items() if b in y)
    return {(a, b): s for k, a in enumerate(ids) for b in ids[k + 1 :] if (s := dot(rows[a], rows[b])) >= least}


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_similar_pairs_are_all_pairs(spark, least, monkeypatch):
    monkeypatch.setattr(similarity, "PART", 20)  # cut buckets
    rows = sparse_rows()
    frame = sparse_frame(spark, rows)
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(frame, least).collect()}
    want = brute_sparse(rows, least)
    assert got.keys() == want.keys() and all(abs(got[p] - s) < 1e-9 for p, s in want.items())
    ids = spark.createDataFrame([(i,) for i in rows], "id bigint")
    comps = lambda links: {tuple(r) for r in mining.components(ids, links).collect()}
    assert comps(similarity.similar_links(frame, least)) == comps(spark.createDataFrame(list(want), "a bigint, b bigint"))


def test_prefixes_keep_out_common_buckets(spark):
    rows = sparse_rows(600)
    lists = similarity._lists(sparse_frame(spark, rows))
    ones, copies = similarity._classes(lists, ["buckets", "weights"])
    assert ones.count() == 600 and copies.count() == 42
    signed = similarity.signatures(ones, 0.8)
    assert signed.where("bucket = 0").count() == 0  # the one that all share
    met = signed.groupBy("bucket").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    distinct = {i: f for i, f in rows.items() if i < 600}
    sharing = sum(1 for a in distinct for b in distinct if a < b and distinct[a].keys() & distinct[b].keys())
    assert met < 0.25 * sharing  # a pair counts in each bucket where it meets
    # as many meetings as parts make, each row in each part's once
    small = similarity.PART
    similarity.PART = 10
    try:
        sent = similarity.meetings(signed).groupBy("bucket", "i", "j").agg(F.sum(1 - F.col("side")).alias("x"), F.sum("side").alias("y")).collect()
    finally:
        similarity.PART = small
    assert sum(r.x * (r.x - 1) / 2 if r.i == r.j else r.x * r.y for r in sent) == met


def test_similar_pairs_edges(spark):
    assert similarity.similar_pairs(sparse_frame(spark, {1: {5: 1.0}}), 0.5).count() == 0
    assert similarity.similar_pairs(spark.createDataFrame([], "id bigint, bucket int, weight double"), 0.5).count() == 0
    same = {i: {3: 0.6, 9: 0.8} for i in range(5)}
    assert similarity.similar_pairs(sparse_frame(spark, same), 0.99).count() == 10
    assert similarity.similar_links(sparse_frame(spark, same), 0.99).count() == 4
    with pytest.raises(ValueError):
        similarity.similar_pairs(sparse_frame(spark, same), 0.0)


def dense_rows(n=400, d=16, seed=2, spread=0.15):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, d))
    rows = [(i, (middle[i % 12] / np.linalg.norm(middle[i % 12]) + rng.normal(0, spread, d)).tolist()) for i in range(n)]
    return rows + [(n + k, rows[5][1]) for k in range(30)] + [(n + 30, [0.0] * d), (n + 31, None)]


def brute_dense(rows, least):
    rows = [(i, np.array(v)) for i, v in rows if v is not None]
    m = np.stack([v for _, v in rows])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    s = m @ m.T
    return {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if s[i, j] >= least}


@pytest.mark.parametrize(("least", "block"), [(0.9, 25), (0.4, 60), (0.9, 8192), (-1.0, 100)])
def test_dense_pairs_are_all_pairs(spark, least, block):
    rows = dense_rows()
    frame = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = [(r.a, r.b) for r in similarity.dense_pairs(frame, least, block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_dense(rows, least)
    if least == 0.9:
        ids = frame.select("id")
        comps = lambda links: {tuple(r) for r in mining.components(ids, links).collect()}
        assert comps(similarity.dense_links(frame, least, block)) == comps(spark.createDataFrame(got, "a bigint, b bigint"))


def test_far_groups_never_meet(spark):
    rows = dense_rows(1500, spread=0.03)
    ones = spark.createDataFrame([r for r in rows[:1500]], "id bigint, v array<double>")
    pivots = np.array([v for _, v in rows[:24]])
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    groups = similarity.placed(ones, pivots).groupBy("g").agg(F.min("angle"), F.max("angle"), F.count("*")).collect()
    plan = similarity.block_plan(np.array([[g // similarity.RINGS, low, high] for g, low, high, _ in groups]), pivots, 0.95)
    looked_at = sum(groups[i][3] * groups[j][3] for i, j in plan.tolist())
    assert looked_at < 0.15 * 1500 * 1500


def test_no_dense_vectors(spark):
    assert similarity.dense_pairs(spark.createDataFrame([], "id bigint, v array<float>"), 0.5).count() == 0


def test_parts_stay_few(spark):
    """A vector is sent to a number of meetings that doesn't grow with the rows (before: to one a block, of which there were as many as rows made)."""
    frame = spark.createDataFrame(dense_rows(600)[:600], "id bigint, v array<double>")
    parts = similarity.dealt(frame, 0.0, 5)
    assert max(j for _, j in parts.plan) < similarity.PARTS
    assert {r.id for r in parts.rows.collect()} == set(range(600))


def test_links_are_fewer_than_pairs(spark):
    """Parts that meet tell trees: fewer links than rows for each other part (before: all pairs)."""
    frame = spark.createDataFrame(dense_rows(300, spread=0.02)[:300], "id bigint, v array<double>")
    links = similarity.dense_links(frame, 0.9, 100).collect()
    comps = lambda found: {tuple(r) for r in mining.components(frame.select("id"), found).collect()}
    assert len(links) < 300 * 4 < len(brute := brute_dense(dense_rows(300, spread=0.02)[:300], 0.9))
    assert comps(spark.createDataFrame(links)) == comps(spark.createDataFrame(list(brute), "a bigint, b bigint"))


def test_noise_is_what_few_links_reach(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.02]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, None)], "id bigint, v array<double>")
    links = similarity.dense_links(frame, 0.35, 2)
    assert links.count() <= 4
    assert dict(mining.clusters(mining.components(frame.select("id"), links)).collect()) == {0: 0, 1: 0, 2: 0, 3: -1, 4: -1, 5: -1}


def test_products_held_at_once_are_bounded(monkeypatch):
    """A strip of a large part is cut (before: 256 rows by all others, which no cache holds), and its pairs are those of all."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(9000, 4))

    def meeting(n, left):
        table = pa.table({"id": pa.array(range(n), pa.int64()), "v": pa.array(v[:n].tolist()), "g": pa.array([i % 3 for i in range(n)], pa.int32()), "side": pa.array([int(i >= left) for i in range(n)])})
        return similarity.Meeting(table.to_batches(), np.ones((3, 3), bool))

    assert max(p.size for _, _, p in meeting(9000, 300).strips()) <= 1 << 20
    monkeypatch.setattr(similarity, "CELLS", 256 * 70)
    unit = v[:700] / np.linalg.norm(v[:700], axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= 0.8, 1)
    for left in (700, 290):
        some = meeting(700, left)
        got = [(min(a, b), max(a, b)) for x, y, _ in similarity._near(some, 0.8) for a, b in zip(some.ids[x].tolist(), some.ids[y].tolist(), strict=True)]
        want = near if left == 700 else near & (np.arange(700)[:, None] < left) & (np.arange(700) >= left)
        assert len(got) == len(set(got)) and set(got) == set(zip(*(e.tolist() for e in np.nonzero(want)), strict=True))


def counted(monkeypatch):
    """Rows that are sent to meetings from now on, a number for each use of the step."""
    sent, met = [], similarity.met

    def counting(parts, work, schema, rows=None):
        per = dict(parts.rows.groupBy("part").count().collect())
        sent.append(sum(per.get(p, 0) for i, j in parts.plan for p in {i, j}))
        return met(parts, work, schema, rows)

    monkeypatch.setattr(similarity, "met", counting)
    return sent


def test_rows_that_hang_together_are_sent_once(spark, monkeypatch):
    """Rows near enough to be one component meet in parts of their own and few rows (before: each row was sent to all parts)."""
    rows = [(i, v) for i, v in dense_rows(800, spread=0.02)[:800] if i % 12 == 0] + [(1000 + i, v) for i, v in dense_rows(800, spread=0.03)[:800] if i % 12 == 0]
    frame = spark.createDataFrame(rows, "id bigint, v array<double>")
    sent = counted(monkeypatch)
    links = similarity.dense_links(frame, 0.5, 16)
    assert {c for _, c in mining.components(frame.select("id"), links).collect()} == {0}
    assert sum(sent) < 2 * len(rows) and links.count() < 2 * len(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_what_is_not_reached_meets_all(spark, monkeypatch, seed):
    """A large component, rows that few of its rows are near, small groups, rows alone: components and noise are those of all pairs."""
    rng = np.random.default_rng(seed)
    axis = np.eye(64)
    rows = [axis[0] + rng.normal(0, 0.05, 64) for _ in range(200)]
    for k in range(1, 30):
        # a row alone, a pair, and a chain of rows that ends near one row of the large component only
        rows += [axis[k]] if k % 3 == 0 else [axis[k], axis[k] + 0.1 * axis[63]] if k % 3 == 1 else [axis[k], axis[k] + axis[k + 30], axis[k + 30] + axis[0], axis[0] + 0.3 * axis[k + 30]]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    frame = spark.createDataFrame(rows, "id bigint, v array<double>")
    want = spark.createDataFrame(sorted(brute_dense(rows, 0.6)), "a bigint, b bigint")
    sent = counted(monkeypatch)
    got = {tuple(r) for r in mining.components(frame.select("id"), similarity.dense_links(frame, 0.6, 24)).collect()}
    assert got == {tuple(r) for r in mining.components(frame.select("id"), want).collect()}
    # few rows among themselves, all with them, the rest with all
    assert len(sent) == 3 and len({c for _, c in got}) > 20


def test_repeated_ids_are_one_node(spark):
    """An id with several vectors joins what each of them is near, wherever these are dealt out."""
    rows = [(i % 40, v) for i, v in dense_rows(120, spread=0.05)[:120]]
    frame = spark.createDataFrame(rows, "id bigint, v array<double>")
    want = spark.createDataFrame(sorted(brute_dense(rows, 0.8)), "a bigint, b bigint")
    ids = frame.select("id").distinct()
    comps = lambda links: {tuple(r) for r in mining.components(ids, links).collect()}
    for block in (30, 64, 100):
        assert comps(similarity.dense_links(frame, 0.8, block)) == comps(want)


@pytest.mark.parametrize("wide", [1024, 0])
def test_common_buckets_meet_as_matrices(spark, monkeypatch, wide):
    """Vectors of few buckets meet once for each pair of parts (before: in every bucket that is rare for one of them), with equal results."""
    monkeypatch.setattr(similarity, "WIDE", wide)
    monkeypatch.setattr(similarity, "BLOCK", 70)
    rows = sparse_rows(180, 3)
    frame = sparse_frame(spark, rows)
    assert isinstance(similarity._sparse(frame, 0.6)[1], similarity.Parts) == bool(wide)
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(frame, 0.6).collect()}
    want = brute_sparse(rows, 0.6)
    assert got.keys() == want.keys() and all(abs(got[p] - s) < 1e-9 for p, s in want.items())
    comps = lambda links: {tuple(r) for r in mining.components(spark.createDataFrame([(i,) for i in rows], "id bigint"), links).collect()}
    assert comps(similarity.similar_links(frame, 0.6)) == comps(spark.createDataFrame(list(want), "a bigint, b bigint"))


@pytest.mark.parametrize("wide", [1024, 0])
@pytest.mark.parametrize(("x", "y", "reached"), [({0: 1, 1: 2, 2: 3, 3: 4, 4: 3, 50: 1}, {0: 3, 1: 2, 2: 3, 3: 1, 4: 4, 51: 1}, False), ({0: 4, 1: 1, 2: 2, 50: 2}, {0: 4, 1: 4, 2: 4, 51: 1}, True)])
def test_products_at_the_bound_are_added_from_the_rarest_bucket_on(spark, monkeypatch, wide, x, y, reached):
    """The cosine of both pairs is 0.8, and rounding decides (before: in the order of buckets, by which the first pair was found and the second not)."""
    monkeypatch.setattr(similarity, "WIDE", wide)
    unit = lambda f: {b: n / float(np.sqrt(sum(n * n for n in f.values()))) for b, n in f.items()}
    rows = {0: unit(x), 1: unit(y)}
    # the higher a common bucket, the rarer
    for b in x.keys() & y.keys():
        rows |= {len(rows) + k: {b: 0.6, 100 + 20 * b + k: 0.8} for k in range(20 - 2 * b)}
    total = 0.0
    for b in sorted(x.keys() & y.keys(), reverse=True):
        total += rows[0][b] * rows[1][b]
    got = similarity.similar_pairs(sparse_frame(spark, rows), 0.8).collect()
    assert (total >= 0.8) == reached and [tuple(r) for r in got] == ([(0, 1, total)] if reached else [])


def test_large_clusters_are_in_no_task_whole(spark):
    """Sizes go to the rows of large components (before: a window sent all rows of one to one task)."""
    labels = spark.createDataFrame([(i, 0) for i in range(50)] + [(60, 60), (61, 61), (62, 61)] + [(70 + i, 70) for i in range(3)], "id bigint, component bigint")
    found = mining.clusters(labels)
    assert dict(found.collect()) == {i: 0 for i in range(50)} | {60: -1, 61: -1, 62: -1, 70: 70, 71: 70, 72: 70}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert mining.clusters(labels.where("id < 0")).count() == 0
    assert {r.cluster for r in mining.clusters(spark.createDataFrame([(i, None) for i in range(2)], "id bigint, component bigint")).collect()} == {-1}
