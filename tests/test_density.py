"""Density clustering against the textbook: a sorted merge of all links, a condensed tree from above, the excess of mass."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tracelake.operators import density, similarity


def brute(rows, size, least):
    """Labels by id. Distances beyond ``least`` are infinite: every component of the links is a child of one root."""
    ids = [i for i, v in rows if v is not None]
    m = np.array([v for _, v in rows if v is not None], float)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    cos = np.clip(unit @ unit.T, -1, 1)
    same = (m[:, None] == m[None]).all(axis=2)
    d = np.sqrt(np.maximum(2 - 2 * cos, 0))
    d[cos < least] = np.inf
    d[same] = 0
    core = np.array([np.sort(np.delete(d[k], k))[size - 1] if len(ids) > size else np.inf for k in range(len(ids))])
    rep = {k: min(j for j in range(len(ids)) if same[k, j]) for k in range(len(ids))}
    links = sorted((max(d[i, j], core[i], core[j], 1e-9), -1 if rep[i] == rep[j] else ids[rep[i]], -1 if rep[i] == rep[j] else ids[rep[j]], i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if max(d[i, j], core[i], core[j]) < np.inf)
    # single linkage: a merge tree per component
    top = list(range(len(ids)))
    tree, points = {}, {k: [k] for k in range(len(ids))}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for w, _, _, i, j in links:
        x, y = root(i), root(j)
        if x != y:
            new = len(top)
            top.append(new)
            top[x] = top[y] = new
            tree[new], points[new] = (w, x, y), points[x] + points[y]
    roots = [x for x in {root(k) for k in range(len(ids))} if len(points[x]) >= size]
    # from above: what is smaller than size falls out, two large parts are new clusters
    birth, leaves, children = {}, defaultdict(list), defaultdict(list)
    stack = [(x, x, 0.0) for x in roots]
    for x, _, lam in stack:
        birth[x] = lam
    while stack:
        x, cluster, _ = stack.pop()
        if x not in tree:
            continue
        w, *sides = tree[x]
        large = [s for s in sides if len(points[s]) >= size]
        for s in sides:
            if s not in large:
                leaves[cluster] += [(p, 1 / w) for p in points[s]]
            elif len(large) == 2:
                birth[s] = 1 / w
                children[cluster].append(s)
                stack.append((s, s, 1 / w))
            else:
                stack.append((s, cluster, 0.0))
    value, chosen = {}, {}
    for c in sorted(birth, key=lambda c: len(points[c])):
        stability = sum(lam - birth[c] for _, lam in leaves[c]) + sum(len(points[k]) * (birth[k] - birth[c]) for k in children[c])
        parts = sum(value[k] for k in children[c])
        chosen[c] = not children[c] or parts <= stability * (1 + 1e-9)
        value[c] = stability if chosen[c] else parts
    labels = dict.fromkeys((i for i, _ in rows), -1)
    stack = list(roots)
    while stack:
        c = stack.pop()
        if chosen[c] and not (len(roots) == 1 and c in roots):
            name = min(ids[p] for p in points[c])
            labels |= {ids[p]: name for p in points[c]}
        else:
            stack += children[c]
    return labels


def blobs(seed, n=80, d=3, noise=20):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, d))
    spread = rng.choice([0.02, 0.08, 0.2, 0.3], 6)
    rows = [(i, (middle[i % 6] + rng.normal(0, spread[i % 6], d)).tolist()) for i in range(n)]
    return rows + [(n + i, rng.normal(size=d).tolist()) for i in range(noise)]


def run(spark, rows, size, least):
    return {r.id: r.cluster for r in density.density_clusters(spark.createDataFrame(rows, "id bigint, v array<double>"), size, least).collect()}


@pytest.mark.parametrize(("seed", "size", "least", "last", "tree"), [(1, 3, -1.0, None, None), (2, 5, -1.0, None, None), (3, 4, 0.95, 0, 0), (1, 3, -1.0, 300, None)])
def test_density_clusters(spark, monkeypatch, seed, size, least, last, tree):
    """``last`` and ``tree`` say how much is left to the end: nothing, or all."""
    if last is not None:
        monkeypatch.setattr(density, "LAST", last)
    if tree is not None:
        monkeypatch.setattr(density, "TREE", tree)
    rows = blobs(seed)
    want = brute(rows, size, least)
    assert len(set(want.values())) > 2
    assert run(spark, rows, size, least) == want


@pytest.mark.parametrize("last", [0, 1 << 18])
def test_copies_chains_and_odd_rows(spark, monkeypatch, last):
    monkeypatch.setattr(density, "LAST", last)
    rows = blobs(4, 60, 3, 10)
    rows += [(200 + k, rows[0][1]) for k in range(8)] + [(300 + k, rows[1][1]) for k in range(2)] + [(400, None)]
    # points on a line, ever further apart: they fall out one by one
    rows += [(500 + k, [math.cos(0.001 * k * k), math.sin(0.001 * k * k), 9.0 * 0]) for k in range(25)]
    assert run(spark, rows, 4, -1.0) == brute(rows, 4, -1.0)


def test_few_points_and_none(spark):
    assert run(spark, blobs(5, 3, 3, 0), 3, -1.0) == {0: -1, 1: -1, 2: -1}
    assert density.density_clusters(spark.createDataFrame([], "id bigint, v array<float>")).count() == 0
    two = [(i, [1.0, 0.0]) for i in range(5)] + [(10 + i, [0.0, 1.0]) for i in range(5)]
    assert run(spark, two, 3, 0.5) == {i: 0 if i < 10 else 10 for i, _ in two}


@pytest.mark.parametrize("least", [-1.0, 0.9])
def test_meetings_of_parts_tell_few_links(spark, monkeypatch, least):
    """Many parts give what one does, and no table holds the pairs within reach (before: all of them)."""
    parts, table, written = similarity.dense_parts, density.shared_table, []
    monkeypatch.setattr(similarity, "dense_parts", lambda v, least: parts(v, least, 60))

    def counted(df, tag):
        found = table(df, tag)
        written.append(found.count())
        return found

    monkeypatch.setattr(density, "shared_table", counted)
    rows = blobs(6, 140, 3, 20)
    assert run(spark, rows, 3, least) == brute(rows, 3, least)
    if least == -1.0:
        assert max(written) <= 160 * 5 < 160 * 159 / 2
