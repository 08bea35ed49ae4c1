"""Density clustering: core distances, the hierarchy of mutual reachability, condensed, and the stablest clusters of it.

Distances beyond the links given count as infinite. The hierarchy isn't built edge by edge: clusters of at least ``size``
points are what it is condensed to, so what is smaller only has to say when and where it falls out, in any order. In each round
every cluster looks at its lightest link. A small one whose link leads to a large one falls out of that at once: nothing that
the large one joins before then changes it but by name, which is looked up at the end. Two that are each other's lightest join:
small ones to a larger one, which is born large when it reaches ``size``, large ones to a parent. The lightest link of all is
always of these, and rounds grow with the depth of the condensed tree, not with the points. Rounds end when at most LAST links
are left, a number that doesn't grow with the data: those are merged in order, at once.

Pairs are never written: rows meet part by part, twice. First each meeting tells the nearest of every row, which make core
distances; then the lightest tree over its links, as no other link can be in that of all. So what is handed on grows as the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import similarity
from tracelake.operators.tables import drop, shared_table

#: Distances below this count as this, so that densities (their inverses) are finite.
CLOSEST = 1e-9
NODE, LINK = "struct<r:int,c:bigint>", "struct<w:double,a:bigint,b:bigint>"
#: Links between clusters that are merged in order by the driver, and clusters of a condensed tree that are weighed there. More than these go on in rounds and levels.
LAST, TREE = 1 << 18, 1 << 16


def core_distances(points: DataFrame, ends: DataFrame, neighbours: int) -> DataFrame:
    """(id, n, core): the distance within which a point has so many others; points that don't are left out.

    ``points`` (id, n) stand for n equal ones; ``ends`` (id, other, d) tell at least the ``neighbours`` nearest others of a point within reach.
    """
    met = ends.join(points.select(F.col("id").alias("other"), F.col("n").alias("m")), "other").join(points, "id")
    upto = F.sum("m").over(Window.partitionBy("id").orderBy("d", "other").rowsBetween(Window.unboundedPreceding, 0))
    near = met.withColumn("upto", upto + F.col("n") - 1).where((F.col("upto") >= neighbours) & (F.col("n") <= neighbours))
    alone = points.where(F.col("n") > neighbours).select("id", "n", F.lit(0.0).alias("core"))
    return near.groupBy("id", "n").agg(F.min("d").alias("core")).unionByName(alone)


def _nearest(meeting: similarity.Meeting, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, product): of each row the k others that are nearest of those that it meets and whose cosine reaches ``least``, and maybe more."""
    floor = max(least - meeting.slack, -1.5)
    reached = np.full(meeting.n, floor, np.float32)  # what the k-th nearest reaches at least
    x, y, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    new: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        nonlocal x, y, s
        p, q = (np.concatenate(e) for e in zip(*new, strict=True))
        new.clear()
        dots = meeting.exact(p, q)
        p, q, dots = p[dots >= least], q[dots >= least], dots[dots >= least]
        x, y, s = np.concatenate([x, p, q]), np.concatenate([y, q, p]), np.concatenate([s, dots, dots])
        order = np.lexsort((-s, x))
        x, y, s = x[order], y[order], s[order]
        place = np.arange(len(x)) - np.searchsorted(x, x)
        last = place == k - 1
        reached[x[last]] = np.maximum(reached[x[last]], s[last] - 2 * meeting.slack)
        x, y, s = x[place < k], y[place < k], s[place < k]

    for at, right, products in meeting.strips():
        rows, many = products.shape
        own = reached[at : at + rows]
        if many >= 16 * k:
            # the k-th of the best of some runs is no better than the k-th of all
            runs = products[:, : many // (4 * k) * (4 * k)].reshape(rows, 4 * k, -1).max(axis=2)
            own = np.maximum(own, np.partition(runs, -k, axis=1)[:, -k] - 2 * meeting.slack)
        r, c = np.nonzero(((products >= own[:, None]) | (products >= reached[right])) & (products >= floor))
        new.append((at + r, right[c]))
        if sum(len(e[0]) for e in new) >= max(1 << 18, meeting.n):
            settle()
    if new:
        settle()
    return x, y, s


def _nearest_batches(least: float, k: int):
    def work(meeting: similarity.Meeting) -> Iterator[pa.RecordBatch]:
        x, y, s = _nearest(meeting, least, k)
        yield similarity._batch(id=meeting.ids[x], other=meeting.ids[y], d=_distance(s))

    return work


def _distance(products: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * products, 0.0))


def lightest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, top): of links u-v between n nodes, the lightest first, those that join what no lighter ones do, and a name of each node's tree."""
    top, at, kept = np.arange(n), np.arange(len(u)), [np.zeros(0, np.int64)]
    while True:
        x, y = top[u[at]], top[v[at]]
        apart = x != y
        at, x, y = at[apart], x[apart], y[apart]
        if not len(at):
            return np.sort(np.concatenate(kept)), top
        best = np.full(n, len(u))
        np.minimum.at(best, x, at)
        np.minimum.at(best, y, at)
        trees = np.nonzero(best < len(u))[0]
        link = best[trees]
        kept.append(np.unique(link))
        p, q = top[u[link]], top[v[link]]
        to = np.arange(n)
        to[trees] = np.where(p == trees, q, p)
        top = _tops(to)[top]


def _tops(to: np.ndarray) -> np.ndarray:
    """Where the way from each node ends, if each goes to one other; of two that go to each other the smaller stays."""
    here = np.arange(len(to))
    to = np.where((to[to] == here) & (here < to), here, to)
    while not np.array_equal(above := to[to], to):
        to = above
    return to


def _heights(u: np.ndarray, v: np.ndarray, w: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The heaviest link on the way from one node of the largest tree to each other node over the links of the trees; infinite for nodes of other trees."""
    n = len(top)
    ends, to, weight = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w])
    order = np.argsort(ends, kind="stable")
    to, weight, start = to[order], weight[order], np.searchsorted(ends[order], np.arange(n + 1))
    height = np.full(n, np.inf)
    if not len(u):
        return height
    of = top[u]
    large = of == np.bincount(of).argmax()
    front = u[large][w[large].argmin()][None]
    height[front] = 0.0
    while len(front):
        many = start[front + 1] - start[front]
        place = np.repeat(start[front] - np.cumsum(many) + many, many) + np.arange(many.sum())
        there, high = to[place], np.maximum(np.repeat(height[front], many), weight[place])
        new = np.isinf(height[there])
        front = there[new]
        height[front] = high[new]
    return height


def _forest_batches(least: float, k: int):
    """Of a meeting, the links (a, b, w) of mutual reachability that a merge in the order of (w, a, b) would use; rows have their ``core``."""

    def work(meeting: similarity.Meeting) -> Iterator[pa.RecordBatch]:
        core = meeting.table.column("core").to_numpy()
        ids = meeting.ids
        x = y = np.zeros(0, np.int64)
        w = np.zeros(0)
        height = np.full(meeting.n, np.inf)
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle() -> None:
            nonlocal x, y, w, height
            p, q, weight = (np.concatenate([old, *more]) for old, more in zip((x, y, w), zip(*new, strict=True), strict=True))
            new.clear()
            a, b = np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])
            order = np.lexsort((b, a, weight))
            p, q, weight = p[order], q[order], weight[order]
            places, top = lightest(p, q, meeting.n)
            x, y, w = p[places], q[places], weight[places]
            height = _heights(x, y, w, top)

        def add(p: np.ndarray, q: np.ndarray, products: np.ndarray) -> None:
            weight = np.maximum(np.maximum(_distance(products), CLOSEST), np.maximum(core[p], core[q]))
            # two on one tree, each tied to one node by lighter links than this, need no other
            keep = (products >= least) & np.isfinite(weight) & (weight <= np.maximum(height[p], height[q]))
            new.append((p[keep], q[keep], weight[keep]))

        # the links to the nearest make a first tree, which leaves out most others
        p, q, products = _nearest(meeting, least, k)
        add(p, q, products)
        settle()
        for at, right, products in meeting.strips():
            rows = len(products)
            reach = np.maximum(1 - np.minimum(height, 2.0) ** 2 / 2, least) - meeting.slack - 1e-6
            reach = np.maximum(reach, -1.5).astype(np.float32)
            r, c = np.nonzero((products >= reach[at : at + rows, None]) | (products >= reach[right]))
            p, q = at + r, right[c]
            add(p, q, meeting.exact(p, q))
            if sum(len(e[0]) for e in new) >= max(1 << 18, meeting.n):
                settle()
        if new:
            settle()
        a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
        yield similarity._batch(a=a, b=b, w=w)

    return work


def spanning(links: DataFrame) -> DataFrame:
    """The links (a, b, w) that a merge of all in the order of (w, a, b) would use: in each round every cluster joins over its lightest.

    Rounds at least halve the clusters. At most LAST links, and the ways of at most LAST clusters, are followed by the driver.
    """
    left = shared_table(links.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("w", "a", "b").alias("e")), "links")
    kept: list[DataFrame] = []
    while left.count() > LAST:
        ends = left.select(F.col("x").alias("c"), F.col("y").alias("to"), "e").unionByName(left.select(F.col("y").alias("c"), F.col("x").alias("to"), "e"))
        best = shared_table(ends.groupBy("c").agg(F.min(F.struct("e", "to")).alias("b")).select("c", "b.e", "b.to"), "best")
        kept.append(best.select("e.*").distinct())
        tops = _followed(best.select("c", "to"))
        moved = left
        for end in ("x", "y"):
            moved = moved.join(tops.select(F.col("c").alias(end), "top"), end).withColumn(end, F.col("top")).drop("top")
        after = moved.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "e").groupBy("x", "y").agg(F.min("e").alias("e"))
        before, left = left, shared_table(after, "links")
        drop(before, tops)
    held = left.select("x", "y", "e.*").toArrow().sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")])
    names, ends = np.unique(np.concatenate([held.column("x").to_numpy(), held.column("y").to_numpy()]), return_inverse=True)
    places, _ = lightest(ends[: len(held)], ends[len(held) :], len(names))
    last = held.select(["w", "a", "b"]).take(pa.array(places))
    return _all([*kept, left.sparkSession.createDataFrame(last, "w double, a bigint, b bigint")]).select("a", "b", "w")


def _followed(ways: DataFrame) -> DataFrame:
    """(c, top): where the way from each cluster ends, from (c, to); of two that go to each other the smaller stays."""
    if ways.count() <= LAST:
        held = ways.toArrow().sort_by("c")
        c = held.column("c").to_numpy()
        top = c[_tops(np.searchsorted(c, held.column("to").to_numpy()))]
        return ways.sparkSession.createDataFrame(pa.table({"c": c, "top": top}), "c bigint, top bigint")
    back = ways.select(F.col("c").alias("to"), F.col("to").alias("next"))
    stays = (F.col("next") == F.col("c")) & (F.col("c") < F.col("to"))
    tops = shared_table(ways.join(back, "to").select("c", F.when(stays, F.col("c")).otherwise(F.col("to")).alias("top")), "tops")
    while True:
        further = tops.join(tops.select(F.col("c").alias("top"), F.col("top").alias("above")), "top")
        before, tops = tops, shared_table(further.select("c", F.col("above").alias("top"), (F.col("above") != F.col("top")).alias("moved")), "tops")
        drop(before)
        moving, tops_at = tops.where("moved").limit(1).count(), tops.shared_at
        tops = tops.drop("moved")
        tops.shared_at = tops_at
        if not moving:
            return tops


def _node(r, c) -> Column:
    return F.struct(F.lit(r).cast("int").alias("r"), c.alias("c"))


def hierarchy(points: DataFrame, links: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(falls, nodes) of points (id, n, core) and links (a, b, w) of mutual reachability.

    ``nodes`` (node, e, parent): clusters of ``size`` and more, the link (w, a, b) at which they came to be, and the one
    they join into. ``falls`` (id, n, node, e): the link at which a point leaves a cluster, and one that it leaves or that is in
    the one it leaves. Links are ordered by (w, a, b).
    """
    link = F.struct(F.greatest("w", F.lit(CLOSEST)).alias("w"), "a", "b")
    begun = F.struct(F.greatest("core", F.lit(CLOSEST)).alias("w"), F.lit(-1).cast("bigint").alias("a"), F.lit(-1).cast("bigint").alias("b"))
    start = shared_table(points.select("id", "n", begun.alias("e"), F.when(F.col("n") >= size, _node(0, F.col("id"))).alias("node")), "points")
    clusters = start.select(F.col("id").alias("c"), F.col("n").alias("size"), "node")
    falls = [start.where("node IS NOT NULL").select("id", "n", "node", "e")]
    born = [start.where("node IS NOT NULL").select("node", "e")]
    joined: list[DataFrame] = []
    pending = start.where("node IS NULL").select("id", "n", F.col("id").alias("c"))
    left = shared_table(links.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), link.alias("e")), "links")
    r = 0
    while left.count() > LAST:
        r += 1
        ends = left.select(F.col("x").alias("c"), F.col("y").alias("to"), "e").unionByName(left.select(F.col("y").alias("c"), F.col("x").alias("to"), "e"))
        best = ends.groupBy("c").agg(F.min(F.struct("e", "to")).alias("b")).select("c", "b.e", "b.to").join(clusters, "c")
        best = shared_table(best, "best")
        other = best.select(F.col("c").alias("to"), F.col("e").alias("e2"), F.col("size").alias("size2"), F.col("node").alias("node2"))
        both, same = best.join(other, "to"), F.col("e") == F.col("e2")
        small, small2 = F.col("node").isNull(), F.col("node2").isNull()
        kind = F.when(small & ~small2, "falls").when(same & small & small2, F.when(F.col("size") + F.col("size2") >= size, "born").otherwise("grows")).when(same & ~small & ~small2, "joins")
        into = F.when(kind == "falls", F.col("to")).otherwise(F.least("c", "to"))
        moves = both.withColumn("kind", kind).where("kind IS NOT NULL").select("c", into.alias("into"), "kind", "e", "node", "node2", (F.col("size") + F.col("size2")).alias("together"), F.when(F.col("kind") == "falls", F.col("node2")).otherwise(_node(r, into)).alias("new"))
        moves = shared_table(moves, "moves")
        # a small cluster may fall into a large one that joins another in the same round
        second = moves.where("kind = 'joins'").select(F.col("c").alias("into"), F.col("into").alias("last"))
        goes = moves.select("c", "into").join(second, "into", "left").select("c", F.coalesce("last", "into").alias("last"))
        moved = left
        for end in ("x", "y"):
            moved = moved.join(goes.select(F.col("c").alias(end), F.col("last").alias("moved")), end, "left").withColumn(end, F.coalesce("moved", end)).drop("moved")
        after = moved.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "e").groupBy("x", "y").agg(F.min("e").alias("e"))
        before, left = left, shared_table(after, "links")
        drop(before, best)
        kept = clusters.join(moves.select("c", "into", "kind", "together", "new"), "c", "left").where("kind IS NULL OR kind <> 'falls' AND c = into")
        changed = kept.select("c", F.when(F.col("kind").isin("born", "grows"), F.col("together")).otherwise(F.col("size")).alias("size"), F.when(F.col("kind").isin("born", "joins"), F.col("new")).otherwise(F.col("node")).alias("node"))
        # clusters without links are done with
        live = left.select(F.explode(F.array("x", "y")).alias("c")).distinct()
        before, clusters = clusters, shared_table(changed.join(live, "c", "left_semi"), "clusters")
        drop(before)
        out = shared_table(pending.join(moves.select("c", "into", "kind", "new", "e"), "c", "left"), "pending")
        falls.append(out.where("kind IN ('falls', 'born')").select("id", "n", F.col("new").alias("node"), "e"))
        pending = out.where("kind IS NULL OR kind = 'grows'").select("id", "n", F.coalesce("into", "c").alias("c"))
        born.append(moves.where("kind IN ('born', 'joins') AND c = into").select(F.col("new").alias("node"), "e"))
        joined.append(moves.where("kind = 'joins'").select("node", F.col("new").alias("parent")))
    last = _merged(left, clusters, size)
    gone = pending.sparkSession.createDataFrame(last["falls"], f"c bigint, node {NODE}, e {LINK}")
    falls.append(pending.join(gone, "c").select("id", "n", "node", "e"))
    born.append(pending.sparkSession.createDataFrame(last["born"], f"node {NODE}, e {LINK}"))
    joined.append(pending.sparkSession.createDataFrame(last["joins"], f"node {NODE}, parent {NODE}"))
    nodes = _all(born)
    nodes = nodes.join(_all(joined), "node", "left")
    return shared_table(_all(falls), "falls"), shared_table(nodes, "nodes")


def _merged(links: DataFrame, clusters: DataFrame, size: int) -> dict[str, list]:
    """What the last links (x, y, e) do to the clusters that they join, lightest first: small clusters that fall, clusters born, clusters that join."""
    out: dict[str, list] = {"falls": [], "born": [], "joins": []}
    held = links.select("x", "y", "e.*").toArrow().to_pydict()
    if not held["x"]:
        return out
    ends = links.select(F.explode(F.array("x", "y")).alias("c")).distinct()  # at most two a link
    sizes, node = {}, {}
    for row in clusters.join(ends, "c", "left_semi").toLocalIterator():
        sizes[row["c"]], node[row["c"]] = row["size"], row["node"] and tuple(row["node"])
    top, small = {c: c for c in sizes}, {c: [c] for c in sizes if node[c] is None}

    def root(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    for w, a, b, x, y in sorted(zip(held["w"], held["a"], held["b"], held["x"], held["y"], strict=True)):
        p, q = sorted((root(x), root(y)))
        if p == q:
            continue
        e, one, two = (w, a, b), node[p], node[q]
        if one and two:
            node[p] = (1 + max(one[0], two[0]), p)
            out["joins"] += [(one, node[p]), (two, node[p])]
            out["born"].append((node[p], e))
        elif one or two:
            out["falls"] += [(c, one or two, e) for c in small.pop(q if one else p)]
            node[p] = one or two
        else:
            small[p] += small.pop(q)
            sizes[p] += sizes[q]
            if sizes[p] >= size:
                node[p] = (1, p)
                out["born"].append((node[p], e))
                out["falls"] += [(c, node[p], e) for c in small.pop(p)]
        top[q] = p
    return out


def _all(parts: list[DataFrame]) -> DataFrame:
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return done


def _owners(falls: DataFrame, nodes: DataFrame, small: bool) -> DataFrame:
    """``falls`` with the cluster that a point leaves: the last one above that came to be before.

    A small tree is sent to the points; in a large one those climb together that can.
    """
    if small:
        tree = {(r, c): (parent and tuple(parent), (w, a, b)) for (r, c), parent, (w, a, b) in nodes.select("node", "parent", "e").collect()}

        def climb(batches):
            for batch in batches:
                at = []
                for node, e in zip(batch.column("node").to_pylist(), batch.column("e").to_pylist(), strict=True):
                    here, e = (node["r"], node["c"]), (e["w"], e["a"], e["b"])
                    while (above := tree[here][0]) and tree[above][1] < e:
                        here = above
                    at.append({"r": here[0], "c": here[1]})
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array(at, pa.struct([("r", pa.int32()), ("c", pa.int64())])), batch.column("e")], names=["id", "n", "node", "e"])

        return falls.select("id", "n", "node", "e").mapInArrow(climb, f"id bigint, n bigint, node {NODE}, e {LINK}")
    above = nodes.where("parent IS NOT NULL").select("node", "parent").join(nodes.select(F.col("node").alias("parent"), F.col("e").alias("at")), "parent").select("node", "parent", "at")
    done, moving = [], falls
    while True:
        step = shared_table(moving.join(above, "node", "left"), "climbing")
        higher = F.coalesce(F.col("at") < F.col("e"), F.lit(False))
        done.append(step.where(~higher).select("id", "n", "node", "e"))
        moving = step.where(higher).select("id", "n", F.col("parent").alias("node"), "e")
        if not moving.limit(1).count():
            return _all(done)


def stablest(falls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node): the chosen cluster of each point that is in one.

    The stability of a cluster is the sum over its points of the density at which they leave it, less that at which it parted from its
    sibling (none: 0). From below, a cluster is chosen if it is at least as stable as what is chosen within it; the only root of
    all never is. A point belongs to the highest chosen cluster that it is in, or that what it leaves is in.
    """
    small = nodes.count() <= TREE
    owned = shared_table(_owners(falls, nodes, small), "owned")
    birth = nodes.select(F.col("node").alias("parent"), (1 / F.col("e.w")).alias("birth"))
    tree = nodes.join(birth, "parent", "left").select("node", "parent", F.coalesce("birth", F.lit(0.0)).alias("birth"))
    own = owned.groupBy("node").agg(F.sum("n").alias("points"), F.sum(F.col("n") / F.col("e.w")).alias("density"))
    tree = shared_table(tree.join(own, "node", "left").fillna(0, ["points", "density"]), "tree")
    if small:
        labels = owned.sparkSession.createDataFrame(_weighed(tree.collect()), f"node {NODE}, label {NODE}")
        return owned.join(labels, "node").select("id", F.col("label").alias("node"))
    levels = sorted(r[0] for r in tree.select("node.r").distinct().collect())
    done: DataFrame | None = None
    for r in levels:
        level = tree.where(F.col("node.r") == r)
        if done is None:
            level = level.withColumn("below", F.lit(0)).withColumn("inner", F.lit(0.0)).withColumn("parts", F.lit(None).cast("double"))
        else:
            within = done.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum("total").alias("below"), F.sum(F.col("total") * F.col("birth")).alias("inner"), F.sum("value").alias("parts"))
            level = level.join(within, "node", "left").fillna(0, ["below", "inner"])
        total = F.col("points") + F.col("below")
        stability = F.col("density") + F.col("inner") - total * F.col("birth")
        chosen = F.col("parts").isNull() | (F.col("parts") <= F.col("stability") * (1 + 1e-9))
        level = level.withColumn("stability", stability).withColumn("total", total.cast("bigint")).withColumn("chosen", chosen).withColumn("value", F.when(F.col("chosen"), F.col("stability")).otherwise(F.col("parts")))
        level = shared_table(level.select("node", "parent", "birth", "total", "value", "chosen"), "level")
        done = level if done is None else done.unionByName(level)
    if done is None:
        return owned.select("id", "node")
    alone = done.where("parent IS NULL").limit(2).count() == 1
    told: DataFrame | None = None
    for r in reversed(levels):
        level = done.where(F.col("node.r") == r).select("node", "parent", "chosen")
        own = F.when(F.col("chosen") & ~(F.col("parent").isNull() & F.lit(alone)), F.col("node"))
        if told is None:
            level = level.select("node", own.alias("label"))
        else:
            level = level.join(told.select(F.col("node").alias("parent"), F.col("label").alias("above")), "parent", "left").select("node", F.coalesce("above", own).alias("label"))
        level = shared_table(level, "labels")
        told = level if told is None else told.unionByName(level)
    return owned.join(told.where("label IS NOT NULL"), "node").select("id", F.col("label").alias("node"))


def _weighed(tree: list) -> list[tuple]:
    """(node, label) of the clusters of a small tree that are in a chosen one, by the rules of :func:`stablest`."""
    rows = {tuple(t["node"]): t for t in tree}
    parent = {n: t["parent"] and tuple(t["parent"]) for n, t in rows.items()}
    within: dict[tuple, list] = {}
    total, value, chosen = {}, {}, {}
    for n in sorted(rows):
        t, below = rows[n], within.get(n, [])
        total[n] = t["points"] + sum(total[k] for k in below)
        stability = t["density"] + sum(total[k] * rows[k]["birth"] for k in below) - total[n] * t["birth"]
        parts = sum(value[k] for k in below)
        chosen[n] = not below or parts <= stability * (1 + 1e-9)
        value[n] = stability if chosen[n] else parts
        if parent[n]:
            within.setdefault(parent[n], []).append(n)
    alone = sum(p is None for p in parent.values()) == 1
    label: dict[tuple, tuple | None] = {}
    for n in sorted(rows, reverse=True):
        above = parent[n] and label[parent[n]]
        label[n] = above or (n if chosen[n] and (parent[n] or not alone) else None)
    return [(n, x) for n, x in label.items() if x]


def density_clusters(vectors: DataFrame, size: int = 3, least: float = -1.0) -> DataFrame:
    """(id, cluster) of dense vectors (id, v): the smallest id of a point's cluster, or -1.

    Distances are those of unit vectors (of zero ones: the square root of two to any other); ``size`` is both the least size of a cluster and the number of neighbours that
    makes a core distance. Pairs of a cosine below ``least`` are infinitely far apart: -1 leaves none out. Equal vectors are one point that counts as often. A null vector is in no cluster.
    """
    ones, parts, copies = similarity.dense_parts(vectors, least)
    held = ones if copies is None else ones.join(copies.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    points = held.select("id", F.lit(1).cast("bigint").alias("n") if copies is None else F.coalesce("n", F.lit(1)).alias("n"))
    ends = similarity.met(parts, _nearest_batches(least, size), "id bigint, other bigint, d double")
    cores = shared_table(core_distances(points, ends, size), "cores")
    # a point without a core distance takes part in no link
    cored = parts.rows.join(cores.select("id", "core"), "id", "left").withColumn("core", F.coalesce("core", F.lit(float("inf"))))
    links = spanning(similarity.met(parts, _forest_batches(least, size), "a bigint, b bigint, w double", cored))
    found = shared_table(stablest(*hierarchy(cores, links, size)), "found")
    named = found.join(found.groupBy("node").agg(F.min("id").alias("cluster")), "node").select("id", "cluster")
    whole = vectors.select("id") if copies is None else vectors.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    key = "id" if copies is None else "rep"
    return whole.join(named.withColumnRenamed("id", key), key, "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
