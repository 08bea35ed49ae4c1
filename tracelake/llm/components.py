"""Connected components of a graph whose links are rows: no link, component or node reaches the driver.

Each partition first keeps a spanning forest of its own links (union-find over so many nodes at a time);
then rounds of the large-star and small-star steps run as joins, each round written
to the shared folder. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import discard, stored, tidy


#: Nodes that a task holds at one time; what it has found of links between them is handed on when there are more.
HELD = 1_000_000


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) of each partition reduced to a star from the smallest node of each tree."""

    def reduce(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > HELD:
                yield from stars(parent, root)
                parent.clear()
        yield from stars(parent, root)

    def stars(parent, root):
        rows = [(root(x), x) for x in parent if root(x) != x]
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).mapInArrow(tidy(reduce), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root): for each node of a link (a, b) the smallest node it is connected to.

    Nodes and roots are bigint. Links may repeat, be given in either order or join a node with itself;
    rows with a null end join nothing and are left out. No links: no rows. Rounds go on until nothing moves:
    each round lowers a node's parent or ends, so they end whatever the graph.
    """
    whole = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    star = stored(forest(whole).distinct(), "links", 2 * links.count())
    nodes = 2 * star.count()
    while True:
        # star: (a, b) with a < b. First every larger neighbour of a node moves to the least around that node ...
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).union(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # (a hub's links are split by the adaptive skew join: the other side has one row a node)
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "links", nodes)
        # ... then every node and its smaller neighbours move to the least of these
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b")
        after = stored(small.distinct(), "links", nodes)
        # done when every node hangs on one root that hangs on none
        moved = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() or after.groupBy("b").count().where("count > 1").limit(1).count()
        discard(star, large, shuffles=False)
        star = after
        if not moved:
            break
    return star.select(F.col("b").alias("node"), F.col("a").alias("root")).union(star.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
