"""Grouping of traces: hashed embeddings, single-linkage components, medoids, stable identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import STOP_WORDS, tokens
from tracelake.operators.tables import drop, shared_table


def hash_embedding(docs: DataFrame, dims: int = 256) -> DataFrame:
    """Sparse unit vectors (id, bucket, weight): each token counts in the bucket of its MD5; texts without tokens have no row.

    The bucket is the digest, as a number of 128 bits, modulo ``dims`` (up to 2^31): taken 32 bits at a time.
    """
    if not 1 <= dims <= 1 << 31:
        raise ValueError("dims must be 1 to 2^31")
    each = docs.select("id", F.explode(tokens(F.col("text"))).alias("token")).withColumn("digest", F.md5("token"))
    rest = F.lit(0).cast("bigint")
    for at in (1, 9, 17, 25):
        rest = (rest * ((1 << 32) % dims) + F.conv(F.substring("digest", at, 8), 16, 10).cast("bigint")) % dims
    bucket = rest.cast("int")
    counts = each.groupBy("id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id")).cast("double"))
    return counts.select("id", "bucket", (F.col("n") / norm).alias("weight"))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles; 0 when either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that a node reaches over links (a, b); links may repeat and be given in either order.

    Rounds of two steps over the links until nothing moves: the larger neighbours of each node are hung on the least
    around it, then each node and its smaller neighbours on the least of these. Roots are hooked as well as leaves, so
    the number of rounds grows with the logarithm of the longest path. A hub's links are split by the adaptive skew join.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    tree = shared_table(links.where("a <> b").select(*ends).distinct(), "links")
    while True:
        around = tree.union(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        hung = shared_table(around.where("b > a").join(least, "a").select(F.col("low").alias("a"), "b").distinct(), "links")
        lowest = hung.groupBy("b").agg(F.min("a").alias("low"))
        after = hung.join(lowest, "b").select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b")
        before, tree = tree, shared_table(after.distinct(), "links")
        drop(before, hung)
        # settled when every node hangs on one root, and no root on another
        twice = tree.groupBy("b").count().where("count > 1").limit(1).count()
        if not twice and not tree.join(tree.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            break
    return nodes.join(tree.select(F.col("b").alias("id"), F.col("a").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def clusters(labels: DataFrame, least: int = 3) -> DataFrame:
    """Components of fewer than ``least`` members become -1.

    Those that hold a thousandth of all rows, a thousand at most, are sent to the rows, so that no task gets all members of one.
    """
    rows = shared_table(labels.select("id", "component"), "labels")
    sizes = shared_table(rows.groupBy(F.col("component").alias("of")).agg(F.count("*").alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    same = F.col("component").eqNullSafe(F.col("of"))
    told = rows.join(F.broadcast(sizes.where((F.col("size") >= least) & (F.col("size") * 1000 >= total))), same, "left")
    large = told.where("size IS NOT NULL").select("id", F.col("component").alias("cluster"))
    rest = told.where("size IS NULL").select("id", "component").join(sizes, same)
    return large.unionByName(rest.select("id", F.when(F.col("size") >= least, F.col("component")).otherwise(-1).alias("cluster")))


def medoids(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, id, score): the member most similar to the others, the lowest id among equals.

    For unit vectors the sum of similarities to the others is v * (sum of all) - v * v: linear in members.
    """
    rows = vectors.join(members.where("cluster <> -1"), "id")
    total = rows.groupBy("cluster", "bucket").agg(F.sum("weight").alias("s"))
    score = rows.join(total, ["cluster", "bucket"]).groupBy("cluster", "id").agg(F.sum(F.col("weight") * (F.col("s") - F.col("weight"))).alias("score"))
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 9)), "id")
    return score.withColumn("n", F.row_number().over(w)).where("n = 1").select("cluster", "id", "score")


def distances(vectors: DataFrame, members: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster, distance): one less the cosine to the medoid."""
    mid = centres.select("cluster", F.col("id").alias("m")).join(vectors.select(F.col("id").alias("m"), "bucket", F.col("weight").alias("wm")), "m")
    rows = members.where("cluster <> -1").join(vectors, "id").join(mid, ["cluster", "bucket"], "left")
    return rows.groupBy("id", "cluster").agg(F.greatest(F.lit(0.0), 1 - F.sum(F.col("weight") * F.coalesce("wm", F.lit(0.0)))).alias("distance"))


def match_identities(candidates: DataFrame, least: float = 0.75) -> DataFrame:
    """(cluster, archetype_id): one-to-one matches from (cluster, archetype_id, similarity), those of clusters in order, each taking its best free archetype.

    Of equal similarities the smaller archetype_id is better. Done in rounds: every cluster asks its best archetype left, an archetype
    holds on to the smallest cluster that ever asked it, and what it would refuse to later clusters goes. Nobody being refused, all hold
    what the clusters would have taken one by one: a cluster is refused only by an archetype that a smaller one gets.
    """
    left = shared_table(candidates.where(F.col("similarity") >= least).groupBy("cluster", "archetype_id").agg(F.max("similarity").alias("similarity")), "asking")
    while True:
        best = left.groupBy("cluster").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "archetype_id")).alias("b")).select("cluster", "b.archetype_id")
        held = best.groupBy("archetype_id").agg(F.min("cluster").alias("holder"))
        asked = shared_table(best.join(held, "archetype_id"), "asked")
        if not asked.where("cluster <> holder").limit(1).count():
            return asked.select("cluster", "archetype_id")
        holders = asked.select("archetype_id", "holder").distinct()
        before, left = left, shared_table(left.join(holders, "archetype_id", "left").where("holder IS NULL OR cluster <= holder").drop("holder"), "asking")
        drop(before, asked)


def keyword_labels(texts: DataFrame, k: int = 3, exemplars: int = 5) -> DataFrame:
    """(cluster, label) from texts (cluster, id, text): the k commonest telling words of its first exemplars, earliest first among equals."""
    first = texts.withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).where(F.col("n") <= exemplars)
    each = first.select("cluster", "n", F.posexplode(tokens(F.col("text"))).alias("pos", "token")).where((F.length("token") > 2) & ~F.col("token").isin(STOP_WORDS))
    counts = each.groupBy("cluster", "token").agg(F.count("*").alias("c"), F.min(F.struct("n", "pos")).alias("at"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "at"))).where(F.col("r") <= k)
    named = top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: F.initcap(x.token)), " ").alias("label"))
    return texts.select("cluster").distinct().join(named, "cluster", "left").withColumn("label", F.coalesce("label", F.lit("Unlabeled")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` that it doesn't replace: a snapshot to write over the table."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_archetypes(archetypes: DataFrame, assignments: DataFrame, source: str, target: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Both tables after ``source`` has gone into ``target``; into itself changes nothing."""
    if source == target:
        return archetypes, assignments
    hit = F.col("id") == source
    marked = archetypes.withColumn("merged_into", F.when(hit, F.lit(target)).otherwise(F.col("merged_into"))).withColumn("updated_ts", F.when(hit, F.lit(now_ms)).otherwise(F.col("updated_ts")))
    return marked, assignments.withColumn("archetype_id", F.when(F.col("archetype_id") == source, target).otherwise(F.col("archetype_id")))


def change_archetype(archetypes: DataFrame, which: str, now_ms: int, **values) -> DataFrame:
    """Rename or pin: the table with the named columns of one archetype set."""
    hit = F.col("id") == which
    for name, value in {**values, "updated_ts": now_ms}.items():
        archetypes = archetypes.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
    return archetypes
