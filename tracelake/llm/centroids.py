"""Centroid clustering of integer vectors: rounds of exact assignment behind a screen of block norms.

A vector is compressed to the norms of its segments, once. By the Cauchy-Schwarz inequality in each segment the squared
distance to a centroid is at least the sum over segments of the squared difference of the norms, which costs an eighth of a
distance. The centroid of the least bound is measured first; of the others only those are measured whose bound doesn't
exceed the best exact distance so far. Distances are integers, and bounds give way by more than rounding can do, so the
result is that of measuring all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import discard, stored, tidy

#: Components in a segment.
SEGMENT = 8
#: Integers of a component stay below this in size: then a squared distance of up to 64 components fits into a long.
LARGEST = 1 << 27


def segment_norms(v: np.ndarray) -> np.ndarray:
    """Norms of the segments of integer rows; the last segment may be shorter."""
    starts = np.arange(0, v.shape[1], SEGMENT)
    return np.sqrt(np.add.reduceat(v.astype(np.float64) ** 2, starts, axis=1))


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray, own: np.ndarray, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each row of ``v``; of equals the smaller number.

    ``norms`` and ``own`` are the segment norms of rows and centroids. ``counted`` gets the number of distances measured.
    """
    size, sizes = (norms**2).sum(axis=1), (own**2).sum(axis=1)
    least = size[:, None] + sizes[None, :] - 2 * norms @ own.T
    least -= 1e-9 * (size[:, None] + sizes[None, :]) + 1e-6
    who = least.argmin(axis=1)
    gap = v - centroids[who]
    best = np.einsum("ij,ij->i", gap, gap)
    measured = len(v)
    for j in range(len(centroids)):
        rows = np.nonzero((least[:, j] <= best) & (who != j))[0]
        if len(rows):
            measured += len(rows)
            gap = v[rows] - centroids[j]
            far = np.einsum("ij,ij->i", gap, gap)
            better = (far < best[rows]) | ((far == best[rows]) & (j < who[rows]))
            who[rows[better]], best[rows[better]] = j, far[better]
    if counted is not None:
        counted.append(measured)
    return who, best


def integer_vectors(vectors: DataFrame, id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, v, norms) of the rows whose vector has exactly ``dims`` components, all finite: floor(scale * x) and segment norms.

    Also left out are vectors with a component of LARGEST or more in size after scaling, whose distances needn't fit a long.
    """
    kind = vectors.schema[id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            right = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
            x = lists.filter(right).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(x * scale)
                good = (np.abs(whole) < LARGEST).all(axis=1)
            v = whole[good].astype(np.int32)
            norms = segment_norms(v)
            each = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), t))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(right).filter(pa.array(good)), each(v, pa.int32()), each(norms, pa.float64())], names=["id", "v", "norms"])

    return vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v")).mapInArrow(tidy(run), f"id {kind}, v array<int>, norms array<double>")


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _measured(batches, centroids: np.ndarray):
    """(batch, numbers, distances) of each batch of (id, v, norms)."""
    own, dims = segment_norms(centroids), centroids.shape[1]
    for batch in batches:
        v = _matrix(batch.column(1), dims).astype(np.int64)
        yield batch, v, *nearest(v, _matrix(batch.column(2), own.shape[1]), centroids, own)


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of those nearest, component by component; one without any stays.

    Each task adds up its rows, so a row a centroid and task is shuffled, and one a centroid comes to the driver.
    """
    count, dims = centroids.shape

    def run(batches):
        n, sums = np.zeros(count, np.int64), np.zeros((count, dims), np.int64)
        for _, v, who, _ in _measured(batches, centroids):
            n += np.bincount(who, minlength=count)
            for j in np.unique(who):
                sums[j] += v[who == j].sum(axis=0)
        there = np.nonzero(n)[0]
        yield pa.RecordBatch.from_pydict({"c": pa.array(there, pa.int32()), "n": pa.array(n[there]), "s": pa.array(list(sums[there]), pa.list_(pa.int64()))})

    parts = table.mapInArrow(tidy(run), "c int, n bigint, s array<bigint>")
    after = centroids.copy()
    for row in parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims)]).collect():
        after[row[0]] = [x // row[1] for x in row[2:]]
    return after


def cluster(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", count: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row a kept vector; other columns are left aside.

    Kept are vectors as :func:`integer_vectors` says. The first centroids are the ``count`` kept rows of least SHA-256 of seed,
    colon and id (a null id counts as an empty one; of equal ids the lesser vector first), so repeated rows may make equal
    centroids, of which the smaller number takes all. With fewer rows than ``count`` there are as many centroids as rows; no
    rows give no result. The vectors and their norms are written once to the shared folder and read in each round, the
    assignments once; what comes to the driver are ``count`` rows of sums a round.
    """
    spark = vectors.sparkSession
    table = stored(integer_vectors(vectors, id, vector, dims, scale), "vectors")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = table.select(draw.alias("draw"), "v").orderBy("draw", "v").limit(count).collect()
    kind = vectors.schema[id].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"`{id}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = moved(table, centroids)

    def run(batches):
        for batch, _, who, far in _measured(batches, centroids):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who, pa.int32()), pa.array(far)], names=["id", "cluster", "distance"])

    done = stored(table.mapInArrow(tidy(run), f"id {kind}, cluster int, distance bigint"), "assigned")
    discard(table)
    sums = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    told = [(j, sums[j], hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j in sorted(sums)]
    each = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    # a row a centroid is sent
    return done.join(F.broadcast(each), "cluster").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("bigint").alias("inertia"), "centroid_sha256")
