"""Ordered work on groups of any size: rows are cut by ranges of their order, and what a piece needs of those before it is a sum.

One group may hold most rows: it is then in many pieces, each in a task of its own, and only sums of pieces meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.stats import sprt_step
from tracelake.operators.tables import shared_table

PIECE = "__piece"


def cut(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with the number of their piece: pieces are ranges of (by, order), numbered in that order."""
    return shared_table(rows.repartitionByRange(*by, *order).withColumn(PIECE, F.spark_partition_id()), "pieces")


def _of_pieces(rows: DataFrame, pieces: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the pieces told in ``pieces`` (by, piece, ...), with what these tell; nulls in ``by`` are a group."""
    keys = [*by, PIECE]
    told = pieces.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], *[c for c in pieces.columns if c not in keys])
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{i}"))
    return rows.join(told, condition).drop(*[f"__{i}" for i in range(len(keys))])


def _before(by: list[str]):
    """The pieces of a group before this one; there are as many rows as pieces, so that they may meet even without groups."""
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in the order of all, from 1: numbers within pieces, and the sizes of the pieces before."""
    pieces = cut(rows, [], order)
    sizes = pieces.groupBy(PIECE).agg(F.count("*").alias("__size"))
    before = sizes.select(PIECE, F.coalesce(F.sum("__size").over(_before([])), F.lit(0)).alias("__offset"))
    own = F.row_number().over(Window.partitionBy(PIECE).orderBy(*order))
    return _of_pieces(pieces, before, []).withColumn(name, F.col("__offset") + own).drop("__offset", PIECE)


def within_budget(rows: DataFrame, budget: float, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """Rows before which less than the budget was spent, in order; the last may overshoot. ``spent`` is the sum with the row.

    ``cost_usd`` isn't negative (null: nothing), so pieces that begin beyond the budget are never looked into.
    """
    by = partition or []
    pieces = cut(rows, by, order)
    sums = pieces.groupBy(*by, PIECE).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("__sum"))
    open_ = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(_before(by)), F.lit(0.0))).where(F.col("__offset") < budget).drop("__sum")
    own = Window.partitionBy(*by, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    done = _of_pieces(pieces, open_, by).withColumn("__before", F.col("__offset") + F.coalesce(F.sum("cost_usd").over(own), F.lit(0.0))).where(F.col("__before") < budget)
    return done.withColumn("spent", F.col("__before") + F.coalesce("cost_usd", F.lit(0.0))).drop("__before", "__offset", PIECE)


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, one column a share): exact nearest-rank percentiles, the rank p * (n - 1) rounded half to even; nulls don't count.

    Equal values of a group are counted together, then cut into pieces. Counts of pieces say which piece holds a rank, and
    only such pieces are looked into. A group without values has n = 0 and nulls.
    """
    held = [f"__by{i}" for i in range(len(by))]
    named = rows.select(*[F.col(b).alias(h) for b, h in zip(by, held, strict=True)], F.col(value).alias("__v"))
    totals = named.groupBy(*held).agg(F.count("__v").alias("__n"))
    pieces = cut(named.where("__v IS NOT NULL").groupBy(*held, "__v").agg(F.count("*").alias("__m")), held, ["__v"])
    sums = pieces.groupBy(*held, PIECE).agg(F.sum("__m").alias("__sum"))
    whole = Window.partitionBy(*(held or [F.lit(0)]))
    sums = sums.withColumn("__from", F.coalesce(F.sum("__sum").over(_before(held)), F.lit(0))).withColumn("__all", F.sum("__sum").over(whole))
    ranks = F.array(*[F.bround(F.lit(p) * (F.col("__all") - 1)).cast("bigint") for p in shares.values()])
    inside = lambda r: (r >= F.col("__from")) & (r < F.col("__from") + F.col("__sum"))
    wanted = sums.withColumn("__ranks", F.filter(ranks, inside)).where(F.size("__ranks") > 0).select(*held, PIECE, "__from", "__all", "__ranks")
    upto = F.col("__from") + F.sum("__m").over(Window.partitionBy(*held, PIECE).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    hit = _of_pieces(pieces, wanted, held).withColumn("__to", upto).withColumn("__rank", F.explode(F.filter("__ranks", lambda r: (r >= F.col("__to") - F.col("__m")) & (r < F.col("__to")))))
    told = hit.groupBy(*held).agg(*[F.max(F.when(F.col("__rank") == F.bround(F.lit(p) * (F.col("__all") - 1)).cast("bigint"), F.col("__v"))).alias(name) for name, p in shares.items()])
    other = told.select(*[F.col(h).alias(f"{h}_") for h in held], *shares)
    condition = F.lit(True)
    for h in held:
        condition = condition & F.col(h).eqNullSafe(F.col(f"{h}_"))
    return totals.join(other, condition, "left").select(*[F.col(h).alias(b) for h, b in zip(held, by, strict=True)], F.col("__n").alias("n"), *shares)


def sprt(outcomes: DataFrame, pair: list[str], order: list[str], p0: float = 0.9, p1: float = 0.8, alpha: float = 0.05, beta: float = 0.05) -> DataFrame:
    """Sequential test of each pair's outcomes (``passed``): state, n_samples, n_pass and log_likelihood_ratio at the first crossing, or at the end.

    A piece of a pair's outcomes is summed up by its number, its passes, and the least and greatest ratio on its way; with the sums of the
    pieces before it, that tells whether the ratio crosses a bound in it. Only the first such piece, or the last, is looked into.
    """
    if not 0 < p1 < p0 < 1:
        raise ValueError("0 < p1 < p0 < 1 is needed")
    upper, lower = math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))
    llr = lambda n, k: k * sprt_step(F.lit(True), p0, p1) + (n - k) * sprt_step(F.lit(False), p0, p1)
    rows = outcomes.select(*pair, *[c for c in order if c not in pair], F.coalesce("passed", F.lit(False)).cast("int").alias("__passed"))
    own = Window.partitionBy(*pair, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ways = shared_table(cut(rows, pair, order).select(*pair, PIECE, F.count("*").over(own).alias("__n"), F.sum("__passed").over(own).alias("__k")), "ways")
    way = llr(F.col("__n"), F.col("__k"))
    sums = ways.groupBy(*pair, PIECE).agg(F.max("__n").alias("__ns"), F.max("__k").alias("__ks"), F.min(way).alias("__low"), F.max(way).alias("__high"))
    for name in ("n", "k"):
        sums = sums.withColumn(f"__{name}0", F.coalesce(F.sum(f"__{name}s").over(_before(pair)), F.lit(0)))
    start = llr(F.col("__n0"), F.col("__k0"))
    crossed = (start + F.col("__high") >= upper) | (start + F.col("__low") <= lower)
    # the first piece that crosses, else the last
    choice = F.struct(F.when(crossed, 0).otherwise(1).alias("open"), F.when(crossed, F.col(PIECE)).otherwise(-F.col(PIECE)).alias("at"), F.col(PIECE).alias(PIECE), "__n0", "__k0")
    stops = sums.groupBy(*pair).agg(F.min(choice).alias("c")).select(*pair, f"c.{PIECE}", "c.__n0", "c.__k0")
    found = _of_pieces(ways, stops, pair).select(*pair, (F.col("__n") + F.col("__n0")).alias("n"), (F.col("__k") + F.col("__k0")).alias("k")).withColumn("llr", llr(F.col("n"), F.col("k")))
    state = F.when(F.col("llr") >= upper, "pass").when(F.col("llr") <= lower, "fail").otherwise("inconclusive")
    done = state != "inconclusive"
    decided = F.struct(F.when(done, 0).otherwise(1).alias("open"), F.when(done, F.col("n")).otherwise(-F.col("n")).alias("at"), state.alias("state"), F.col("n").cast("int").alias("n_samples"), F.col("k").cast("int").alias("n_pass"), "llr")
    return found.groupBy(*pair).agg(F.min(decided).alias("d")).select(*pair, "d.state", "d.n_samples", "d.n_pass", F.col("d.llr").alias("log_likelihood_ratio"))
