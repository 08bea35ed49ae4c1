"""Statistical column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(passed: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a proportion, within [0, 1]; (0, 1) for no trials."""
    n, p = n.cast("double"), ratio(passed, n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    none = n == 0
    return F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(none, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half))


def two_proportion_z(pass_a: Column, n_a: Column, pass_b: Column, n_b: Column) -> Column:
    """z of share a less share b with the pooled variance; null without trials on a side, 0 without variance."""
    pool = ratio(pass_a + pass_b, n_a + n_b)
    error = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)))
    z = F.when(error == 0, F.lit(0.0)).otherwise(F.try_divide(ratio(pass_a, n_a) - ratio(pass_b, n_b), error))
    return F.when((n_a == 0) | (n_b == 0), F.lit(None).cast("double")).otherwise(z)


def psi_term(recent: Column, base: Column, floor: float = 1e-4) -> Column:
    """One key's part of the population stability index, from shares."""
    r, b = F.greatest(recent, F.lit(floor)), F.greatest(base, F.lit(floor))
    return (r - b) * F.log(r / b)


def js_term(recent: Column, base: Column) -> Column:
    """One key's part of the Jensen-Shannon divergence, base 2."""
    middle = (recent + base) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
    return (part(recent) + part(base)) / 2


def kappa(both: Column, only_judge: Column, only_human: Column, neither: Column) -> Column:
    """Cohen's kappa of two raters from a 2 x 2 table; where chance explains all, 1 for full agreement, else 0; null when empty."""
    n = (both + only_judge + only_human + neither).cast("double")
    seen = ratio(both + neither, n)
    judge, human = ratio(both + only_judge, n), ratio(both + only_human, n)
    chance = judge * human + (1 - judge) * (1 - human)
    return F.when(n == 0, None).when(chance >= 1, F.when(seen >= 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(seen - chance, 1 - chance))


def error_budget(attained: Column, target: Column) -> Column:
    """Share of an objective's error budget that is left."""
    full = F.when(attained >= 1, 1.0).otherwise(0.0)
    return F.when(attained.isNull(), None).when(target >= 1, full).otherwise(1 - F.try_divide(1 - attained, 1 - target))


def nearest_rank(values: Column, p: float) -> Column:
    """Nearest-rank percentile of an array, the rank rounded half to even; null when empty."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.bround(F.lit(p) * (F.size(ordered) - 1)).cast("int"))


def length_bucket(tokens: Column) -> Column:
    """The next power of two, inclusive, as ``<=n``; unknown for null and what isn't positive. Integers only, so exact."""
    power = F.when(tokens <= 1, F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(tokens.cast("bigint") - 1))))
    return F.when(tokens.isNull() | (tokens <= 0), "unknown").otherwise(F.concat(F.lit("<="), power.cast("string")))


def sprt_step(passed: Column, p0: float, p1: float) -> Column:
    """What an outcome adds to the log likelihood ratio of p0 over p1."""
    return F.when(passed, math.log(p0 / p1)).otherwise(math.log((1 - p0) / (1 - p1)))
