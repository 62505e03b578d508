"""Factors that lead from a mean to a dependable level: duration, then coincidence; controls and bands of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.resample import decorrelated
from gridloom.operators.rolling import firm, minima, trend


def summed(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t, v): the sum over units; an hour that no unit has is missing."""
    return panel.groupBy(*keys, "t").agg(F.sum("v").alias("v"))


def levels(panel: DataFrame, unit: str, hours: Sequence[int], low: float, draws: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, h, p1, p2, p3): the mean of the sum, its dependable level if units were independent, and as it is."""
    d = decorrelated(trend(panel, 84, 83, 24, [*keys, unit]), unit, draws, seed, keys=keys)
    p2 = minima(d, hours, [*keys, "draw"]).groupBy(*keys, "draw", "h").agg(F.percentile("m", F.lit(low)).alias("k")).groupBy(*keys, "h").agg(F.avg("k").alias("p2"))
    a = summed(panel, keys)
    p3 = firm(a, hours, [1 - low], keys).select(*keys, "h", F.col("k").alias("p3"))
    both = p2.join(p3, [*keys, "h"])
    p1 = a.groupBy(*keys).agg(F.avg("v").alias("p1"))
    return both.join(p1, list(keys)) if keys else both.crossJoin(p1)


def factors(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"a_persist": F.try_divide("p2", "p1"), "a_coinc": F.try_divide("p3", "p2")})


def shares(rows: DataFrame) -> DataFrame:
    """The factor of scope (p0: the level assumed at first), and the three factors' Shapley shares in closed form, as
    coincidence does nothing without duration."""
    two = F.sqrt(F.col("p2") * F.col("p3"))
    return rows.withColumns({"a_scope": F.try_divide("p1", "p0"), "shapley_scope": F.try_divide("p1", "p0"), "shapley_duration": F.try_divide(two, F.col("p1")), "shapley_coincidence": F.sqrt(F.try_divide("p3", "p2"))})
