"""Lookups in ranges: the last known value, curves through knots, crossings, and a distribution folded from parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.power import hinges


def daily(rows: DataFrame, known: DataFrame, day: str, value: str) -> DataFrame:
    """Rows with the value of the last day that has one, or of the first: an equi-join with a filled calendar, which
    is as long as the days are many, in place of a range join."""
    span = rows.agg(F.min(day).alias("a"), F.max(day).alias("b")).crossJoin(known.agg(F.min(day).alias("c"), F.max(day).alias("d")))
    calendar = span.where("a is not null").select(F.explode(F.sequence(F.least("a", "c"), F.greatest("b", "d"))).alias(day))
    w = Window.orderBy(day)
    full = calendar.join(known, day, "left").select(day, F.coalesce(F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))).alias(value))
    return rows.join(full, day, "left")


def curve(column: str, knots: Sequence[float], values: Sequence[float]) -> Column:
    """The piecewise-linear curve through knots, between the first and the last."""
    out = F.lit(float(values[0]))
    for c, k in zip(hinges(list(values), list(knots)), knots, strict=False):
        out = out + F.lit(c) * F.greatest(F.col(column) - F.lit(float(k)), F.lit(0.0))
    return out


def crossing(points: DataFrame, x: str, y: str, share: float) -> DataFrame:
    """(x): where the line through the points first falls below a share of the largest y."""
    w = Window.orderBy(x)
    p = points.withColumn("nx", F.lead(x).over(w)).withColumn("ny", F.lead(y).over(w)).withColumn("want", share * F.max(y).over(Window.partitionBy()))
    hit = p.where((F.col(y) >= F.col("want")) & (F.col("ny") < F.col("want")))
    return hit.agg(F.min_by(F.col(x) + (F.col("nx") - F.col(x)) * (F.col("want") - F.col(y)) / (F.col("ny") - F.col(y)), x).alias("x")).where("x is not null")


def rising(points: DataFrame, x: str, y: str, share: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, x): where the line through the points first reaches a share of the largest y."""
    w = Window.partitionBy(*keys).orderBy(x)
    p = points.withColumn("nx", F.lead(x).over(w)).withColumn("ny", F.lead(y).over(w)).withColumn("want", share * F.max(y).over(Window.partitionBy(*keys)))
    hit = p.where((F.col(y) < F.col("want")) & (F.col("ny") >= F.col("want")))
    return hit.groupBy(*keys).agg(F.min_by(F.col(x) + (F.col("nx") - F.col(x)) * (F.col("want") - F.col(y)) / (F.col("ny") - F.col(y)), x).alias("x"))


def poisson_binomial(parts: DataFrame, p: str) -> DataFrame:
    """(low, probability): how many of independent events happen; parts is a row for each of a few."""
    start = F.array(F.lit(1.0))
    step = lambda a, q: F.zip_with(F.concat(F.transform(a, lambda x: x * (1 - q)), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(a, lambda x: x * q)), lambda x, y: x + y)
    return parts.agg(F.sort_array(F.collect_list(p)).alias("p")).select(F.posexplode(F.aggregate("p", start, step)).alias("low", "probability")).select(F.col("low").cast("long").alias("low"), "probability")
