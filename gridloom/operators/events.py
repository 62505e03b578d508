"""Order statistics, runs, changepoints and occupancy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.rolling import spine


def order_cap(rows: DataFrame, keys: Sequence[str], shares: Sequence[float], value: str = "m") -> DataFrame:
    """(keys, alpha, cap): the value with rank n - ceil(alpha * n) + 1 from below."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("i", F.row_number().over(w.orderBy(value))).withColumn("n", F.count("*").over(w))
    out = ranked.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in shares])))
    return out.where(F.col("i") == F.col("n") - F.ceil(F.round(F.col("alpha") * F.col("n"), 6)) + 1).select(*keys, "alpha", F.round(value, 6).alias("cap"))


def runs(rows: DataFrame, on: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t, hours): first hour and length of each run of hours where `on` holds."""
    w = Window.partitionBy(*keys).orderBy("t")
    edge = F.when(F.col(on) & ~F.coalesce(F.lag(on).over(w), F.lit(False)), 1).otherwise(0)
    run = F.sum("edge").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("edge", edge).withColumn("run", run).where(on).groupBy(*keys, "run").agg(F.min("t").alias("t"), F.count("*").alias("hours"))


def changepoint(rows: DataFrame, margin: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, k, sse, reduction): the split of (i, v), i = 1.., with the least squared error about two means; first on
    ties."""
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    x = rows.select(*keys, "i", F.sum("v").over(before).alias("s1"), F.sum(F.col("v") * F.col("v")).over(before).alias("q1"), F.sum("v").over(whole).alias("s"), F.sum(F.col("v") * F.col("v")).over(whole).alias("q"), F.count("*").over(whole).alias("n"))
    right = (F.col("q") - F.col("q1")) - (F.col("s") - F.col("s1")) * (F.col("s") - F.col("s1")) / F.nullif(F.col("n") - F.col("i"), F.lit(0))
    x = x.withColumn("sse", (F.col("q1") - F.col("s1") * F.col("s1") / F.col("i")) + right).withColumn("sse0", F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    x = x.where((F.col("i") >= margin) & (F.col("i") < F.col("n") - margin))
    return x.groupBy(*keys).agg(F.min_by("i", F.struct(F.round("sse", 6), "i")).alias("k"), F.min("sse").alias("sse"), (1 - F.min("sse") / F.first("sse0")).alias("reduction"))


def occupancy(steps: DataFrame, position: str, height: str) -> DataFrame:
    """(t, level): running sum of steps at fractional hours; a step at p puts 1 - frac(p) at floor(p), the rest after."""
    floor = F.floor(position)
    frac = F.col(position) - floor
    cells = F.array(F.struct(floor.alias("t"), (F.col(height) * (1 - frac)).alias("x")), F.struct((floor + 1).alias("t"), (F.col(height) * frac).alias("x")))
    sums = steps.select(F.explode(cells).alias("c")).groupBy("c.t").agg(F.sum("c.x").alias("x"))
    return sums.select("t", F.sum("x").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)).alias("level"))


def sessions(rows: DataFrame, start: str, end: str, w: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t, x): weight times the time that half-open sessions spend in each unit interval, where any is open.

    A session is a step up at its start and one down at its end, so that its length doesn't matter: the steps are summed
    by interval, and running sums go over the intervals of a calendar."""
    good = rows.where((F.col(end) > F.col(start)) & (F.col(w) > 0))

    def cells(at: str, sign: int, open_: Column) -> list[Column]:
        floor = F.floor(at)
        part = sign * F.col(w) * (1 - (F.col(at) - floor))
        none = F.lit(0)
        return [F.struct(floor.alias("t"), part.alias("x"), none.alias("n")), F.struct((floor + 1).alias("t"), (sign * F.col(w) - part).alias("x"), none.alias("n")), F.struct(open_.alias("t"), F.lit(0.0).alias("x"), F.lit(sign).alias("n"))]

    steps = good.select(*keys, F.explode(F.array(*cells(start, 1, F.floor(start)), *cells(end, -1, F.ceil(end)))).alias("c")).groupBy(*keys, "c.t").agg(F.sum("c.x").alias("x"), F.sum("c.n").alias("n"))
    grid = spine(steps)
    grid = steps.select(*keys).distinct().crossJoin(grid) if keys else grid
    run = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    all_ = grid.join(steps, [*keys, "t"], "left")
    return all_.select(*keys, "t", F.sum("x").over(run).alias("x"), F.sum("n").over(run).alias("n")).where("n > 0").drop("n")
