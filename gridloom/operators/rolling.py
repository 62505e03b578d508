"""Hourly series on a complete spine, and window operators with gap rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def span(series: DataFrame) -> DataFrame:
    """(lo, n): the first hour and the number of hours of the calendar; no row if there is none."""
    return series.agg(F.min("t").alias("lo"), (F.max("t") - F.min("t") + 1).alias("n")).where("lo is not null")


def spine(sums: DataFrame) -> DataFrame:
    """(t): every hour from the first to the last."""
    return span(sums).select(F.explode(F.expr("sequence(lo, lo + n - 1)")).alias("t"))


def dense(sums: DataFrame) -> DataFrame:
    """Rows by hour with the hours between them, whose other columns are NULL: each row is followed by its gap, so that
    neither the calendar nor a join is needed."""
    others = [c for c in sums.columns if c != "t"]
    gap = F.expr("sequence(t, coalesce(_next, t + 1) - 1)")
    rows = sums.withColumn("_next", F.lead("t").over(Window.orderBy("t"))).select(F.explode(gap).alias("_t"), "t", *others)
    return rows.select(F.col("_t").alias("t"), *[F.when(F.col("_t") == F.col("t"), F.col(c)).alias(c) for c in others])


def fleet(tele: DataFrame, value: Column | None = None) -> DataFrame:
    """(t, v): the sum by hour, NULL in hours without rows."""
    return dense(tele.where("t is not null").groupBy("t").agg(F.sum(F.col("w") if value is None else value).alias("v")))


def lanes(tele: DataFrame, value: Column | None = None, unit: str = "cluster_id") -> DataFrame:
    """(cluster_id, t, v): as fleet(), for each cluster, on the calendar that they have together. Clusters and calendar
    come from the same sums (of which a count is asked for, so that Spark sees one exchange), and the rows are read once."""
    sums = tele.where(F.col(unit).isNotNull() & F.col("t").isNotNull()).groupBy(unit, "t").agg(F.sum(F.col("w") if value is None else value).alias("v"))
    units = sums.groupBy(unit).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("v").alias("have")).where("have >= 0")
    everywhere = Window.partitionBy()
    grid = units.select(unit, F.min("lo").over(everywhere).alias("lo"), F.max("hi").over(everywhere).alias("hi")).select(unit, F.explode(F.sequence("lo", "hi")).alias("t"))
    return grid.join(sums, [unit, "t"], "left")


def over(keys: Sequence[str], first: int, last: int, order: str = "t"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(first, last)


def running_min(h: int, keys: Sequence[str] = (), value: str = "v") -> Column:
    """The least of h hours from each on; NULL where one of them is missing."""
    w = over(keys, 0, h - 1)
    return F.when(F.count(value).over(w) == h, F.min(value).over(w))


def minima(series: DataFrame, hours: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t, h, m): running minima for several durations from one sort."""
    wide = series.select(*keys, "t", *[running_min(h, keys).alias(f"m{h}") for h in hours])
    tall = F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.col(f"m{h}").alias("m")) for h in hours])).alias("x")
    return wide.select(*keys, "t", tall).select(*keys, "t", "x.h", "x.m").where("m is not null")


def blocked(series: DataFrame, before: int, after: int, block: int, keys: Sequence[str] = ()) -> DataFrame:
    """series with a block number, and whether a row is the block's own: rows near an edge go to the next block as well, so
    that windows over `before` rows back and `after` ahead, by keys and `_block`, are whole for a block's own rows. A long
    series is so dealt over tasks, at (before + after) / block copies of a row. The calendar is complete."""
    number = F.expr(f"floor(t / {block})")
    reach = F.sequence(F.expr(f"floor((t - {after}) / {block})"), F.expr(f"floor((t + {before}) / {block})"))
    return series.withColumn("_block", F.explode(reach)).withColumn("_own", F.col("_block") == number)


def long_minima(series: DataFrame, hours: Sequence[int], keys: Sequence[str] = (), block: int = 1 << 16) -> DataFrame:
    """As minima(), for series of any length: no window holds more than a block."""
    rows = blocked(series, 0, max(hours) - 1, block, keys)
    own = [*keys, "_block"]
    wide = rows.select(*own, "_own", "t", *[running_min(h, own).alias(f"m{h}") for h in hours]).where("_own")
    tall = F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.col(f"m{h}").alias("m")) for h in hours])).alias("x")
    return wide.select(*keys, "t", tall).select(*keys, "t", "x.h", "x.m").where("m is not null")


def long_trend(series: DataFrame, before: int, after: int, least: int, keys: Sequence[str] = (), block: int = 1 << 16) -> DataFrame:
    """(keys, t, v, trend): trend() without filling, for series of any length."""
    w = over([*keys, "_block"], -before, after)
    return blocked(series, before, after, block, keys).withColumn("trend", supported(F.avg("v"), "v", w, least)).where("_own").select(*keys, "t", "v", "trend")


def long_dense(sums: DataFrame) -> DataFrame:
    """(t, v) on the complete calendar of t, which is a range dealt over tasks."""
    ends = span(sums).first()
    if ends is None:
        return sums.select("t", "v")
    spark = sums.sparkSession
    return spark.range(ends.lo, ends.lo + ends.n).withColumnRenamed("id", "t").join(sums.select("t", "v"), "t", "left")


def quantile(column: str | Column, p: float) -> Column:
    return F.percentile(column, F.lit(p))


def firm(series: DataFrame, hours: Sequence[int], shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, h, alpha, k, n_windows): the load that holds for h hours in a share alpha of windows."""
    low = [round(1 - a, 10) for a in shares]
    found = minima(series, hours, keys).groupBy(*keys, "h").agg(F.percentile("m", F.array(*[F.lit(x) for x in low])).alias("k"), F.count("m").alias("n_windows"))
    rows = F.explode(F.arrays_zip(F.array(*[F.lit(a) for a in shares]).alias("alpha"), F.col("k"))).alias("x")
    return found.select(*keys, "h", "n_windows", rows).select(*keys, "h", F.col("x.alpha").alias("alpha"), F.col("x.k").alias("k"), "n_windows")


def supported(agg: Column, column: str | Column, w, least: int) -> Column:
    """A window aggregate that needs at least so many values."""
    return F.when(F.count(column).over(w) >= least, agg.over(w))


def filled(column: str, keys: Sequence[str] = (), back_only: bool = False) -> Column:
    """Gaps take the next value, then (unless back_only) the one before."""
    after = F.first(column, True).over(over(keys, 0, Window.unboundedFollowing))
    before = F.last(column, True).over(over(keys, Window.unboundedPreceding, 0))
    return after if back_only else F.coalesce(after, before)


def trend(series: DataFrame, before: int, after: int, least: int = 24, keys: Sequence[str] = (), name: str = "trend", fill: bool = True) -> DataFrame:
    """A rolling mean over rows t-before..t+after with at least `least` values, gaps then filled."""
    out = series.withColumn(name, supported(F.avg("v"), "v", over(keys, -before, after), least))
    return out.withColumn(name, filled(name, keys)) if fill else out


def hour_of_week() -> Column:
    return F.pmod(F.col("t"), F.lit(24)) + 24 * F.pmod(F.floor(F.col("t") / 24), F.lit(7))


def deseasoned(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """r: what is left after a centred 169-hour mean and the mean of each hour of the week."""
    out = trend(series, 84, 84, 24, keys, "centre", fill=False).withColumn("d", F.col("v") - F.col("centre")).withColumn("how", hour_of_week())
    return out.withColumn("r", F.col("d") - F.avg("d").over(Window.partitionBy(*keys, "how")))


def interpolated(series: DataFrame, limit: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """x: gaps on a line between their neighbours. With a limit, the first `limit` hours of a gap alone; the rest takes
    the next value. Before the first and after the last value the nearest one holds."""
    ahead, behind = over(keys, 0, Window.unboundedFollowing), over(keys, Window.unboundedPreceding, 0)
    at = F.when(F.col("v").isNotNull(), F.col("t"))
    out = series.select(*keys, "t", "v", F.last("v", True).over(behind).alias("pv"), F.last(at, True).over(behind).alias("pt"), F.first("v", True).over(ahead).alias("nv"), F.first(at, True).over(ahead).alias("nt"))
    line = F.col("pv") + (F.col("nv") - F.col("pv")) * (F.col("t") - F.col("pt")) / F.nullif(F.col("nt") - F.col("pt"), F.lit(0))
    if limit is not None:
        line = F.when(F.col("t") - F.col("pt") <= limit, line)
    return out.select(*keys, "t", F.coalesce("v", line, "nv", "pv").alias("x"), F.col("v").isNull().alias("gap"))


def islands(rows: DataFrame, lo: str, hi: str, keys: Sequence[str] = ()) -> DataFrame:
    """Intervals that overlap or touch, merged: (keys, lo, hi, n)."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    new = F.coalesce(F.col(lo) > F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    marked = rows.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("n"))
