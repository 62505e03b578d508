"""Resampling. Random numbers come from a rule on whole numbers, for as many draws and units as there are, so that any
engine gets the same."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.rolling import minima, span
from gridloom.sources.shared import shared_path

PRIME = 2147483647
STEPS = 4


def drawn_sql(a: str, b: str, seed: int, xor: str = "xor({x}, {x} >> 13)") -> str:
    """A whole number from 0 up to PRIME that looks random, for whole numbers a and b."""
    x = f"(({a} * 7919 + {b} * 104729 + {seed * 1299709 + 12345}) % {PRIME})"
    for _ in range(STEPS):
        x = f"(({xor.format(x=x)} * 48271) % {PRIME})"
    return x


def drawn(a: str, b: str, seed: int) -> Column:
    x = F.expr(f"(cast({a} AS bigint) * 7919 + {b} * 104729 + {seed * 1299709 + 12345}) % {PRIME}")
    for _ in range(STEPS):
        x = (x.bitwiseXOR(F.shiftright(x, 13)) * 48271) % PRIME
    return x


def drawn_numbers(a: np.ndarray, b: int, seed: int) -> np.ndarray:
    """drawn() on an array."""
    x = (np.asarray(a, np.int64) * 7919 + b * 104729 + seed * 1299709 + 12345) % PRIME
    for _ in range(STEPS):
        x = (x ^ (x >> 13)) * 48271 % PRIME
    return x


def uniform_sql(a: str, b: str, seed: int) -> str:
    return f"({drawn_sql(a, b, seed)} / {PRIME}.0::DOUBLE)"


def uniform(a: str, b: str, seed: int) -> Column:
    return drawn(a, b, seed) / F.lit(float(PRIME))


def numbered(units: DataFrame, unit: str, name: str = "u") -> DataFrame:
    """(unit, u): the units by name, from 0."""
    return units.select(unit).distinct().withColumn(name, F.row_number().over(Window.orderBy(unit)).cast("long") - 1)


def numbered_many(units: DataFrame, unit: str, name: str = "u") -> DataFrame:
    """As numbered(), for units as many as rows: ranges of them are sorted in tasks, and each starts where the ranges before
    it end. The ranges are written, so that a task that runs again numbers alike."""
    path, spark = shared_path(units.sparkSession, "numbered"), units.sparkSession
    rows = units.select(unit).distinct().repartitionByRange(unit).sortWithinPartitions(unit)
    rows.withColumn("_i", F.monotonically_increasing_id()).write.parquet(path)
    place = F.col("_i").bitwiseAND((1 << 33) - 1)
    back = spark.read.parquet(path).select(unit, F.shiftright("_i", 33).alias("_p"), place.alias("_i"))
    sizes = back.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each range
    first = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_first"))
    return back.join(first, "_p").select(unit, (F.col("_first") + F.col("_i")).alias(name))


def picks(units: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, i, u): as many units as there are (numbered by u), drawn with replacement."""
    n = units.agg(F.count("*").alias("units"))
    rows = units.select(F.col("u").alias("i")).crossJoin(n).crossJoin(units.sparkSession.range(reps).withColumnRenamed("id", "rep"))
    return rows.select("rep", "i", (drawn("rep", "i", seed) % F.col("units")).alias("u"))


def block_index(hours: DataFrame, reps: int, block: int, seed: int, circular: bool = False) -> DataFrame:
    """(rep, pos, src) of moving blocks over a calendar (lo, n); the last is cut at the end. Circular blocks may start at
    any hour and go on at the first."""
    starts = F.col("n") if circular else F.col("n") - block + 1
    b = hours.where(F.col("n") >= block).crossJoin(hours.sparkSession.range(reps).withColumnRenamed("id", "rep")).select("lo", "n", "rep", F.explode(F.expr(f"sequence(0L, (n + {block} - 1) div {block} - 1)")).alias("j"))
    b = b.withColumn("source", drawn("rep", "j", seed) % starts).select("lo", "n", "rep", "j", "source", F.explode(F.expr(f"sequence(0, {block} - 1)")).alias("i"))
    b = b.withColumn("pos", F.col("j") * block + F.col("i")).where("pos < n")
    return b.select("rep", "pos", (F.col("lo") + (F.col("source") + F.col("i")) % F.col("n")).alias("src"))


def decorrelated(series: DataFrame, unit: str, draws: int, seed: int, step: int = 1, clip: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, draw, t, v): the sum over units of the trend and a residual that is rolled by the draw's shift (a multiple of
    step hours), at least 0; an hour with a missing term is missing. series: (keys, unit, t, v, trend)."""
    moves = numbered(series, unit).crossJoin(series.sparkSession.range(draws).withColumnRenamed("id", "draw")).crossJoin(span(series))
    moves = moves.withColumn("shift", step * (drawn("draw", "u", seed) % F.greatest(F.expr(f"n div {step}"), F.lit(1))))
    rolled = series.select(*keys, unit, "t", (F.col("v") - F.col("trend")).alias("r")).join(moves, unit).select(*keys, "draw", unit, (F.col("lo") + (F.col("t") - F.col("lo") + F.col("shift")) % F.col("n")).alias("t"), "r")
    both = rolled.join(series.select(*keys, unit, "t", "trend"), [*keys, unit, "t"])
    sums = both.withColumn("x", F.col("r") + F.col("trend")).groupBy(*keys, "draw", "t").agg(F.sum("x").alias("x"), F.count("x").alias("have"), F.count("*").alias("units"))
    x = F.greatest("x", F.lit(0.0)) if clip else F.col("x")
    return sums.select(*keys, "draw", "t", F.when(F.col("have") == F.col("units"), x).alias("v"))


def benchmark(series: DataFrame, unit: str, draws: int, seed: int, h: int, low: float) -> DataFrame:
    """(k): the dependable load of decorrelated sums, its mean over the draws."""
    k = minima(decorrelated(series, unit, draws, seed), [h], ["draw"]).groupBy("draw").agg(F.percentile("m", F.lit(low)).alias("k"))
    return k.agg(F.avg("k").alias("k"))
