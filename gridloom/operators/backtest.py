"""Rolling-origin backtests and derating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def origins(m: DataFrame, h: int, train: int, test: int, at: DataFrame, low: float) -> DataFrame:
    """Test windows (o, t, m) of each origin of at (o), with the level k that its training windows set and their number."""
    both = m.select("t", "m").join(at, (F.col("t") >= F.col("o") - train) & (F.col("t") + h <= F.col("o") + test))
    before = both.where(F.col("t") + h <= F.col("o")).groupBy("o").agg(F.percentile("m", F.lit(low)).alias("k"), F.count("*").alias("n_train"))
    return both.where("t >= o").join(before, "o")


def derating(tests: DataFrame, alpha: float, least: float = 0.3, most: float = 1.5) -> DataFrame:
    """(alpha, d): the ceil(alpha n)-th largest of m / k, within bounds."""
    q = tests.where("k > 0").select((F.col("m") / F.col("k")).alias("q"))
    r = q.select("q", F.row_number().over(Window.orderBy(F.desc("q"))).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    return r.where(F.col("i") == F.ceil(F.round(F.lit(alpha) * F.col("n"), 6))).select(F.lit(alpha).alias("alpha"), F.greatest(F.lit(least), F.least(F.lit(most), "q")).alias("d"))
