"""How much new load fits under a peak cap if part of it yields: a closed form, no search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def headroom(hours: DataFrame, margins: DataFrame, budgets: DataFrame, most: float = 20000.0) -> DataFrame:
    """(margin, budget, load, rigid): hours has (i, d, s, c): demand, and the new load's profile and curtailable part.

    load: the largest L with max(0, d + L s - cap) <= L c in all hours, and more than 0 in at most budget * n of them;
    the least of the bound that hours with s > c set, and of the (floor(budget n) + 1)-th smallest (cap - d) / s. 0 if
    under 1. rigid: the same without any curtailment.
    """
    peak = hours.agg(F.max("d").alias("peak"), F.count("*").alias("n"))
    x = hours.crossJoin(F.broadcast(peak)).crossJoin(F.broadcast(margins)).withColumn("room", F.col("peak") * (1 + F.col("margin")) - F.col("d"))
    hard = F.min(F.when(F.col("s") > F.col("c"), F.col("room") / (F.col("s") - F.col("c")))).alias("hard")
    rigid = F.min(F.when(F.col("s") > 0, F.col("room") / F.col("s"))).alias("rigid")
    bound = x.groupBy("margin").agg(hard, rigid, F.first("n").alias("n"))
    ranked = x.where("s > 0").select("margin", (F.col("room") / F.col("s")).alias("q")).withColumn("i", F.row_number().over(Window.partitionBy("margin").orderBy("q")))
    want = bound.crossJoin(F.broadcast(budgets)).withColumn("i", F.floor(F.round(F.col("budget") * F.col("n"), 6)) + 1)
    out = want.join(ranked, ["margin", "i"], "left").withColumn("load", F.least("hard", "q", F.lit(most)))
    return out.select("margin", "budget", F.when(F.col("load") >= 1, F.col("load")).otherwise(0.0).alias("load"), "rigid")
