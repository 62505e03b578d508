"""Aggregates with mergeable parts, match audits, binning and text rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATS = ["gpu_hours", "gpu_hours_null_util", "s0", "s25", "s50", "s75"]
#: Utilisation from which each statistic counts.
KNOTS = {"s0": 0.0, "s25": 0.25, "s50": 0.5, "s75": 0.75}


def sufficient(rows: DataFrame, keys: Sequence[str], w: str = "w", u: str = "u") -> DataFrame:
    """Weights above each knot of utilisation; any piecewise-linear curve of utilisation is a sum of these. A missing
    utilisation counts in a weight of its own. Sums of sums give the same, so parts can be merged."""
    known = F.coalesce(u, F.lit(0.0))
    above = [F.sum(F.col(w) * F.greatest(known - F.lit(k), F.lit(0.0))).alias(n) for n, k in KNOTS.items()]
    null = F.coalesce(F.sum(F.when(F.col(u).isNull(), F.col(w))), F.lit(0.0)).alias("gpu_hours_null_util")
    return rows.groupBy(*keys).agg(F.count("*").alias("n_pods"), F.sum(w).alias("gpu_hours"), null, *above)


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics of partial results."""
    return parts.groupBy(*keys).agg(F.sum("n_pods").alias("n_pods"), *[F.sum(c).alias(c) for c in STATS])


def mean_of_means(rows: DataFrame) -> DataFrame:
    """Rows (cluster_id, t, us, w) to hourly means over five-minute bins over equal stamps."""
    stamps = rows.groupBy("cluster_id", "t", "us").agg(F.avg("w").alias("a"), F.count("*").alias("n"))
    bins = stamps.groupBy("cluster_id", "t", F.expr("us div 300000000").alias("bin")).agg(F.avg("a").alias("b"), F.sum("n").alias("n"), F.count("*").alias("stamps"))
    return bins.groupBy("cluster_id", "t").agg(F.avg("b").alias("mean_w"), F.count("*").alias("n_bins"), F.sum("n").alias("n_rows"), (F.sum("n") - F.sum("stamps")).alias("n_repeats"))


def spans(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.sum("w").alias("gh"))


def tolerance(rows: DataFrame, keys: Sequence[str], delay: str, w: str, least: Sequence[int], digits: int | None = 6) -> DataFrame:
    """(keys, s_x ...): the share of weight whose delay is at least x."""
    share = lambda x: F.sum(F.when(F.col(delay) >= x, F.col(w))) / F.sum(w)
    return rows.groupBy(*keys).agg(*[(share(x) if digits is None else F.round(share(x), digits)).alias(f"s_{x}") for x in least])


def with_match(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """matched: whether another table has the key; its repeated keys don't multiply rows."""
    return rows.join(other.select(key).distinct().withColumn("matched", F.lit(True)), key, "left").withColumn("matched", F.col("matched").isNotNull())


def bin_of(column: str, edges: Sequence[int]) -> Column:
    """The lower edge of [edge, next edge); NULL below the first and from the last on."""
    out = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        test = (F.col(column) >= lo) & (F.col(column) < hi)
        out = F.when(test, F.lit(lo).cast("long")) if out is None else out.when(test, F.lit(lo).cast("long"))
    return out


def bin_sql(column: str, edges: Sequence[int]) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {column} >= {a} AND {column} < {b} THEN {a}" for a, b in zip(edges, edges[1:], strict=False)) + " END AS BIGINT)"


def coverage(rows: DataFrame, bins: Column, w: str) -> DataFrame:
    return rows.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.round(100 * F.avg(F.col("matched").cast("int")), 6).alias("pct"), F.round(100 * F.sum(F.when(F.col("matched"), F.col(w))) / F.sum(w), 6).alias("weight_pct"))


def composition_bounds(rows: DataFrame, label: str, w: str) -> DataFrame:
    """With U the weight without a match and M the rest: (x - min(x, U)) / M and x / M, in percent."""
    parts = rows.groupBy(label).agg(F.sum(F.when(F.col("matched"), F.col(w))).alias("x"))
    total = rows.agg(F.sum(w).alias("total"), F.sum(F.when(~F.col("matched"), F.col(w))).alias("u"))
    out = parts.crossJoin(F.broadcast(total))
    m = F.col("total") - F.col("u")
    return out.select(label, F.round(100 * (F.col("x") - F.least("x", "u")) / m, 6).alias("lower_pct"), F.round(100 * F.col("x") / m, 6).alias("upper_pct"))


def weighted(column: str, w: str) -> Column:
    return F.try_divide(F.sum(F.col(w) * F.col(column)), F.sum(w))


def concentration(rows: DataFrame, keys: Sequence[str], part: str, w: str) -> DataFrame:
    """The sum of squared shares of the parts."""
    x = rows.groupBy(*keys, part).agg(F.sum(w).alias("x")).withColumn("total", F.sum("x").over(Window.partitionBy(*keys)))
    return x.groupBy(*keys).agg(F.sum(F.pow(F.col("x") / F.col("total"), 2)).alias("hhi"))


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that raises if right has a key twice; the count by key needs the order that the join needs too."""
    return left.join(unrepeated(right, key), key)


def unrepeated(rows: DataFrame, key: str) -> DataFrame:
    """The rows; raises if a key is there twice."""
    ok = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("boolean"))
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(ok).drop("_n")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """As many_to_one, but left may not repeat a key either."""
    return many_to_one(unrepeated(left, key), right, key)


NUMBER, NUMBER_RANGE = r"^~?([0-9]*\.?[0-9]+)$", r"^~?([0-9]*\.?[0-9]+)\s*-\s*([0-9]*\.?[0-9]+)$"


def number_of(column: str) -> Column:
    """The number that a text is, or the middle of a range a-b, either after an optional ~; NULL for any other text."""
    text = F.trim(column)
    a, b, c = F.regexp_extract(text, NUMBER_RANGE, 1), F.regexp_extract(text, NUMBER_RANGE, 2), F.regexp_extract(text, NUMBER, 1)
    return F.when(a != "", (a.try_cast("double") + b.try_cast("double")) / 2).otherwise(c.try_cast("double"))


def category_of(column: str, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first rule of which the text has a word."""
    out = None
    for name, words in rules:
        test = F.lit(False)
        for x in words:
            test = test | F.lower(column).contains(x)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out
