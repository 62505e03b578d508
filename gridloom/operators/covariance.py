"""Residuals, synchrony, covariance and portfolios of series in long form (unit, t, r)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.resample import drawn, drawn_sql, numbered
from gridloom.operators.rolling import filled, minima, over, supported


def capacity_normed(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """x: the value over the mean of the week before, NULL where that is under a fifth of its median or 0.05."""
    x = series.withColumn("a", supported(F.avg("v"), "v", over(keys, -167, 0), 24)).withColumn("cap", filled("a", keys, back_only=True))
    x = x.withColumn("mid", F.median("cap").over(Window.partitionBy(*keys)))
    return x.withColumn("x", F.when(F.col("cap") >= F.greatest(0.2 * F.col("mid"), F.lit(0.05)), F.col("v") / F.col("cap")))


def autocorrelation(series: DataFrame, lags: Sequence[int], keys: Sequence[str]) -> DataFrame:
    d = series.withColumn("d", F.col("v") - F.avg("v").over(Window.partitionBy(*keys)))
    w = Window.partitionBy(*keys).orderBy("t")  # the spine is complete: a lag in rows is a lag in hours
    both = d.select(*keys, "d", *[F.lead("d", k).over(w).alias(f"d{k}") for k in lags])
    sums = both.groupBy(*keys).agg((F.sum(F.col("d") * F.col("d")) / F.count("d")).alias("c0"), *[F.try_divide(F.sum(F.col("d") * F.col(f"d{k}")), F.count(F.col("d") * F.col(f"d{k}"))).alias(f"c{k}") for k in lags])
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), (F.col(f"c{k}") / F.col("c0")).alias("acf")) for k in lags])).alias("x")
    return sums.select(*keys, rows).select(*keys, "x.lag", F.round("x.acf", 6).alias("acf"))


def complete(rows: DataFrame, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """The rows of hours in which every unit has a residual."""
    units = rows.groupBy(*keys).agg(F.countDistinct(unit).alias("units"))
    hours = rows.groupBy(*keys, "t").agg(F.count("r").alias("have"))
    good = hours.join(units, list(keys)) if keys else hours.crossJoin(units)
    return rows.join(good.where("have = units").select(*keys, "t"), [*keys, "t"])


def synchrony(rows: DataFrame, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, hours, ratio, variance)"""
    x = complete(rows, unit, keys)
    total = x.groupBy(*keys, "t").agg(F.sum("r").alias("x")).groupBy(*keys).agg(F.count("*").alias("hours"), F.stddev_samp("x").alias("s"))
    own = x.groupBy(*keys, unit).agg(F.var_samp("r").alias("q")).groupBy(*keys).agg(F.sum("q").alias("q"))
    both = total.join(own, list(keys)) if keys else total.crossJoin(own)
    return both.select(*keys, "hours", F.round(F.col("s") / F.sqrt("q"), 6).alias("ratio"), F.round("q", 2).alias("variance"))


def correlations(rows: DataFrame, unit: str) -> DataFrame:
    """Pairs a < b over the hours that both have."""
    a, b = rows.select(F.col(unit).alias("a"), "t", F.col("v").alias("x")), rows.select(F.col(unit).alias("b"), "t", F.col("v").alias("y"))
    c = a.join(b, "t").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("c"), F.count("*").alias("n"))
    w = Window.partitionBy()
    return c.select("a", "b", "n", F.round("c", 6).alias("corr"), F.round(F.avg("c").over(w), 6).alias("mean_corr"), F.round(F.median("c").over(w), 6).alias("median_corr"))


def excess(rows: DataFrame, unit: str) -> DataFrame:
    x = complete(rows, unit)
    u = x.groupBy(unit).agg(F.var_pop("r").alias("q"))
    s = u.agg(F.sum("q").alias("s2"), F.sum(F.sqrt("q")).alias("s1"), (F.sum(F.col("q") * F.col("q")) / F.pow(F.sum("q"), 2)).alias("hhi"))
    f = x.groupBy("t").agg(F.sum("r").alias("z")).agg(F.var_pop("z").alias("v"))
    return s.crossJoin(f).select(F.round(F.col("v") / F.col("s2") - 1, 6).alias("excess"), F.round(F.sqrt(F.col("v") / F.col("s2")), 6).alias("sync"), F.round((F.col("v") - F.col("s2")) / (F.col("s1") * F.col("s1") - F.col("s2")), 6).alias("rho_w"), F.round("hhi", 6).alias("hhi"))


#: Units up to which all their sets are taken, and sets of each size drawn beyond that.
ENUMERATED, DRAWN = 14, 200
#: Numbers of sets up to which ranks are drawn and unranked; the prime is the step from rank to rank.
RANKED, STEP = 1 << 40, 2147483647


def subsets(rows: DataFrame, unit: str, most: int = ENUMERATED, draws: int = DRAWN, seed: int = 5) -> DataFrame:
    """(p, unit, n): every set of units, p being its bits; with more units than `most`, `draws` different sets of each size
    n (all of them where there are no more), p being n * draws and the set's number. Units are numbered in the plan.

    The sets of a size are numbered by the combinatorial number system. Drawn ranks lie a prime apart from a drawn first
    one, modulo their number, which that prime doesn't divide, so that no rank comes twice. Where a size has more than
    RANKED sets, members are drawn instead, and equal sets are left out.
    """
    o = numbered(rows, unit, "_u")
    size = o.agg(F.count("*").alias("units"))
    whole = size.where(F.col("units") <= most).select(F.explode(F.expr(f"sequence(1L, shiftleft(1L, cast(least(units, {most}) AS int)) - 1)")).alias("p"))
    whole = whole.join(o, F.expr("shiftright(p, cast(_u AS int)) & 1 = 1")).select("p", unit, F.bit_count("p").cast("long").alias("n"))
    sizes = size.where((F.col("units") > most) & (F.col("units") > 0)).select("units", F.explode(F.expr("sequence(1L, units)")).alias("n"))
    sizes = sizes.withColumn("_all", F.expr("aggregate(sequence(1L, n), 1D, (a, j) -> a * (units - n + j) / j)"))
    few = sizes.where(F.col("_all") <= RANKED).withColumn("_all", F.round("_all").cast("long"))
    few = few.withColumn("_i", F.explode(F.expr(f"sequence(0L, least(_all, {draws}L) - 1)"))).withColumn("_rank", (drawn("n", "0", seed) + F.col("_i") * STEP) % F.col("_all"))
    choose = "aggregate(sequence(1L, greatest(s.k, 1L)), 1L, (a, j) -> a * (c - s.k + j) div j)"  # C(c, s.k)
    took = f"if(s.k > 0 and {choose} <= s.rank, named_struct('rank', s.rank - {choose}, 'k', s.k - 1, 'm', concat(s.m, array(c))), s)"
    members = F.expr(f"aggregate(sequence(units - 1, 0L, -1L), named_struct('rank', _rank, 'k', n, 'm', cast(array() AS array<bigint>)), (s, c) -> {took}).m")
    few = few.select((F.col("n") * draws + F.col("_i")).alias("p"), "n", F.explode(members).alias("_u")).join(o, "_u").select("p", unit, "n")
    some = sizes.where(F.col("_all") > RANKED).select("n").crossJoin(rows.sparkSession.range(draws)).withColumn("p", F.col("n") * draws + F.col("id"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy(drawn("p", "_u", seed), "_u"))
    some = some.crossJoin(o).withColumn("rank", rank).where("rank <= n").groupBy("p", "n").agg(F.sort_array(F.collect_list("_u")).alias("_m"))
    some = some.groupBy("n", "_m").agg(F.min("p").alias("p")).select("p", "n", F.explode("_m").alias("_u")).join(o, "_u").select("p", unit, "n")
    return whole.unionByName(few).unionByName(some)


def subsets_sql(units: str, most: int = ENUMERATED, draws: int = DRAWN, seed: int = 5) -> str:
    """CTEs up to mb (p, cluster_id, n) by the rule of subsets(), for up to 33 units; `units` has a row for each cluster_id.
    Needs WITH RECURSIVE."""
    choose = "CASE WHEN k > c THEN 0 ELSE (factorial(c::INT) // (factorial(k::INT) * factorial((c - k)::INT)))::BIGINT END"
    return f"""nu AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS i FROM (SELECT DISTINCT cluster_id FROM {units})), un AS (SELECT count(*) AS units FROM nu),
dr AS (SELECT n, i, units, ({drawn_sql('n', '0', seed)} + i * {STEP}) % total AS rank FROM (SELECT n, units, (factorial(units::INT) // (factorial(n::INT) * factorial((units - n)::INT)))::BIGINT AS total FROM (SELECT units, unnest(range(1, units + 1)) AS n FROM un WHERE units > {most})), (SELECT range AS i FROM range({draws})) WHERE i < total),
ur AS (SELECT n, i, units - 1 AS c, rank, n AS k, -1::BIGINT AS took FROM dr UNION ALL SELECT n, i, c - 1, CASE WHEN k > 0 AND b <= rank THEN rank - b ELSE rank END, CASE WHEN k > 0 AND b <= rank THEN k - 1 ELSE k END, CASE WHEN k > 0 AND b <= rank THEN c ELSE -1 END FROM (SELECT *, {choose} AS b FROM ur) WHERE c >= 0),
mb AS (SELECT p, cluster_id, CAST(bit_count(p) AS BIGINT) AS n FROM (SELECT range AS p FROM range(1, CASE WHEN (SELECT units FROM un) <= {most} THEN CAST(2 ** least((SELECT units FROM un), {most}) AS BIGINT) ELSE 1 END)), nu WHERE (p >> i) & 1 = 1 UNION ALL SELECT n * {draws} + ur.i, cluster_id, n FROM ur JOIN nu ON nu.i = took)"""


def pairs(rows: DataFrame, unit: str, value: str, keys: Sequence[str] = (), every: bool = False) -> DataFrame:
    """(keys, t, a, b, x, y) for units a < b of an hour, or for all a and b. Units are few: clusters, not rows."""
    a, b = rows.select(*keys, "t", F.col(unit).alias("a"), F.col(value).alias("x")), rows.select(*keys, "t", F.col(unit).alias("b"), F.col(value).alias("y"))
    both = a.join(b, [*keys, "t"])
    return both if every else both.where("a < b")


def covariances(x: DataFrame, unit: str) -> DataFrame:
    return pairs(x, unit, "r", every=True).groupBy("a", "b").agg(F.covar_pop("x", "y").alias("c"))


def portfolios(rows: DataFrame, unit: str) -> DataFrame:
    cv, m = covariances(complete(rows, unit), unit), subsets(rows, unit).where("n >= 2")
    both = m.select("p", "n", F.col(unit).alias("a")).join(m.select("p", F.col(unit).alias("b")), "p").join(cv, ["a", "b"])
    own = F.col("a") == F.col("b")
    z = both.groupBy("p", "n").agg(F.sum("c").alias("v"), F.sum(F.when(own, F.col("c"))).alias("s2"), F.sum(F.when(own, F.sqrt("c"))).alias("s1"))
    return z.select("p", "n", F.round(F.sqrt(F.col("v") / F.col("s2")), 6).alias("ratio"), F.round((F.col("v") - F.col("s2")) / (F.col("s1") * F.col("s1") - F.col("s2")), 6).alias("rho_w"))


def pooled(series: DataFrame, members: DataFrame, unit: str, key: str) -> DataFrame:
    """(key, n, t, v): the sum over a portfolio's units, NULL where one is missing."""
    s = series.join(members, unit).groupBy(key, "n", "t").agg(F.count("v").alias("have"), F.sum("v").alias("x"))
    return s.select(key, "n", "t", F.when(F.col("have") == F.col("n"), F.col("x")).alias("v"))


def portfolio_levels(series: DataFrame, unit: str, h: int, low: float, members: DataFrame) -> DataFrame:
    """(p, n, k, a): each portfolio's dependable level and its mean."""
    s = pooled(series, members, unit, "p")
    k = minima(s, [h], ["p", "n"]).groupBy("p", "n").agg(F.percentile("m", F.lit(low)).alias("k"))
    return k.join(s.groupBy("p").agg(F.avg("v").alias("a")), "p")


def portfolio_firmness(series: DataFrame, unit: str, h: int, low: float) -> DataFrame:
    return portfolio_levels(series, unit, h, low, subsets(series, unit)).groupBy("n").agg(F.count("*").alias("portfolios"), F.round(F.avg("k") / F.avg("a"), 6).alias("firmness"))


def nested(series: DataFrame, unit: str, h: int, low: float) -> DataFrame:
    r = series.groupBy(unit).agg(F.avg("v").alias("a")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("a"), unit)).cast("long"))
    m = r.select(unit, "rank").join(r.select(F.col("rank").alias("n")), F.col("rank") <= F.col("n")).select(unit, "n", F.col("n").alias("p"))
    s = pooled(series, m, unit, "p")
    return minima(s, [h], ["n"]).groupBy("n").agg(F.round(F.percentile("m", F.lit(low)), 6).alias("k"), F.count("*").alias("n_windows"))
