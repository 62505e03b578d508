"""Curves fitted by racks with their bands and their held-out errors; exact quantiles of large groups; long series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import fitting, resample, selection
from gridloom.operators.rolling import long_dense, long_minima, long_trend
from gridloom.plans.registry import query
from gridloom.plans.series_queries import QUAD
from gridloom.sources.tables import table, telemetry

#: Where segments of the curve begin, and their width; racks are five pods, and every fifth is held out.
KNOTS, WIDTH = [0.0, 0.25, 0.5, 0.75], 0.25
RACK, HELD = "pod_id div 5", "(pod_id div 5) % 5 = 0"
CURVE_REPS = 100


def basis() -> list:
    return fitting.increments("u", KNOTS, WIDTH)


def rack_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least-squares sums of each rack that isn't held out."""
    rows = telemetry(spark, sf_dir).where(f"u is not null and not ({HELD})").withColumn("rack", F.expr(RACK))
    return fitting.gram(rows, basis(), "w", ["rack"])


def together(sums: DataFrame) -> DataFrame:
    """The sums of all racks, a row."""
    k = len(KNOTS) + 1
    x = sums.agg(*[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(k * k)], *[F.sum(F.col("b")[i]).alias(f"b{i}") for i in range(k)], F.sum("n").alias("n"))
    return x.where("n > 0").select(F.array(*[f"g{i}" for i in range(k * k)]).alias("g"), F.array(*[f"b{i}" for i in range(k)]).alias("b"), "n")


@query()
def nnls_curve(spark, sf_dir):
    """A curve that doesn't fall, by non-negative least squares on four fifths of the racks; each segment's rise."""
    return fitting.solved(together(rack_sums(spark, sf_dir)))


@query()
def curve_bands(spark, sf_dir):
    """The curve at its knots, with bands from racks drawn again: a non-negative solution for each replicate."""
    sums = rack_sums(spark, sf_dir)
    fit = fitting.level_at(fitting.solved(together(sums))).select("i", F.round("x", 4).alias("fit"))
    draws = fitting.level_at(fitting.solved(fitting.resampled(sums, "rack", CURVE_REPS, 42), "rep long"), ["rep"])
    q = draws.groupBy("i").agg(F.count("*").alias("reps"), F.percentile("x", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return fit.join(q, "i").select("i", "fit", "reps", *[F.round(F.col("q")[k], 4).alias(n) for k, n in enumerate(("low", "mid", "high"))])


@query()
def curve_holdout(spark, sf_dir):
    """How the curve does on the racks it was fitted on and on those held out: bias, error, quantiles of the relative error."""
    x = fitting.solved(together(rack_sums(spark, sf_dir))).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda r: r.x).alias("coefficients"))
    rows = telemetry(spark, sf_dir).where("u is not null and w is not null").crossJoin(x)  # a row
    e = rows.select(F.when(F.expr(HELD), "held out").otherwise("fitted").alias("panel"), "w", fitting.predicted(basis()).alias("p"))
    s = e.groupBy("panel").agg(F.count("*").alias("n"), F.round(F.sum("p") / F.sum("w") - 1, 6).alias("bias"), F.round(F.avg(F.abs(F.col("p") - F.col("w"))), 4).alias("mae"))
    q = selection.exact_quantiles(e.where("w > 0").select("panel", (F.col("p") / F.col("w") - 1).alias("x")), ["panel"], "x", [0.01, 0.05, 0.5, 0.95, 0.99])
    q = q.groupBy("panel").pivot("share", [0.01, 0.05, 0.5, 0.95, 0.99]).agg(F.round(F.first("q"), 5)).toDF("panel", "q1", "q5", "q50", "q95", "q99")
    return s.join(q, "panel")


NATIONS = "n AS (SELECT CAST(c_nationkey AS BIGINT) AS k, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 2), x AS (SELECT log10(m) - 5.1 AS x, log10(s) AS y, row_number() OVER (ORDER BY k) - 1 AS u FROM n WHERE s > 0)"
QUAD_BY = QUAD[2:].replace("a AS (SELECT count(*) AS n", "a AS (SELECT rep, count(*) AS n").replace("FROM p)", "FROM p GROUP BY rep)").split("SELECT n, round(")[0]
C2 = "(n*(sx2*sx2y - sx3*sxy) - sx*(sx*sx2y - sx2*sxy) + sy*(sx*sx3 - sx2*sx2)) / nullif(det, 0)"


@query(f"WITH {NATIONS}, p AS (SELECT -1 AS rep, x, y FROM x UNION ALL SELECT rep, x, y FROM (SELECT rep, {resample.drawn_sql('rep', 'u', 43)} % (SELECT count(*) FROM x) AS u FROM x, (SELECT range AS rep FROM range(500))) JOIN x USING (u)), {QUAD_BY}, q AS (SELECT rep, {C2} AS c2 FROM d WHERE rep IN (SELECT rep FROM p GROUP BY rep HAVING count(DISTINCT x) > 4)) SELECT round((SELECT c2 FROM q WHERE rep = -1), 2) AS c2, round(quantile_cont(c2, 0.025) FILTER (rep >= 0), 1) AS low, round(quantile_cont(c2, 0.975) FILTER (rep >= 0), 1) AS high FROM q")
def quadratic_interval(spark, sf_dir):
    """The quadratic coefficient of spread against mean on a log scale, with an interval from units drawn again."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = o.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.count("*").alias("n")).where("n > 2 and s > 0")
    x = n.withColumn("u", F.row_number().over(Window.orderBy(F.asc_nulls_last("k"))).cast("long") - 1).select("u", (F.log10("m") - 5.1).alias("x"), F.log10("s").alias("y"))
    rows = resample.picks(x, 500, 43).join(x, "u").select("rep", "x", "y").unionByName(x.select(F.lit(-1).cast("long").alias("rep"), "x", "y"))
    enough = rows.groupBy("rep").agg(F.countDistinct("x").alias("different")).where("different > 4").select("rep")
    c = fitting.parabola(fitting.centred(rows.join(enough, "rep", "left_semi"), ["rep"]), ["rep"], 12)
    q = F.percentile(F.when(F.col("rep") >= 0, F.col("c2")), F.array(F.lit(0.025), F.lit(0.975))).alias("q")
    return c.agg(F.max(F.when(F.col("rep") < 0, F.col("c2"))).alias("c2"), q).select(F.round("c2", 2).alias("c2"), F.round(F.col("q")[0], 1).alias("low"), F.round(F.col("q")[1], 1).alias("high"))


SHARES = [0.01, 0.05, 0.5, 0.95, 0.99]


@query("SELECT l_returnflag, unnest([0.01, 0.05, 0.5, 0.95, 0.99])::DOUBLE AS share, round(unnest(quantile_cont(l_extendedprice, [0.01, 0.05, 0.5, 0.95, 0.99])), 4) AS q, count(*) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag")
def exact_quantiles(spark, sf_dir):
    """Quantiles of groups of any size, by passes that narrow down where each rank lies."""
    out = selection.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", SHARES, limit=2000)
    return out.select("l_returnflag", "share", F.round("q", 4).alias("q"), "n")


MINUTE = 60_000_000
MINUTES = f"WITH s AS (SELECT epoch_us(ts) // {MINUTE} AS t, sum(value) AS v FROM events GROUP BY 1), g AS (SELECT t, v FROM (SELECT unnest(range((SELECT min(t) FROM s), (SELECT max(t) + 1 FROM s))) AS t) LEFT JOIN s USING (t)), z AS (SELECT t, coalesce(v, 0) AS v FROM g)"


def by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, v): one series of all minutes, 0 where nothing happened."""
    us = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) div {MINUTE}")
    s = table(spark, sf_dir, "events").groupBy(us.alias("t")).agg(F.sum("value").alias("v"))
    return long_dense(s).select("t", F.coalesce("v", F.lit(0.0)).alias("v"))


SMOOTH = f"{MINUTES}, y AS (SELECT t, CASE WHEN count(v) OVER w >= 60 THEN avg(v) OVER w END AS v FROM z WINDOW w AS (ORDER BY t ROWS BETWEEN 719 PRECEDING AND 720 FOLLOWING))"


@query(f"{SMOOTH}, m AS (SELECT 60::BIGINT AS h, min(v) OVER w AS m, count(v) OVER w = 60 AS ok FROM y WINDOW w AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) UNION ALL SELECT 240, min(v) OVER w, count(v) OVER w = 240 FROM y WINDOW w AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND 239 FOLLOWING)) SELECT h, unnest([0.01, 0.05])::DOUBLE AS share, round(unnest(quantile_cont(m, [0.01, 0.05])), 6) AS k, count(*) AS n_windows FROM m WHERE ok GROUP BY h")
def firm_by_minute(spark, sf_dir):
    """Dependable levels of one long series: its windows are dealt over blocks, its quantiles selected exactly."""
    y = long_trend(by_minute(spark, sf_dir), 719, 720, 60, block=1 << 12).select("t", F.col("trend").alias("v"))
    m = long_minima(y, [60, 240], block=1 << 12)
    out = selection.exact_quantiles(m, ["h"], "m", [0.01, 0.05], limit=5000)
    return out.select("h", "share", F.round("q", 6).alias("k"), F.col("n").alias("n_windows"))
