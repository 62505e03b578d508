"""Lookups in ranges, nulls by resampling, leave-one-out, audits of splits and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import power
from gridloom.operators import events, lookups, resample
from gridloom.operators.resample import drawn, drawn_sql
from gridloom.operators.rolling import filled, firm, fleet, lanes, minima, over, quantile, span, supported
from gridloom.plans.firm_queries import k_sql, m_sql
from gridloom.plans.model_queries import N_NULL, SHIFT_SEED, SHIFTS_SQL, ZERO, blocks_sql, zero
from gridloom.plans.registry import query
from gridloom.plans.series_queries import DAYS
from gridloom.sources.tables import FLEET, LANES, TELE, table, telemetry


@query("WITH c AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS cap FROM orders GROUP BY 1), l AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, round(coalesce(b.cap, (SELECT cap FROM c ORDER BY d LIMIT 1)), 2) AS cap FROM l ASOF LEFT JOIN c b ON l.d >= b.d")
def asof_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capacity of the last day that has one; before the first, the first."""
    c = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("cap"))
    days = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"))
    return lookups.daily(days, c, "d", "cap").select("l_orderkey", "l_linenumber", F.round("cap", 2).alias("cap"))


def best_sql(source: str, keys: str) -> str:
    """(keys, k): the split of (i, v) into two means with the least squared error."""
    part, cols = (f"PARTITION BY {keys} ", f"{keys}, ") if keys else ("", "")
    return f"SELECT {cols}arg_min(i, (round(sse, 6), i)) AS k FROM (SELECT {cols}i, (q1 - s1 * s1 / i) + (q - q1) - (s - s1) * (s - s1) / (n - i) AS sse, n FROM (SELECT {cols}i, sum(v) OVER b AS s1, sum(v * v) OVER b AS q1, sum(v) OVER a AS s, sum(v * v) OVER a AS q, count(*) OVER a AS n FROM {source} WINDOW b AS ({part}ORDER BY i ROWS UNBOUNDED PRECEDING), a AS ({part}))) WHERE i >= 5 AND i < n - 5" + (f" GROUP BY {keys}" if keys else "")


CURVE = power.CURVES["training"]


@query(f"WITH {TELE}, k AS (SELECT unnest({power.KNOTS}) AS x, unnest({CURVE}) AS y), s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS nx, lead(y) OVER (ORDER BY x) AS ny FROM k) SELECT cluster_id, round(avg(y + (ny - y) * (u - x) / (nx - x)), 9) AS g, count(*) AS n FROM tele JOIN s ON u >= x AND (u < nx OR (u = 1 AND nx = 1)) GROUP BY 1")
def piecewise_lookup(spark, sf_dir):
    """A curve through knots, as a sum of hinges instead of a range join."""
    rows = telemetry(spark, sf_dir).where("u is not null")
    return rows.groupBy("cluster_id").agg(F.round(F.avg(lookups.curve("u", power.KNOTS, CURVE)), 9).alias("g"), F.count("*").alias("n"))


@query(f"WITH {ZERO}, {SHIFTS_SQL}, rl AS (SELECT draw, lo + (t - lo + shift) % n AS t, sum(v) AS v FROM lanes JOIN nm USING (cluster_id) JOIN sh USING (u), span GROUP BY ALL), m AS ({m_sql('rl', [4], 'draw')}), k AS (SELECT draw, quantile_cont(m, 0.05) AS k FROM m GROUP BY draw) SELECT count(*) AS draws, round(avg(k), 6) AS k FROM k")
def raw_shift_null(spark, sf_dir):
    """Whole series rolled apart, trend and all."""
    s = zero(lanes(telemetry(spark, sf_dir))).withColumn("trend", F.lit(0.0))
    k = minima(resample.decorrelated(s, "cluster_id", N_NULL, SHIFT_SEED), [4], ["draw"]).groupBy("draw").agg(quantile("m", 0.05).alias("k"))
    return k.agg(F.count("*").alias("draws"), F.round(F.avg("k"), 6).alias("k"))


PERM_SQL = f"pe AS (SELECT t AS src, (SELECT lo FROM span) + row_number() OVER (ORDER BY {drawn_sql('t', '0', 4)}, t) - 1 AS t FROM spine)"


@query(f"WITH {FLEET}, {PERM_SQL}, s AS (SELECT pe.t, v FROM pe JOIN fleet ON fleet.t = src), m AS ({m_sql('s', [1, 4])}), k AS ({k_sql('m')}) SELECT h, alpha, round(k, 6) AS k, n_windows FROM k")
def shuffle_null(spark, sf_dir):
    """The dependable load of the same hours in a random order."""
    f = fleet(telemetry(spark, sf_dir))
    s = f.withColumn("i", F.row_number().over(Window.orderBy(drawn("t", "0", 4), "t")) - 1).crossJoin(span(f)).select((F.col("lo") + F.col("i")).alias("t"), "v")
    return firm(s, [1, 4], [0.5, 0.9, 0.95, 0.99]).withColumn("k", F.round("k", 6))


@query("WITH n AS (SELECT c_nationkey AS k, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 2), l AS (SELECT a.k AS left_out, n.* FROM n, (SELECT k FROM n) a WHERE n.k <> a.k) SELECT CAST(left_out AS BIGINT) AS left_out, count(*) AS n, round(regr_slope(log10(s), log10(m)), 6) AS slope FROM l WHERE s > 0 GROUP BY left_out")
def taylor_leave_one_out(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = o.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.count("*").alias("n")).where("n > 2")
    left = n.crossJoin(n.select(F.col("k").alias("left_out"))).where("k <> left_out and s > 0")
    return left.groupBy(F.col("left_out").cast("long").alias("left_out")).agg(F.count("*").alias("n"), F.round(F.regr_slope(F.log10("s"), F.log10("m")), 6).alias("slope"))


#: Replicates of a bootstrap over units.
N_BOOT = 500
PICKS_SQL = f"pk AS (SELECT rep, u AS i, {drawn_sql('rep', 'u', 9)} % (SELECT count(*) FROM x) AS u FROM x, (SELECT range AS rep FROM range({N_BOOT})))"


@query(f"WITH {LANES}, x AS (SELECT cluster_id, avg(v) AS a, stddev_samp(v) AS s, row_number() OVER (ORDER BY cluster_id) - 1 AS u FROM lanes GROUP BY 1), {PICKS_SQL} SELECT rep, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(s / a), 6) AS mean_cv FROM pk JOIN x USING (u) GROUP BY rep")
def unit_bootstrap(spark, sf_dir):
    """Units drawn with replacement."""
    x = lanes(telemetry(spark, sf_dir)).groupBy("cluster_id").agg(F.avg("v").alias("a"), F.stddev_samp("v").alias("s")).withColumn("u", (F.row_number().over(Window.orderBy("cluster_id")) - 1).cast("long"))
    return resample.picks(x, N_BOOT, 9).join(x, "u").groupBy("rep").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg(F.col("s") / F.col("a")), 6).alias("mean_cv"))


#: Hours of training and of test, and how far origins lie apart.
TRAIN, TEST, EVERY = 168, 72, 24
ORIGINS = f"{FLEET}, w AS (SELECT unnest(range(lo + {TRAIN}, lo + n - {TEST} + 1, {EVERY})) AS o FROM span), sp AS (SELECT o, o - {TRAIN} AS a, o AS b, o AS c, o + {TEST} AS d, row_number() OVER (ORDER BY o) <= count(*) OVER () // 2 AS early FROM w)"


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, a, b, c, d): the origins that the rows' calendar has room for, with their training and test hours."""
    o = span(telemetry(spark, sf_dir)).where(f"n >= {TRAIN + TEST}").select(F.explode(F.expr(f"sequence(lo + {TRAIN}, lo + n - {TEST}, {EVERY}L)")).alias("o"))
    return o.select("o", (F.col("o") - TRAIN).alias("a"), F.col("o").alias("b"), F.col("o").alias("c"), (F.col("o") + TEST).alias("d"))


@query(f"WITH {ORIGINS} SELECT x.o AS origin, y.o AS other, greatest(0, least(x.d, y.d) - greatest(x.c, y.c)) AS test_overlap, greatest(0, least(x.b, y.d) - greatest(x.a, y.c)) AS leak FROM sp x JOIN sp y ON x.o < y.o AND y.c < x.d")
def overlap_audit(spark, sf_dir):
    """Which origins share test hours, and whether a test lies in another's training. An origin has as many partners as
    steps fit into its test, so they are named and joined by equality."""
    w = origins(spark, sf_dir)
    x = w.withColumn("other", F.explode(F.expr(f"sequence(o + {EVERY}, o + {(TEST - 1) // EVERY * EVERY}, {EVERY}L)")))
    y = w.select(F.col("o").alias("other"), F.col("c").alias("yc"), F.col("d").alias("yd"))
    cut = lambda a, b, c, d: F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))
    return x.join(y, "other").select(F.col("o").alias("origin"), "other", cut("c", "d", "yc", "yd").alias("test_overlap"), cut("a", "b", "yc", "yd").alias("leak"))


@query(f"WITH {ORIGINS}, e AS (SELECT count(*) AS origins, count(*) FILTER (early) AS early, min(c) FILTER (early) AS c0, max(d) FILTER (early) AS c1, min(c) FILTER (NOT early) AS t0, max(d) FILTER (NOT early) AS t1, min(a) FILTER (NOT early) AS r0, max(b) FILTER (NOT early) AS r1 FROM sp) SELECT origins, early, greatest(0, least(c1, t1) - greatest(c0, t0)) AS scored_overlap, greatest(0, least(c1, r1) - greatest(c0, r0)) AS training_overlap FROM e")
def split_overlap(spark, sf_dir):
    """Hours that the tests of the earlier origins share with those of the later ones, and with their training."""
    w = origins(spark, sf_dir)
    x = w.withColumn("early", F.row_number().over(Window.orderBy("o")) <= F.expr("count(*) over () div 2"))
    on = lambda f, c, early: f(F.when(F.col("early") == early, F.col(c)))
    e = x.agg(F.count("*").alias("origins"), F.count_if("early").alias("early"), on(F.min, "c", True).alias("c0"), on(F.max, "d", True).alias("c1"), on(F.min, "c", False).alias("t0"), on(F.max, "d", False).alias("t1"), on(F.min, "a", False).alias("r0"), on(F.max, "b", False).alias("r1"))
    both = lambda a, b: F.greatest(F.lit(0), F.least("c1", b) - F.greatest("c0", a))
    return e.select("origins", "early", both("t0", "t1").alias("scored_overlap"), both("r0", "r1").alias("training_overlap"))


@query(f"WITH {LANES}, x AS (SELECT *, CASE WHEN count(v) OVER w >= 24 THEN avg(v) OVER w END AS tr FROM lanes WINDOW w AS (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)), y AS (SELECT cluster_id, t, coalesce(first_value(tr IGNORE NULLS) OVER (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(tr IGNORE NULLS) OVER (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS tr FROM x), z AS (SELECT *, median(tr) OVER (PARTITION BY cluster_id) AS mid FROM y) SELECT cluster_id, sum((abs(tr - mid) <= 0.1 * mid)::INT)::BIGINT AS stable_hours, count(*) AS n FROM z GROUP BY 1")
def stable_capacity(spark, sf_dir):
    """Hours whose trend is within a tenth of its median."""
    x = lanes(telemetry(spark, sf_dir)).withColumn("tr", supported(F.avg("v"), "v", over(["cluster_id"], -84, 83), 24)).withColumn("tr", filled("tr", ["cluster_id"]))
    x = x.withColumn("mid", F.median("tr").over(Window.partitionBy("cluster_id")))
    return x.groupBy("cluster_id").agg(F.sum((F.abs(F.col("tr") - F.col("mid")) <= 0.1 * F.col("mid")).cast("int")).alias("stable_hours"), F.count("*").alias("n"))


@query(f"WITH {LANES}, p AS (SELECT cluster_id, avg(CASE WHEN v < 20 THEN 1.0 ELSE 0.0 END) AS p, row_number() OVER (ORDER BY cluster_id) AS i FROM lanes WHERE v IS NOT NULL GROUP BY 1), s AS (SELECT range AS b FROM range(0, CAST(2 ** (SELECT count(*) FROM p) AS BIGINT))), q AS (SELECT b, product(CASE WHEN (b >> (i - 1)) & 1 = 1 THEN p ELSE 1 - p END) AS q FROM s, p GROUP BY b) SELECT bit_count(b)::BIGINT AS low, round(sum(q), 9) AS probability FROM q GROUP BY 1")
def low_count_distribution(spark, sf_dir):
    """The exact distribution of how many independent clusters are low at once, folded one cluster at a time."""
    p = lanes(telemetry(spark, sf_dir)).where("v is not null").groupBy("cluster_id").agg(F.avg((F.col("v") < 20).cast("double")).alias("p"))
    return lookups.poisson_binomial(p, "p").select("low", F.round("probability", 9).alias("probability"))


@query(f"WITH {FLEET}, m AS ({m_sql('fleet', [1, 2, 4, 8])}), k AS (SELECT h, quantile_cont(m, 0.05) AS k FROM m GROUP BY h), s AS (SELECT h, k, lead(h) OVER (ORDER BY h) AS nh, lead(k) OVER (ORDER BY h) AS nk, (SELECT max(k) FROM k) * 0.8 AS want FROM k) SELECT round(h + (nh - h) * (want - k) / (nk - k), 6) AS hours FROM s WHERE k >= want AND nk < want ORDER BY h LIMIT 1")
def inverse_duration(spark, sf_dir):
    """For how long four fifths of the best level hold, on the line between two durations."""
    k = firm(fleet(telemetry(spark, sf_dir)), [1, 2, 4, 8], [0.95]).select("h", "k")
    return lookups.crossing(k, "h", "k", 0.8).select(F.round("x", 6).alias("hours"))


@query(f"WITH {FLEET}, d AS (SELECT t, v, avg(v) OVER (ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS f FROM fleet), e AS (SELECT t // 240 AS era, v, f, f - v AS err FROM d WHERE v IS NOT NULL AND f IS NOT NULL) SELECT era, count(*) AS n, round(100 * (sum(f) / sum(v) - 1), 6) AS bias_pct, round(avg(abs(err)), 6) AS mae, round(quantile_cont(abs(err) / nullif(v, 0), 0.95), 6) AS rel_p95 FROM e GROUP BY era")
def evaluation(spark, sf_dir):
    """Bias, error and relative error of a forecast by the mean of the day before."""
    d = fleet(telemetry(spark, sf_dir)).withColumn("f", F.avg("v").over(over([], -24, -1))).where("v is not null and f is not null")
    e = F.abs(F.col("f") - F.col("v"))
    return d.groupBy(F.expr("t div 240").alias("era")).agg(F.count("*").alias("n"), F.round(100 * (F.sum("f") / F.sum("v") - 1), 6).alias("bias_pct"), F.round(F.avg(e), 6).alias("mae"), F.round(quantile(F.try_divide(e, F.col("v")), 0.95), 6).alias("rel_p95"))


@query(f"WITH {TELE}, b AS (SELECT least(floor(u * 10), 9)::BIGINT AS bin, u, w FROM tele WHERE u IS NOT NULL) SELECT bin, count(*) AS n, round(avg(u), 9) AS mean_u, round(sum(w * u) / sum(w), 9) AS weighted_u FROM b GROUP BY bin")
def utilisation_bins(spark, sf_dir):
    b = telemetry(spark, sf_dir).where("u is not null").groupBy(F.least(F.floor(F.col("u") * 10), F.lit(9)).alias("bin"))
    return b.agg(F.count("*").alias("n"), F.round(F.avg("u"), 9).alias("mean_u"), F.round(F.sum(F.col("w") * F.col("u")) / F.sum("w"), 9).alias("weighted_u"))


@query("SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, count(o.o_orderkey) AS n FROM orders o GROUP BY 1 UNION ALL SELECT d::DATE::VARCHAR, 0 FROM (SELECT unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS d) WHERE d::DATE NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)")
def calendar_reindex(spark, sf_dir):
    """Every day between the first and the last, with its number of rows."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).groupBy("day").agg(F.count("*").alias("n"))
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(days, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


#: Replicates of the changepoint's band, days of a block, seed.
CP_REPS, CP_BLOCK, CP_SEED = 300, 5, 7


@query(f"""WITH {DAYS}, ds AS (SELECT 1 AS lo, count(*) AS n FROM days), b AS ({best_sql('days', '')}), f AS (SELECT i, v, avg(v) OVER (PARTITION BY i <= k) AS mean FROM days, b),
{blocks_sql(CP_REPS, CP_BLOCK, CP_SEED, 'ds')}, d AS (SELECT rep, x.i, x.mean + y.v - y.mean AS v FROM ix JOIN f x ON x.i = pos + 1 JOIN f y ON y.i = src), k AS ({best_sql('d', 'rep')}) SELECT (SELECT k FROM b) AS k, round(quantile_cont(k, 0.05), 6) AS p5, round(quantile_cont(k, 0.95), 6) AS p95 FROM k""")
def changepoint_interval(spark, sf_dir):
    """A band for the day of the changepoint: the two means with blocks of residuals drawn again."""
    days = fleet(telemetry(spark, sf_dir)).groupBy(F.expr("t div 24 + 1").alias("i")).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
    k = events.changepoint(days).select("k")
    f = days.crossJoin(k).withColumn("mean", F.avg("v").over(Window.partitionBy(F.col("i") <= F.col("k")))).select("i", "mean", (F.col("v") - F.col("mean")).alias("r"))
    ix = resample.block_index(days.agg(F.lit(1).cast("long").alias("lo"), F.count("*").alias("n")), CP_REPS, CP_BLOCK, CP_SEED)
    d = ix.join(f.select(F.col("i").alias("src"), "r"), "src").join(f.select((F.col("i") - 1).alias("pos"), "mean"), "pos").select("rep", (F.col("pos") + 1).alias("i"), (F.col("mean") + F.col("r")).alias("v"))
    found = events.changepoint(d, keys=["rep"]).agg(F.percentile("k", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return k.crossJoin(found).select("k", F.round(F.col("q")[0], 6).alias("p5"), F.round(F.col("q")[1], 6).alias("p95"))
