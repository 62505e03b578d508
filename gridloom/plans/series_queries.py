"""Residuals, covariance, correlation, changepoints, occupancy and regressions of hourly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import covariance, events, fitting
from gridloom.operators.resample import uniform_sql
from gridloom.operators.rolling import deseasoned, fleet, interpolated, lanes, span, trend
from gridloom.plans.registry import query
from gridloom.sources.tables import FLEET, LANES, TELE, table, telemetry

RESID = LANES + """, c AS (SELECT *, v - CASE WHEN count(v) OVER w >= 24 THEN avg(v) OVER w END AS d, t % 24 + 24 * ((t // 24) % 7) AS how FROM lanes WINDOW w AS (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN 84 PRECEDING AND 84 FOLLOWING)),
res AS (SELECT cluster_id, t, v, d - avg(d) OVER (PARTITION BY cluster_id, how) AS r FROM c)"""
TREND_168 = """w1 AS (SELECT *, CASE WHEN count(v) OVER w >= 24 THEN avg(v) OVER w END AS x FROM lanes WINDOW w AS (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)),
tl AS (SELECT cluster_id, t, v, coalesce(first_value(x IGNORE NULLS) OVER (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(x IGNORE NULLS) OVER (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS trend FROM w1)"""
DAYS = FLEET + ", days AS (SELECT t // 24 + 1 AS i, coalesce(sum(v), 0) AS v FROM fleet GROUP BY 1)"


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deseasoned(lanes(telemetry(spark, sf_dir)), ["cluster_id"]).select("cluster_id", "t", "v", "r")


@query(f"WITH {RESID} SELECT cluster_id, t, round(r, 9) AS r FROM res")
def deseason_residual(spark, sf_dir):
    return residuals(spark, sf_dir).select("cluster_id", "t", F.round("r", 9).alias("r"))


@query(f"WITH {LANES}, x AS (SELECT *, CASE WHEN count(v) OVER w >= 24 THEN avg(v) OVER w END AS a FROM lanes WINDOW w AS (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)), y AS (SELECT cluster_id, t, v, first_value(a IGNORE NULLS) OVER (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cap FROM x), z AS (SELECT *, median(cap) OVER (PARTITION BY cluster_id) AS mid FROM y) SELECT cluster_id, t, round(CASE WHEN cap >= greatest(0.2 * mid, 0.05) THEN v / cap END, 6) AS x FROM z")
def capnorm_residual(spark, sf_dir):
    """Load over the capacity of the week before, where that isn't too small."""
    return covariance.capacity_normed(lanes(telemetry(spark, sf_dir)), ["cluster_id"]).select("cluster_id", "t", F.round("x", 6).alias("x"))


INTERP = ", x AS (SELECT cluster_id, t, v, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt, first_value(v IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS nt FROM lanes WINDOW b AS (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query(f"WITH {LANES}{INTERP} SELECT cluster_id, t, round(coalesce(v, CASE WHEN nt > pt THEN pv + (nv - pv) * (t - pt) / (nt - pt) END, nv, pv), 9) AS flat, round(coalesce(v, CASE WHEN nt > pt AND t - pt <= 2 THEN pv + (nv - pv) * (t - pt) / (nt - pt) END, nv, pv), 9) AS limited FROM x")
def interp_gaps(spark, sf_dir):
    s = lanes(telemetry(spark, sf_dir))
    a, b = interpolated(s, keys=["cluster_id"]), interpolated(s, 2, ["cluster_id"])
    return a.select("cluster_id", "t", F.round("x", 9).alias("flat")).join(b.select("cluster_id", "t", F.round("x", 9).alias("limited")), ["cluster_id", "t"])


@query(f"WITH {LANES}, l AS (SELECT unnest([1, 24, 168]) AS lag), m AS (SELECT cluster_id, avg(v) AS a, count(*) AS n FROM lanes WHERE v IS NOT NULL GROUP BY 1), d AS (SELECT cluster_id, t, v - a AS d FROM lanes JOIN m USING (cluster_id)), z AS (SELECT cluster_id, sum(d * d) AS s0, count(d) AS n0 FROM d GROUP BY 1), p AS (SELECT x.cluster_id, lag, sum(x.d * y.d) AS s, count(x.d * y.d) AS n FROM d x, l, d y WHERE y.cluster_id = x.cluster_id AND y.t = x.t + lag GROUP BY ALL) SELECT cluster_id, lag::BIGINT AS lag, round((s / n) / (s0 / n0), 6) AS acf FROM p JOIN z USING (cluster_id)")
def autocorr(spark, sf_dir):
    """Autocovariance at a lag over hours that both have values, per pair, over the variance."""
    return covariance.autocorrelation(lanes(telemetry(spark, sf_dir)), [1, 24, 168], ["cluster_id"])


@query(f"WITH {RESID}, s AS (SELECT t, sum(r) AS x, count(r) AS n FROM res GROUP BY t HAVING count(r) = (SELECT count(DISTINCT cluster_id) FROM res)), o AS (SELECT res.cluster_id, var_samp(r) AS q FROM res JOIN s USING (t) GROUP BY 1) SELECT count(*) AS hours, round(stddev_samp(x) / sqrt((SELECT sum(q) FROM o)), 6) AS ratio, round((SELECT sum(q) FROM o), 2) AS variance FROM s")
def sync_ratio(spark, sf_dir):
    """The standard deviation of the sum over that of independent parts."""
    return covariance.synchrony(residuals(spark, sf_dir), "cluster_id")


@query(f"""WITH {RESID}, u AS (SELECT DISTINCT cluster_id AS left_out FROM res), k AS (SELECT left_out, cluster_id, t, r FROM res, u WHERE cluster_id <> left_out),
s AS (SELECT left_out, t, sum(r) AS x FROM k GROUP BY ALL HAVING count(r) = (SELECT count(*) - 1 FROM u)), o AS (SELECT left_out, sum(q) AS q FROM (SELECT k.left_out, k.cluster_id, var_samp(r) AS q FROM k JOIN s USING (left_out, t) GROUP BY ALL) GROUP BY ALL)
SELECT left_out, round(stddev_samp(x) / sqrt(any_value(q)), 6) AS ratio FROM s JOIN o USING (left_out) GROUP BY left_out""")
def jackknife_sync(spark, sf_dir):
    res = residuals(spark, sf_dir)
    u = res.select(F.col("cluster_id").alias("left_out")).distinct()
    k = res.crossJoin(u).where("cluster_id <> left_out")
    return covariance.synchrony(k, "cluster_id", ["left_out"]).select("left_out", "ratio")


@query("WITH n AS (SELECT c_nationkey, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 2) SELECT count(*) AS n, round(regr_slope(log10(s), log10(m)), 6) AS slope, round(regr_intercept(log10(s), log10(m)), 6) AS intercept, round(corr(log10(s), log10(m)) ** 2, 6) AS r2 FROM n WHERE s > 0 AND m > 0")
def taylor_fit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = o.groupBy("c_nationkey").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.count("*").alias("n")).where("n > 2")
    return fitting.power_law(n, "m", "s")


QUAD = """, a AS (SELECT count(*) AS n, sum(x) AS sx, sum(x*x) AS sx2, sum(x*x*x) AS sx3, sum(x*x*x*x) AS sx4, sum(y) AS sy, sum(x*y) AS sxy, sum(x*x*y) AS sx2y FROM p),
d AS (SELECT *, n*(sx2*sx4 - sx3*sx3) - sx*(sx*sx4 - sx3*sx2) + sx2*(sx*sx3 - sx2*sx2) AS det FROM a)
SELECT n, round((sy*(sx2*sx4 - sx3*sx3) - sx*(sxy*sx4 - sx3*sx2y) + sx2*(sxy*sx3 - sx2*sx2y)) / det, 4) AS c0, round((n*(sxy*sx4 - sx2y*sx3) - sy*(sx*sx4 - sx3*sx2) + sx2*(sx*sx2y - sxy*sx2)) / det, 4) AS c1, round((n*(sx2*sx2y - sx3*sxy) - sx*(sx*sx2y - sx2*sxy) + sy*(sx*sx3 - sx2*sx2)) / det, 4) AS c2 FROM d"""


@query(f"WITH {TELE}, p AS (SELECT avg(u) AS x, avg(w) / 10 AS y FROM tele WHERE u IS NOT NULL GROUP BY pod_id){QUAD}")
def quadratic_fit(spark, sf_dir):
    """Least squares of a parabola from eight sums."""
    p = telemetry(spark, sf_dir).where("u is not null").groupBy("pod_id").agg(F.avg("u").alias("x"), (F.avg("w") / 10).alias("y"))
    return fitting.parabola(p)


@query(f"WITH {LANES}, c AS (SELECT a.cluster_id AS a, b.cluster_id AS b, corr(a.v, b.v) AS c, count(a.v + b.v) AS n FROM lanes a JOIN lanes b ON a.t = b.t AND a.cluster_id < b.cluster_id WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL) SELECT a, b, n, round(c, 6) AS corr, round(avg(c) OVER (), 6) AS mean_corr, round(median(c) OVER (), 6) AS median_corr FROM c")
def corr_upper(spark, sf_dir):
    return covariance.correlations(lanes(telemetry(spark, sf_dir)).where("v is not null"), "cluster_id")


EXC = f"""WITH {RESID}, ok AS (SELECT t FROM res GROUP BY t HAVING count(r) = (SELECT count(DISTINCT cluster_id) FROM res)), x AS (SELECT res.* FROM res JOIN ok USING (t)),
u AS (SELECT cluster_id, var_pop(r) AS q FROM x GROUP BY 1), s AS (SELECT sum(q) AS s2, sum(sqrt(q)) AS s1, sum((q / (SELECT sum(q) FROM u)) ** 2) AS hhi FROM u), f AS (SELECT var_pop(z) AS v FROM (SELECT t, sum(r) AS z FROM x GROUP BY t))"""


@query(f"{EXC} SELECT round(v / s2 - 1, 6) AS excess, round(sqrt(v / s2), 6) AS sync, round((v - s2) / (s1 * s1 - s2), 6) AS rho_w, round(hhi, 6) AS hhi FROM s, f")
def excess_covariance(spark, sf_dir):
    return covariance.excess(residuals(spark, sf_dir), "cluster_id")


@query(f"""{EXC.replace('WITH ', 'WITH RECURSIVE ', 1)}, cv AS (SELECT a.cluster_id AS a, b.cluster_id AS b, covar_pop(a.r, b.r) AS c FROM x a JOIN x b ON a.t = b.t GROUP BY ALL), {covariance.subsets_sql('u')},
z AS (SELECT p, ma.n, sum(c) AS v, sum(CASE WHEN a = b THEN c END) AS s2, sum(CASE WHEN a = b THEN sqrt(c) END) AS s1 FROM mb ma JOIN mb USING (p) JOIN cv ON cv.a = ma.cluster_id AND cv.b = mb.cluster_id WHERE ma.n >= 2 GROUP BY p, ma.n)
SELECT p, n, round(sqrt(v / s2), 6) AS ratio, round((v - s2) / (s1 * s1 - s2), 6) AS rho_w FROM z""")
def cov_portfolios(spark, sf_dir):
    """Every portfolio of two clusters or more, from one covariance matrix."""
    return covariance.portfolios(residuals(spark, sf_dir), "cluster_id")


@query(f"WITH {LANES}, c AS (SELECT cluster_id FROM lanes GROUP BY 1 HAVING avg(v) >= 1 AND count(v) >= 100), m AS (SELECT l.*, v >= 0.25 * max(v) OVER (PARTITION BY cluster_id) AS high FROM lanes l JOIN c USING (cluster_id)), h AS (SELECT t, bool_and(coalesce(high, false)) AS all_high FROM m GROUP BY t) SELECT count(*) AS full_hours, sum((t BETWEEN lo + 168 AND lo + n - 169)::INT)::BIGINT AS trimmed, sum(all_high::INT)::BIGINT AS allocated, sum((all_high AND t BETWEEN lo + 168 AND lo + n - 169)::INT)::BIGINT AS both FROM h, span")
def support_masks(spark, sf_dir):
    """Hours that pass an edge trim, a least allocation in every cluster, or both."""
    s = lanes(telemetry(spark, sf_dir))
    c = s.groupBy("cluster_id").agg(F.avg("v").alias("a"), F.count("v").alias("n")).where("a >= 1 AND n >= 100").select("cluster_id")
    m = s.join(c, "cluster_id", "left_semi").withColumn("high", F.coalesce(F.col("v") >= 0.25 * F.max("v").over(Window.partitionBy("cluster_id")), F.lit(False)))
    h = m.groupBy("t").agg(F.bool_and("high").alias("high")).crossJoin(span(s)).withColumn("trim", F.expr("t BETWEEN lo + 168 AND lo + n - 169"))
    n = lambda c: F.sum(c.cast("int"))
    return h.agg(F.count("*").alias("full_hours"), n(F.col("trim")).alias("trimmed"), n(F.col("high")).alias("allocated"), n(F.col("high") & F.col("trim")).alias("both"))


def pooled_sql(most: int = covariance.ENUMERATED, draws: int = covariance.DRAWN) -> str:
    """CTEs up to pk (p, n, k, a): each portfolio's dependable level over four hours, and its mean."""
    return f"""{LANES}, {covariance.subsets_sql('lanes', most, draws)},
s AS (SELECT p, any_value(mb.n) AS n, t, CASE WHEN count(v) = any_value(mb.n) THEN sum(v) END AS v FROM mb JOIN lanes USING (cluster_id) GROUP BY p, t), m AS (SELECT p, n, min(v) OVER w AS m, count(v) OVER w AS c FROM s WINDOW w AS (PARTITION BY p ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)), k AS (SELECT p, n, quantile_cont(m, 0.05) AS k FROM m WHERE c = 4 GROUP BY p, n), pk AS (SELECT * FROM k JOIN (SELECT p, avg(v) AS a FROM s GROUP BY p) USING (p))"""


@query(f"WITH RECURSIVE {pooled_sql()} SELECT n, count(*) AS portfolios, round(avg(k) / avg(a), 6) AS firmness FROM pk GROUP BY n")
def portfolio_enum(spark, sf_dir):
    """Dependable share of the mean by portfolio size, over all portfolios."""
    return covariance.portfolio_firmness(lanes(telemetry(spark, sf_dir)), "cluster_id", 4, 0.05)


#: Portfolios of each size that are drawn, and the share of the mean that they hold.
SCAN = 6


@query(f"WITH RECURSIVE {pooled_sql(0, SCAN)} SELECT n, count(*) AS portfolios, round(quantile_cont(k / a, 0.05), 6) AS p5, round(quantile_cont(k / a, 0.5), 6) AS p50, round(quantile_cont(k / a, 0.95), 6) AS p95 FROM pk GROUP BY n")
def portfolio_scan(spark, sf_dir):
    """The spread of the dependable share over portfolios drawn without repetition, by their size."""
    s = lanes(telemetry(spark, sf_dir))
    k = covariance.portfolio_levels(s, "cluster_id", 4, 0.05, covariance.subsets(s, "cluster_id", most=0, draws=SCAN))
    q = k.groupBy("n").agg(F.count("*").alias("portfolios"), F.percentile(F.col("k") / F.col("a"), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select("n", "portfolios", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("p5", "p50", "p95"))])


@query(f"""WITH {LANES}, r AS (SELECT cluster_id, row_number() OVER (ORDER BY avg(v) DESC, cluster_id) AS rank FROM lanes GROUP BY 1), s AS (SELECT n, t, CASE WHEN count(v) = n THEN sum(v) END AS v FROM r JOIN (SELECT rank AS n FROM r) z ON rank <= n JOIN lanes USING (cluster_id) GROUP BY n, t), m AS (SELECT n, min(v) OVER w AS m, count(v) OVER w AS c FROM s WINDOW w AS (PARTITION BY n ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT n, round(quantile_cont(m, 0.05), 6) AS k, count(*) AS n_windows FROM m WHERE c = 4 GROUP BY n""")
def nested_topn(spark, sf_dir):
    """The largest cluster, the two largest, and so on."""
    return covariance.nested(lanes(telemetry(spark, sf_dir)), "cluster_id", 4, 0.05)


@query(f"""WITH {DAYS}, x AS (SELECT i, sum(v) OVER b AS s1, sum(v * v) OVER b AS q1, sum(v) OVER () AS s, sum(v * v) OVER () AS q, count(*) OVER () AS n FROM days WINDOW b AS (ORDER BY i ROWS UNBOUNDED PRECEDING)),
y AS (SELECT i, q - s * s / n AS sse0, (q1 - s1 * s1 / i) + (q - q1) - (s - s1) * (s - s1) / (n - i) AS sse FROM x WHERE i >= 5 AND i < n - 5) SELECT (SELECT i FROM y ORDER BY round(sse, 6), i LIMIT 1) AS k, round(min(sse), 2) AS sse, round(1 - min(sse) / any_value(sse0), 6) AS reduction FROM y""")
def changepoint(spark, sf_dir):
    days = fleet(telemetry(spark, sf_dir)).groupBy(F.expr("t div 24 + 1").alias("i")).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
    return events.changepoint(days).select("k", F.round("sse", 2).alias("sse"), F.round("reduction", 6).alias("reduction"))


STEPS = f"{TELE}, st AS (SELECT t + k / 100.0::DOUBLE AS p, w AS x FROM tele UNION ALL SELECT t + 3 + k / 50.0::DOUBLE, -w FROM tele), ce AS (SELECT CAST(floor(p) AS BIGINT) AS t, x * (1 - (p - floor(p))) AS x FROM st UNION ALL SELECT CAST(floor(p) AS BIGINT) + 1, x * (p - floor(p)) FROM st), oc AS (SELECT t, sum(sum(x)) OVER (ORDER BY t) AS level FROM ce GROUP BY t)"


def steps(tele: DataFrame) -> DataFrame:
    up = tele.select((F.col("t") + F.col("k") / 100.0).alias("p"), F.col("w").alias("x"))
    return up.unionByName(tele.select((F.col("t") + 3 + F.col("k") / 50.0).alias("p"), (-F.col("w")).alias("x")))


@query(f"WITH {STEPS} SELECT t, round(level, 4) AS level FROM oc")
def occupancy_steps(spark, sf_dir):
    return events.occupancy(steps(telemetry(spark, sf_dir)), "p", "x").select("t", F.round("level", 4).alias("level"))


@query(f"WITH {STEPS} SELECT t // 24 AS day, round(quantile_cont(abs(level), 0.99), 4) AS p99 FROM oc GROUP BY 1")
def daily_p99(spark, sf_dir):
    return events.occupancy(steps(telemetry(spark, sf_dir)), "p", "x").groupBy(F.expr("t div 24").alias("day")).agg(F.round(F.percentile(F.abs("level"), F.lit(0.99)), 4).alias("p99"))


@query("WITH s AS (SELECT date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 30.0 AS a, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 30.0 AS b, l_quantity AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT *, unnest(range(CAST(floor(a) AS BIGINT), CAST(ceil(b) AS BIGINT))) AS t FROM s WHERE b > a AND w > 0) SELECT t, round(sum(w * (least(b, t + 1) - greatest(a, t))), 2) AS x FROM c GROUP BY t")
def session_occupancy(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.datediff(c, F.lit("1995-01-01").cast("date")) / 30.0
    s = j.select(day("o_orderdate").alias("a"), day("l_shipdate").alias("b"), F.col("l_quantity").alias("w"))
    return events.sessions(s, "a", "b", "w").select("t", F.round("x", 2).alias("x"))


#: The transform as sums: amplitudes of the residual's spectrum, then cosines with drawn phases.
FOURIER = f"""x AS (SELECT cluster_id, u, t - lo AS j, t, v, trend, coalesce(v - trend, avg(v - trend) OVER (PARTITION BY cluster_id)) AS r, n FROM tl JOIN nm USING (cluster_id), span),
f AS (SELECT cluster_id, any_value(u) AS u, k, any_value(n) AS n, sqrt(sum(r * cos(2 * pi() * ((j * k) % n) / n)) ** 2 + sum(r * sin(2 * pi() * ((j * k) % n) / n)) ** 2) AS a FROM x, (SELECT unnest(range(n // 2 + 1)) AS k FROM span) GROUP BY cluster_id, k),
h AS (SELECT cluster_id, k, CASE WHEN k = 0 OR 2 * k = n THEN a ELSE 2 * a END AS a, CASE WHEN k = 0 OR 2 * k = n THEN 0 ELSE 2 * pi() * {uniform_sql('k', 'u', 3)} END AS phase FROM f)"""


@query(f"WITH {LANES}, {TREND_168}, nm AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS u FROM (SELECT DISTINCT cluster_id FROM lanes)), {FOURIER} SELECT x.cluster_id, t, round(any_value(v), 6) AS v, round(CASE WHEN any_value(v) IS NOT NULL THEN any_value(trend) + sum(a * cos(2 * pi() * ((j * k) % n) / n + phase)) / any_value(n) END, 5) AS s FROM x JOIN h USING (cluster_id) GROUP BY x.cluster_id, t")
def phase_surrogate(spark, sf_dir):
    """Each cluster's trend plus a residual with its spectrum and drawn phases; a grouped numpy step, as Spark has no
    transform."""
    s = trend(lanes(telemetry(spark, sf_dir)), 84, 83, 24, ["cluster_id"])
    return fitting.surrogates(s, seed=3).select("cluster_id", "t", F.round("v", 6).alias("v"), F.round("s", 5).alias("s"))


def plateau_sql(least: int) -> str:
    return f"""WITH RECURSIVE {FLEET}, s AS (SELECT t, CASE WHEN count(v) OVER w >= 24 THEN avg(v) OVER w END AS v FROM fleet WINDOW w AS (ORDER BY t ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)),
p AS (SELECT a.t AS i, b.t AS j, max(b.v) OVER w - min(b.v) OVER w <= 0.05 * avg(b.v) OVER w AND count(b.v) OVER w = b.t - a.t + 1 AS ok, avg(b.v) OVER w AS mean FROM s a JOIN s b ON b.t >= a.t WINDOW w AS (PARTITION BY a.t ORDER BY b.t ROWS UNBOUNDED PRECEDING)),
e AS (SELECT i, coalesce(min(j) FILTER (NOT ok), (SELECT lo + n FROM span)) AS stop FROM p GROUP BY i),
r AS (SELECT lo AS i FROM span UNION ALL SELECT CASE WHEN stop - i >= {least} THEN stop ELSE i + 1 END FROM r JOIN e USING (i))
SELECT r.i AS first, stop - 1 AS last, round(mean, 6) AS mean FROM r JOIN e USING (i) JOIN p ON p.i = r.i AND p.j = stop - 1 WHERE stop - r.i >= {least}"""


def level_runs(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    return fitting.plateaus(fleet(telemetry(spark, sf_dir)), least=least, spread=0.05).select("first", "last", F.round("mean", 6).alias("mean"))


@query(plateau_sql(336))
def plateaus(spark, sf_dir):
    """Greedy runs of two weeks or more whose weekly mean stays within 5 %; each run depends on where the last ended."""
    return level_runs(spark, sf_dir, 336)


@query(plateau_sql(24))
def plateaus_of_a_day(spark, sf_dir):
    """The same for runs of a day or more, of which a month has some."""
    return level_runs(spark, sf_dir, 24)
