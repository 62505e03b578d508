"""How much of an hourly load can be relied on: running minima, their quantiles, splits, events and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import backtest, events
from gridloom.operators.rolling import dense, filled, firm, fleet, islands, lanes, minima, over, quantile, span, supported, trend
from gridloom.plans.registry import query
from gridloom.sources.tables import FLEET, LANES, telemetry

SHARES = [0.5, 0.9, 0.95, 0.99]


def m_sql(source: str, hours: list[int], keys: str = "", v: str = "v") -> str:
    """Running minima of several durations: (keys, t, h, m)."""
    part = f"PARTITION BY {keys}" if keys else ""
    cols = f"{keys}, " if keys else ""
    one = "SELECT {c}t, {h}::BIGINT AS h, m FROM (SELECT {c}t, min({v}) OVER w AS m, count({v}) OVER w AS n FROM {s} WINDOW w AS ({p} ORDER BY t ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING)) WHERE n = {h}"
    return " UNION ALL ".join(one.format(c=cols, h=h, v=v, s=source, p=part, k=h - 1) for h in hours)


def k_sql(m: str, keys: str = "", shares: list[float] = SHARES) -> str:
    cols = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {cols}h, {a}::DOUBLE AS alpha, quantile_cont(m, {round(1 - a, 10)}) AS k, count(*) AS n_windows FROM {m} GROUP BY {cols}h" for a in shares)


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {FLEET}, m AS ({m_sql('fleet', [1, 2, 4, 24])}), k AS ({k_sql('m')}) SELECT h, alpha, round(k, 6) AS k, n_windows FROM k")
def k_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependable load of the fleet by duration and share of windows; windows over a gap don't count."""
    return r6(firm(fleet(telemetry(spark, sf_dir)), [1, 2, 4, 24], SHARES), "k")


@query(f"WITH {LANES}, m AS ({m_sql('lanes', [1, 4], 'cluster_id')}), k AS ({k_sql('m', 'cluster_id')}) SELECT cluster_id, h, alpha, round(k, 6) AS k, n_windows, n_windows // h AS n_disjoint, CAST(floor(round((1 - alpha) * n_windows, 6)) AS BIGINT) AS n_below FROM k")
def k_lanes(spark, sf_dir):
    k = firm(lanes(telemetry(spark, sf_dir)), [1, 4], SHARES, ["cluster_id"])
    return r6(k, "k").withColumn("n_disjoint", F.expr("n_windows div h")).withColumn("n_below", F.floor(F.round((1 - F.col("alpha")) * F.col("n_windows"), 6)))


@query(f"WITH {FLEET}, m AS ({m_sql('fleet', [1, 4])}) SELECT h, t % 24 AS hour, round(quantile_cont(m, 0.05), 6) AS k, count(*) AS n FROM m GROUP BY ALL")
def k_by_hour(spark, sf_dir):
    """By the hour of day that a window starts in."""
    return minima(fleet(telemetry(spark, sf_dir)), [1, 4]).groupBy("h", F.expr("t % 24").alias("hour")).agg(F.round(quantile("m", 0.05), 6).alias("k"), F.count("*").alias("n"))


@query(f"WITH {FLEET}, e AS (SELECT era, t, CASE WHEN t // 240 = era THEN v END AS v FROM fleet, (SELECT DISTINCT t // 240 AS era FROM fleet)), m AS ({m_sql('e', [1, 4], 'era')}) SELECT era::BIGINT AS era, h, round(quantile_cont(m, 0.05), 6) AS k, count(*) AS n FROM m GROUP BY ALL")
def k_eras(spark, sf_dir):
    """By era; windows that reach over an era's edge don't count."""
    rows = fleet(telemetry(spark, sf_dir)).withColumn("era", F.expr("t div 240"))
    return minima(rows, [1, 4], ["era"]).groupBy("era", "h").agg(F.round(quantile("m", 0.05), 6).alias("k"), F.count("*").alias("n"))


@query(f"WITH {FLEET}, m AS ({m_sql('fleet', [1, 4])}), k AS (SELECT h, quantile_cont(m, 0.05) AS k FROM m, span WHERE t + h <= lo + n // 2 GROUP BY h) SELECT h, round(k, 6) AS k, round(avg(CASE WHEN m >= k THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM m JOIN k USING (h), span WHERE t >= lo + n // 2 GROUP BY ALL")
def k_holdout(spark, sf_dir):
    """How often the later half holds the dependable load of the first."""
    f = fleet(telemetry(spark, sf_dir))
    m = minima(f, [1, 4]).crossJoin(span(f).select(F.expr("lo + n div 2").alias("half")))
    k = m.where("t + h <= half").groupBy("h").agg(quantile("m", 0.05).alias("k"))
    late = m.where("t >= half").join(k, "h")
    return late.groupBy("h", F.round("k", 6).alias("k")).agg(F.round(F.avg((F.col("m") >= F.col("k")).cast("double")), 6).alias("coverage"))


PART = "sum(w) FILTER (priority_class = 'LP')"


def two(tele: DataFrame) -> DataFrame:
    """(t, v, c): the whole load, and the part of low priority (0 where the hour has none)."""
    sums = tele.groupBy("t").agg(F.sum("w").alias("v"), F.sum(F.when(F.col("priority_class") == "LP", F.col("w")).otherwise(0.0)).alias("c"))
    return dense(sums)


TWO = FLEET + ", two AS (SELECT s.t, sum(w) AS v, sum(CASE WHEN priority_class = 'LP' THEN w WHEN w IS NOT NULL THEN 0 END) AS c FROM spine s LEFT JOIN tele USING (t) GROUP BY s.t)"


@query(f"WITH {TWO}, l AS ({m_sql('two', [1, 4])}), kl AS ({k_sql('l')}), a AS (SELECT sum(c) / sum(v) AS s FROM two) SELECT h, alpha, round(s * k, 6) AS k_const FROM kl, a")
def const_baseline(spark, sf_dir):
    """The dependable load if a constant share of it were taken."""
    rows = two(telemetry(spark, sf_dir))
    share = rows.agg((F.sum("c") / F.sum("v")).alias("s"))
    return firm(rows, [1, 4], SHARES).crossJoin(F.broadcast(share)).select("h", "alpha", F.round(F.col("s") * F.col("k"), 6).alias("k_const"))


@query(f"WITH {TWO}, l AS ({m_sql('two', [1, 4])}), c AS ({m_sql('two', [1, 4], v='c')}), kl AS ({k_sql('l')}), kc AS ({k_sql('c')}) SELECT h, alpha, round(kc.k / kl.k, 6) AS required FROM kl JOIN kc USING (h, alpha)")
def required_share(spark, sf_dir):
    """The share of the load's dependable level that a part of it reaches."""
    rows = two(telemetry(spark, sf_dir))
    kl, kc = firm(rows, [1, 4], SHARES).withColumnRenamed("k", "kl").drop("n_windows"), firm(rows.select("t", F.col("c").alias("v")), [1, 4], SHARES)
    return kl.join(kc, ["h", "alpha"]).select("h", "alpha", F.round(F.try_divide("k", "kl"), 6).alias("required"))


@query(f"WITH {FLEET}, m AS ({m_sql('fleet', [1, 4])}), r AS (SELECT h, m, row_number() OVER (PARTITION BY h ORDER BY m) AS i, count(*) OVER (PARTITION BY h) AS n FROM m), a AS (SELECT unnest([0.5, 0.9, 0.95]) AS alpha) SELECT h, alpha::DOUBLE AS alpha, round(m, 6) AS cap FROM r, a WHERE i = n - CAST(ceil(round(alpha * n, 6)) AS BIGINT) + 1")
def order_stat_cap(spark, sf_dir):
    """The largest level that at least a share alpha of windows reaches, without interpolation."""
    m = minima(fleet(telemetry(spark, sf_dir)), [1, 4])
    return events.order_cap(m, ["h"], [0.5, 0.9, 0.95])


@query(f"WITH {LANES}, x AS (SELECT *, CASE WHEN count(v) OVER w >= 24 THEN avg(v) OVER w END AS tr FROM lanes WINDOW w AS (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)) SELECT cluster_id, t, round(coalesce(first_value(tr IGNORE NULLS) OVER (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(tr IGNORE NULLS) OVER (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS trend FROM x")
def rolling_trend_168(spark, sf_dir):
    return trend(lanes(telemetry(spark, sf_dir)), 84, 83, 24, ["cluster_id"]).select("cluster_id", "t", F.round("trend", 9).alias("trend"))


@query(f"WITH {LANES} SELECT cluster_id, t, round(CASE WHEN count(v) OVER w >= 24 THEN avg(v) OVER w END, 9) AS trend FROM lanes WINDOW w AS (PARTITION BY cluster_id ORDER BY t ROWS BETWEEN 84 PRECEDING AND 84 FOLLOWING)")
def rolling_trend_169(spark, sf_dir):
    return trend(lanes(telemetry(spark, sf_dir)), 84, 84, 24, ["cluster_id"], fill=False).select("cluster_id", "t", F.round("trend", 9).alias("trend"))


@query(f"WITH {FLEET}, x AS (SELECT t, CASE WHEN count(v) OVER w >= 24 THEN max(v) OVER w END AS c, CASE WHEN count(v) OVER w >= 24 THEN avg(v) OVER w END AS a FROM fleet WINDOW w AS (ORDER BY t ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)) SELECT t, round(first_value(c IGNORE NULLS) OVER f, 9) AS nameplate, round(first_value(a IGNORE NULLS) OVER f, 9) AS capacity FROM x WINDOW f AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def nameplate_max(spark, sf_dir):
    """The most, and the mean, of a week up to each hour; the first day takes the next value."""
    w = over([], -167, 0)
    x = fleet(telemetry(spark, sf_dir)).withColumn("c", supported(F.max("v"), "v", w, 24)).withColumn("a", supported(F.avg("v"), "v", w, 24))
    return x.select("t", F.round(filled("c", back_only=True), 9).alias("nameplate"), F.round(filled("a", back_only=True), 9).alias("capacity"))


TROUGH = "k AS (SELECT quantile_cont(m, 0.05) AS k FROM m), s AS (SELECT t AS lo, t + 3 AS hi FROM m, k WHERE m <= k), f AS (SELECT *, coalesce(lo > max(hi) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS new FROM s), i AS (SELECT *, sum(new::INT) OVER (ORDER BY lo ROWS UNBOUNDED PRECEDING) AS island FROM f)"


@query(f"WITH {FLEET}, m AS ({m_sql('fleet', [4])}), {TROUGH} SELECT min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY island")
def trough_events(spark, sf_dir):
    """Windows at or below the dependable load, merged where they overlap or touch."""
    m = minima(fleet(telemetry(spark, sf_dir)), [4]).withColumn("k", quantile("m", 0.05).over(Window.partitionBy()))
    low = m.where("m <= k").select(F.col("t").alias("lo"), (F.col("t") + 3).alias("hi"))
    return islands(low, "lo", "hi").select("lo", "hi", "n")


@query(f"WITH {FLEET}, m AS ({m_sql('fleet', [4])}), {TROUGH.split(', f AS')[0]}, c AS (SELECT DISTINCT unnest(range(lo, hi + 1)) AS t FROM s) SELECT c.t, round(v, 4) AS v, round(sum(w * u) / sum(CASE WHEN u IS NOT NULL THEN w END), 6) AS mean_u FROM c JOIN fleet USING (t) LEFT JOIN tele ON tele.t = c.t GROUP BY c.t, v")
def binding_hours(spark, sf_dir):
    """The hours that the lowest windows cover, and how busy they are."""
    tele = telemetry(spark, sf_dir)
    f = fleet(tele)
    m = minima(f, [4])
    low = m.withColumn("k", quantile("m", 0.05).over(Window.partitionBy())).where("m <= k")
    hours = low.select(F.explode(F.expr("sequence(t, t + 3)")).alias("t")).distinct()
    busy = tele.groupBy("t").agg((F.sum(F.col("w") * F.col("u")) / F.sum(F.when(F.col("u").isNotNull(), F.col("w")))).alias("mean_u"))
    return hours.join(f, "t").join(busy, "t", "left").select("t", F.round("v", 4).alias("v"), F.round("mean_u", 6).alias("mean_u"))


@query(f"WITH {FLEET}, o AS (SELECT t, coalesce(v > (SELECT avg(v) FROM fleet), false) AS on_ FROM fleet), e AS (SELECT *, CASE WHEN on_ AND NOT coalesce(lag(on_) OVER (ORDER BY t), false) THEN 1 ELSE 0 END AS edge FROM o), i AS (SELECT *, sum(edge) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT min(t) AS t, count(*) AS hours FROM i WHERE on_ GROUP BY run")
def run_lengths(spark, sf_dir):
    """Runs of hours above the mean."""
    f = fleet(telemetry(spark, sf_dir))
    on = f.select("t", F.coalesce(F.col("v") > F.avg("v").over(Window.partitionBy()), F.lit(False)).alias("on_"))
    return events.runs(on, "on_").select("t", "hours")


ORIGINS = "o AS (SELECT unnest(range(lo + 168, lo + n - 72 + 1, 24)) AS o FROM span)"
WINDOWS = f"WITH {FLEET}, {ORIGINS}, m AS ({m_sql('fleet', [4])}), tr AS (SELECT o, quantile_cont(m, 0.05) AS k, count(*) AS n_train FROM m, o WHERE t >= o - 168 AND t + 4 <= o GROUP BY o), te AS (SELECT o, t, m FROM m, o WHERE t >= o AND t + 4 <= o + 72)"


def tested(f: DataFrame) -> DataFrame:
    """Test windows of origins a day apart, from a week after the first hour to three days before the end."""
    at = span(f).select(F.explode(F.when(F.col("n") >= 240, F.expr("sequence(lo + 168, lo + n - 72, 24)"))).alias("o"))
    return backtest.origins(minima(f, [4]), 4, 168, 72, at, 0.05)


@query(f"{WINDOWS} SELECT o AS origin, n_train, round(k, 6) AS k, count(*) AS n_test, round(avg((m >= k)::INT), 6) AS coverage, round(max(greatest(k - m, 0)), 6) AS worst FROM te JOIN tr USING (o) GROUP BY ALL")
def rolling_origin(spark, sf_dir):
    """A week before each origin sets the level, the three days after test it."""
    b = tested(fleet(telemetry(spark, sf_dir)))
    return b.groupBy(F.col("o").alias("origin"), "n_train", F.round("k", 6).alias("k")).agg(F.count("*").alias("n_test"), F.round(F.avg((F.col("m") >= F.col("k")).cast("int")), 6).alias("coverage"), F.round(F.max(F.greatest(F.col("k") - F.col("m"), F.lit(0.0))), 6).alias("worst"))


@query(f"{WINDOWS}, q AS (SELECT m / k AS q FROM te JOIN tr USING (o) WHERE k > 0), r AS (SELECT q, row_number() OVER (ORDER BY q DESC) AS i, count(*) OVER () AS n FROM q) SELECT 0.95::DOUBLE AS alpha, round(greatest(0.3, least(1.5, q)), 6) AS d FROM r WHERE i = CAST(ceil(round(0.95 * n, 6)) AS BIGINT)")
def derating(spark, sf_dir):
    """The largest factor on the level that holds in a share alpha of test windows: an order statistic, no search."""
    b = tested(fleet(telemetry(spark, sf_dir)))
    return r6(backtest.derating(b, 0.95), "d")


@query(f"{WINDOWS}, g AS (SELECT range / 20.0 AS d FROM range(10, 21)) SELECT d::DOUBLE AS d, round(avg((m >= d * k)::INT), 6) AS coverage, round(avg(d * k), 6) AS level FROM te JOIN tr USING (o), g GROUP BY d")
def derating_grid(spark, sf_dir):
    b = tested(fleet(telemetry(spark, sf_dir)))
    grid = spark.range(10, 21).select((F.col("id") / 20.0).alias("d"))
    return b.crossJoin(F.broadcast(grid)).groupBy("d").agg(F.round(F.avg((F.col("m") >= F.col("d") * F.col("k")).cast("int")), 6).alias("coverage"), F.round(F.avg(F.col("d") * F.col("k")), 6).alias("level"))


@query(f"WITH {FLEET}, m AS ({m_sql('fleet', [1, 4])}), k AS ({k_sql('m', shares=[0.95])}), q AS (SELECT range / 4.0 AS q FROM range(1, 5)), r AS (SELECT range / 10.0 AS rho FROM range(0, 6, 2)) SELECT h, q::DOUBLE AS q, rho::DOUBLE AS rho, round(q * k, 6) AS k_q, round(1 - rho * (1 + 2.0 / (2 * h)), 6) AS net, round(rho * q * k * (h + 1.0) / (0.1 * k), 6) AS recovery_h, round(168 / (h + rho * q * k * (h + 1.0) / (0.1 * k)), 6) AS calls FROM k, q, r")
def realizable_sweep(spark, sf_dir):
    """Part q of the level, rebound rho over two hours of notice: net energy, hours to recover, calls a week."""
    k = firm(fleet(telemetry(spark, sf_dir)), [1, 4], [0.95])
    q, r = spark.range(1, 5).select((F.col("id") / 4.0).alias("q")), spark.range(0, 6, 2).select((F.col("id") / 10.0).alias("rho"))
    x = k.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(r)).withColumn("rec", F.col("rho") * F.col("q") * F.col("k") * (F.col("h") + 1.0) / (0.1 * F.col("k")))
    return x.select("h", "q", "rho", F.round(F.col("q") * F.col("k"), 6).alias("k_q"), F.round(1 - F.col("rho") * (1 + 2.0 / (2 * F.col("h"))), 6).alias("net"), F.round("rec", 6).alias("recovery_h"), F.round(168 / (F.col("h") + F.col("rec")), 6).alias("calls"))


GRID = "g AS (SELECT a / 4.0 AS a_t, b / 4.0 AS a_o, c / 4.0 AS a_l FROM range(0, 5) x(a), range(0, 5) y(b), range(0, 5) z(c))"
JOBS = FLEET + ", jobs AS (SELECT s.t, sum(w * (priority_class = 'LP')::INT) AS lp, sum(w * (priority_class <> 'LP' AND job_type = 'training')::INT) AS tr, sum(w * (priority_class <> 'LP' AND job_type = 'offline_inference')::INT) AS off, sum(w) AS v FROM spine s LEFT JOIN tele USING (t) GROUP BY s.t)"


def jobs(tele: DataFrame) -> DataFrame:
    lp = F.col("priority_class") == "LP"
    part = lambda test: F.sum(F.col("w") * test.cast("int"))
    sums = tele.groupBy("t").agg(part(lp).alias("lp"), part(~lp & (F.col("job_type") == "training")).alias("tr"), part(~lp & (F.col("job_type") == "offline_inference")).alias("off"), F.sum("w").alias("v"))
    return dense(sums)


@query(f"WITH {JOBS}, {GRID}, s AS (SELECT a_t, a_o, a_l, t, a_l * lp + a_t * tr + a_o * off AS v FROM jobs, g), m AS ({m_sql('s', [1, 4, 24], 'a_t, a_o, a_l')}), r AS (SELECT *, row_number() OVER (PARTITION BY a_t, a_o, a_l, h ORDER BY m) AS i, count(*) OVER (PARTITION BY a_t, a_o, a_l, h) AS n FROM m), a AS (SELECT unnest([0.8, 0.9, 0.95]) AS alpha) SELECT a_t::DOUBLE AS a_t, a_o::DOUBLE AS a_o, a_l::DOUBLE AS a_l, h, alpha::DOUBLE AS alpha, round(m, 6) AS cap FROM r, a WHERE i = n - CAST(ceil(round(alpha * n, 6)) AS BIGINT) + 1")
def scope_grid(spark, sf_dir):
    """Dependable load if only parts of three kinds of work take part, by duration and share of windows."""
    axes = ["a_t", "a_o", "a_l"]
    g = spark.range(125).select(*[((F.floor(F.col("id") / 5**i) % 5) / 4.0).alias(a) for i, a in enumerate(axes)])
    s = jobs(telemetry(spark, sf_dir)).crossJoin(g).withColumn("v", F.col("a_l") * F.col("lp") + F.col("a_t") * F.col("tr") + F.col("a_o") * F.col("off"))
    return events.order_cap(minima(s, [1, 4, 24], axes), [*axes, "h"], [0.8, 0.9, 0.95])


@query(f"WITH {JOBS}, f AS (SELECT unnest([0.1, 0.25, 0.4]) AS share), s AS (SELECT share, t, lp + tr - share * v AS v FROM jobs, f), m AS ({m_sql('s', [1, 4], 'share')}) SELECT share::DOUBLE AS share, h, count(*) AS n, round(avg((m >= 0)::INT), 6) AS coverage FROM m GROUP BY ALL")
def facility_targets(spark, sf_dir):
    """How often a share of the whole can be covered for a whole window."""
    f = spark.createDataFrame([(0.1,), (0.25,), (0.4,)], "share double")
    s = jobs(telemetry(spark, sf_dir)).crossJoin(F.broadcast(f)).withColumn("v", F.col("lp") + F.col("tr") - F.col("share") * F.col("v"))
    return minima(s, [1, 4], ["share"]).groupBy("share", "h").agg(F.count("*").alias("n"), F.round(F.avg((F.col("m") >= 0).cast("int")), 6).alias("coverage"))


@query(f"WITH {FLEET}, m AS ({m_sql('fleet', [1, 4])}), k AS ({k_sql('m', shares=[0.95])}), e AS (SELECT unnest([0, 0.05, 0.1, 0.25]) AS loss), r AS (SELECT unnest([0.5, 1.0, 2.0, 5.0]) AS rate) SELECT h, loss::DOUBLE AS loss, rate::DOUBLE AS rate, round(k * h * (1 + loss) / (rate * k), 6) AS recovery_h FROM k, e, r")
def recovery_grid(spark, sf_dir):
    e, r = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.1, 0.25)], "loss double"), spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 5.0)], "rate double")
    k = firm(fleet(telemetry(spark, sf_dir)), [1, 4], [0.95]).crossJoin(F.broadcast(e)).crossJoin(F.broadcast(r))
    return k.select("h", "loss", "rate", F.round(F.col("k") * F.col("h") * (1 + F.col("loss")) / (F.col("rate") * F.col("k")), 6).alias("recovery_h"))


@query(f"WITH {LANES}, p AS (SELECT cluster_id, quantile_cont(v, 0.1) AS p10 FROM lanes WHERE v > 0 GROUP BY 1), d AS (SELECT cluster_id, t // 24 AS day, min(coalesce(v, 0)) AS least FROM lanes GROUP BY ALL), x AS (SELECT day, sum((least < p10)::INT) AS low FROM d JOIN p USING (cluster_id) GROUP BY day) SELECT low::BIGINT AS low, count(*) AS days FROM x GROUP BY low")
def low_day_counts(spark, sf_dir):
    """On how many days how many clusters fall below their own tenth percentile of active hours."""
    rows = lanes(telemetry(spark, sf_dir))
    p = rows.where("v > 0").groupBy("cluster_id").agg(quantile("v", 0.1).alias("p10"))
    d = rows.groupBy("cluster_id", F.expr("t div 24").alias("day")).agg(F.min(F.coalesce("v", F.lit(0.0))).alias("least"))
    x = d.join(p, "cluster_id").groupBy("day").agg(F.sum((F.col("least") < F.col("p10")).cast("int")).alias("low"))
    return x.groupBy("low").agg(F.count("*").alias("days"))


@query(f"WITH {FLEET} SELECT t, round(v, 4) AS v, round((row_number() OVER (ORDER BY v DESC, t) - 1) / (count(*) OVER () - 1.0), 8) AS share FROM fleet WHERE v IS NOT NULL")
def duration_curve(spark, sf_dir):
    f = fleet(telemetry(spark, sf_dir)).where("v is not null")
    rank = F.row_number().over(Window.orderBy(F.desc("v"), "t")) - 1
    return f.select("t", F.round("v", 4).alias("v"), F.round(rank / (F.count("*").over(Window.partitionBy()) - 1.0), 8).alias("share"))


@query(f"WITH {FLEET} SELECT p::DOUBLE AS p, round(q, 6) AS q FROM (SELECT unnest(range(0, 21)) / 20.0 AS p, unnest(quantile_cont(v, [{', '.join(str(i / 20) for i in range(21))}])) AS q FROM fleet)")
def ecdf_quantiles(spark, sf_dir):
    p = [i / 20 for i in range(21)]
    q = fleet(telemetry(spark, sf_dir)).agg(F.percentile("v", F.array(*[F.lit(x) for x in p])).alias("q"))
    return q.select(F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in p]).alias("p"), "q")).alias("x")).select("x.p", F.round("x.q", 6).alias("q"))


@query(f"WITH {LANES} SELECT cluster_id, least(floor(v / 20), 24)::BIGINT AS bin, count(*) AS n FROM lanes WHERE v >= 0 GROUP BY ALL")
def histogram_share(spark, sf_dir):
    return lanes(telemetry(spark, sf_dir)).where("v >= 0").groupBy("cluster_id", F.least(F.floor(F.col("v") / 20), F.lit(24)).alias("bin")).agg(F.count("*").alias("n"))
