"""The power model, resampled benchmarks, decompositions and the capacity screen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import power
from gridloom.operators import events, resample, rollups, screen
from gridloom.operators.rolling import dense, firm, fleet, lanes, minima, span, trend
from gridloom.plans.firm_queries import TWO, m_sql, two
from gridloom.plans.registry import query
from gridloom.plans.rollup_queries import STATS_SQL
from gridloom.plans.series_queries import TREND_168
from gridloom.operators.resample import drawn_sql, uniform, uniform_sql
from gridloom.sources.tables import LANES, SPINE, TELE, table, telemetry

KEYS = ["t", "cluster_id", "spec", "job_type", "priority_class", "state"]
STATS = f"{TELE}, st AS (SELECT {', '.join(KEYS)}, {STATS_SQL.replace('round(', '(').replace(', 4)', ')')} FROM tele GROUP BY ALL)"


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.sufficient(telemetry(spark, sf_dir), KEYS)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    idle, active = power.energy()
    return statistics(spark, sf_dir).withColumns({"idle": idle, "active": active, "layer": power.layer()})


ROWS = f"{STATS}, pw AS (SELECT *, {power.TDP_SQL} * 0.2 * gpu_hours AS idle, {power.active_sql()} AS active, {power.LAYER_SQL} AS layer FROM st)"


@query(f"WITH {ROWS} SELECT layer, job_type, round(sum(idle), 6) AS idle, round(sum(active), 6) AS active, round(sum(CASE WHEN layer = 'curtail' THEN active END), 6) AS curtail_idle_retained, round(sum(CASE WHEN layer = 'curtail' THEN idle + active END), 6) AS curtail_attributed FROM pw GROUP BY ALL")
def power_row_layers(spark, sf_dir):
    """Energy by layer of flexibility, and what curtailing frees under two boundaries."""
    cut = lambda b: F.round(F.sum(F.when(F.col("layer") == "curtail", power.curtailed(b))), 6).alias(f"curtail_{b}")
    return rows(spark, sf_dir).groupBy("layer", "job_type").agg(F.round(F.sum("idle"), 6).alias("idle"), F.round(F.sum("active"), 6).alias("active"), cut("idle_retained"), cut("attributed"))


@query(f"WITH {ROWS}, {SPINE}, g AS (SELECT t, sum(idle) AS idle, sum(active) AS active, sum(s0) * (4.0 - 1.5) AS host FROM pw GROUP BY t) SELECT s.t, idle IS NOT NULL AS have, round(idle, 6) AS idle, round(active, 6) AS active, round(host, 6) AS host, round(1.2 * (idle + active + host), 6) AS facility FROM spine s LEFT JOIN g USING (t)")
def power_components(spark, sf_dir):
    """Facility power by hour: devices, hosts above idle, times the facility's overhead."""
    g = rows(spark, sf_dir).groupBy("t").agg(F.sum("idle").alias("idle"), F.sum("active").alias("active"), (F.sum("s0") * (power.HOST_PEAK - power.HOST_IDLE)).alias("host"))
    out = dense(g)
    r = lambda c: F.round(c, 6)
    return out.select("t", F.col("idle").isNotNull().alias("have"), r("idle").alias("idle"), r("active").alias("active"), r("host").alias("host"), r(power.PUE * (F.col("idle") + F.col("active") + F.col("host"))).alias("facility"))


@query(f"WITH {ROWS}, h AS (SELECT t, sum(idle + active) AS p FROM pw GROUP BY t), d AS (SELECT t % 24 AS hour, avg(p) AS a FROM h GROUP BY 1), y AS (SELECT t // 24 AS day, max(p) - min(p) AS amp FROM h GROUP BY 1) SELECT round(avg(p), 6) AS mean, round(avg(p) / max(p), 6) AS load_factor, round(100 * (avg(p) FILTER (t >= lo + n - 168) / avg(p) FILTER (t < lo + 168) - 1), 4) AS growth_pct, (SELECT arg_max(hour, a) FROM d) AS peak_hour, (SELECT arg_min(hour, a) FROM d) AS trough_hour, round((SELECT avg(amp) FROM y), 6) AS amplitude FROM h, (SELECT min(t) AS lo, max(t) - min(t) + 1 AS n FROM h)")
def load_profile_summary(spark, sf_dir):
    h = rows(spark, sf_dir).groupBy("t").agg(F.sum(F.col("idle") + F.col("active")).alias("p"))
    d = h.groupBy(F.expr("t % 24").alias("hour")).agg(F.avg("p").alias("a")).agg(F.max_by("hour", "a").alias("peak_hour"), F.min_by("hour", "a").alias("trough_hour"))
    y = h.groupBy(F.expr("t div 24").alias("day")).agg((F.max("p") - F.min("p")).alias("amp")).agg(F.round(F.avg("amp"), 6).alias("amplitude"))
    part = lambda c: F.avg(F.when(F.expr(c), F.col("p")))
    s = h.crossJoin(span(h)).agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.avg("p") / F.max("p"), 6).alias("load_factor"), F.round(100 * (part("t >= lo + n - 168") / part("t < lo + 168") - 1), 4).alias("growth_pct"))
    return s.crossJoin(d).crossJoin(y)


#: Parameter draws, the seed, and what is drawn from which range, in this order.
MC_DRAWS, MC_SEED = 300, 0
RANGES = {"phi": (0.15, 0.25), "null_level": (0.1, 0.5), "pue": (1.1, 1.4)}
DRAWS_SQL = "dr AS (SELECT draw, " + ", ".join(f"{a} + {b - a} * {uniform_sql('draw', str(i), MC_SEED)} AS {name}" for i, (name, (a, b)) in enumerate(RANGES.items())) + f" FROM (SELECT range AS draw FROM range({MC_DRAWS})))"
#: What a draw needs of an hour: energy is linear in these sums.
HOUR_SUMS = {
    "base": "tdp * gpu_hours", "level": "CASE WHEN state <> 'Standby' AND job_type <> 'online_inference' THEN tdp * level END", "nul": "CASE WHEN state <> 'Standby' AND job_type <> 'online_inference' THEN tdp * gpu_hours_null_util END",
    "on_hours": "CASE WHEN state <> 'Standby' AND job_type = 'online_inference' THEN tdp * gpu_hours END", "on_level": "CASE WHEN state <> 'Standby' AND job_type = 'online_inference' THEN tdp * level END", "on_nul": "CASE WHEN state <> 'Standby' AND job_type = 'online_inference' THEN tdp * gpu_hours_null_util END",
}


def hour_sums(st: DataFrame) -> DataFrame:
    return st.withColumns({"tdp": power.tdp(), "level": power.utilised()}).groupBy("t").agg(*[F.coalesce(F.sum(F.expr(e)), F.lit(0.0)).alias(n) for n, e in HOUR_SUMS.items()])


@query(f"WITH {STATS}, {DRAWS_SQL}, g AS (SELECT t, spec, job_type, state, sum(gpu_hours) AS gpu_hours, sum(gpu_hours_null_util) AS gpu_hours_null_util, sum(s0) AS s0, sum(s25) AS s25, sum(s50) AS s50, sum(s75) AS s75 FROM st GROUP BY ALL), p AS (SELECT draw, t, sum(pue * ({power.TDP_SQL} * phi * gpu_hours + {power.active_sql('phi', 'null_level')})) AS p FROM g, dr GROUP BY ALL) SELECT t, round(quantile_cont(p, 0.05), 6) AS p5, round(quantile_cont(p, 0.5), 6) AS p50, round(quantile_cont(p, 0.95), 6) AS p95 FROM p GROUP BY t")
def mc_bands(spark, sf_dir):
    """Bands over drawn parameters. Energy is linear in six sums of an hour, so that draws multiply hours, not rows."""
    d = spark.range(MC_DRAWS).select(F.col("id").alias("draw"), *[(a + (b - a) * uniform("id", str(i), MC_SEED)).alias(n) for i, (n, (a, b)) in enumerate(RANGES.items())])
    c0 = F.greatest(F.lit(0.0), (F.lit(power.ONLINE_FLOOR) - F.col("phi")) / (1 - F.col("phi")))
    online = c0 * F.col("on_hours") + (1 - c0 / F.lit(power.CURVES["online_inference"][-1])) * (F.col("on_level") + F.col("null_level") * F.col("on_nul"))
    active = (1 - F.col("phi")) * (F.col("level") + F.col("null_level") * F.col("nul") + online)
    p = hour_sums(statistics(spark, sf_dir)).crossJoin(d).withColumn("p", F.col("pue") * (F.col("phi") * F.col("base") + active))
    q = p.groupBy("t").agg(F.percentile("p", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select("t", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))])


#: Draws of a benchmark, and the seed of its shifts.
N_NULL, SHIFT_SEED = 20, 1


def shifts_sql(draws: int = N_NULL, step: int = 1, seed: int = SHIFT_SEED) -> str:
    return f"nm AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS u FROM (SELECT DISTINCT cluster_id FROM lanes)), sh AS (SELECT draw, u, {step} * ({drawn_sql('draw', 'u', seed)} % greatest(n // {step}, 1)) AS shift FROM nm, span, (SELECT range AS draw FROM range({draws})))"


SHIFTS_SQL = shifts_sql()
TREND_SQL = TREND_168
ROLL_SQL = """rl AS (SELECT draw, cluster_id, lo + (t - lo + shift) % n AS t, v - trend AS r FROM tl JOIN nm USING (cluster_id) JOIN sh USING (u), span), de AS (SELECT draw, t, CASE WHEN count(r + trend) = count(*) THEN greatest(sum(r + trend), 0) END AS v FROM rl JOIN (SELECT cluster_id, t, trend FROM tl) USING (cluster_id, t) GROUP BY ALL)"""
# in the model queries a cluster's missing hour counts as no load
ZERO = LANES.replace("sum(w) AS v FROM spine s CROSS", "coalesce(sum(w), 0) AS v FROM spine s CROSS")
ZERO_LP = ZERO.replace("coalesce(sum(w), 0) AS v", "coalesce(sum(CASE WHEN priority_class = 'LP' THEN w END), 0) AS v")


def zero(series: DataFrame) -> DataFrame:
    return series.withColumn("v", F.coalesce("v", F.lit(0.0)))


@query(f"WITH {ZERO}, {SHIFTS_SQL}, {TREND_SQL}, {ROLL_SQL}, m AS ({m_sql('de', [1, 4], 'draw')}), k AS (SELECT draw, h, quantile_cont(m, 0.05) AS k, count(*) AS n FROM m GROUP BY ALL) SELECT h, round(avg(k), 4) AS k_independent, sum(n)::BIGINT AS n FROM k GROUP BY h")
def circular_shift_null(spark, sf_dir):
    """The dependable load if clusters kept their own patterns but not their coincidence."""
    s = trend(zero(lanes(telemetry(spark, sf_dir))), 84, 83, 24, ["cluster_id"])
    k = minima(resample.decorrelated(s, "cluster_id", N_NULL, SHIFT_SEED), [1, 4], ["draw"]).groupBy("draw", "h").agg(F.percentile("m", F.lit(0.05)).alias("k"), F.count("*").alias("n"))
    return k.groupBy("h").agg(F.round(F.avg("k"), 4).alias("k_independent"), F.sum("n").alias("n"))


#: Replicates of the block bootstrap, its block of hours, its seed.
REPS, BLOCK, BLOCK_SEED = 200, 168, 2


def blocks_sql(reps: int = REPS, block: int = BLOCK, seed: int = BLOCK_SEED, hours: str = "span") -> str:
    return f"bl AS (SELECT rep, j, {drawn_sql('rep', 'j', seed)} % (n - {block} + 1) AS source, lo, n FROM (SELECT range AS rep FROM range({reps})), (SELECT lo, n, unnest(range((n + {block} - 1) // {block})) AS j FROM {hours}) WHERE n >= {block}), ix AS (SELECT rep, j * {block} + i AS pos, lo + source + i AS src FROM bl, (SELECT range AS i FROM range({block})) WHERE j * {block} + i < n)"


BLOCKS_SQL = blocks_sql()


@query(f"WITH {TWO}, {BLOCKS_SQL}, b AS (SELECT rep, pos AS t, CASE WHEN (pos + 1) % 168 <> 0 THEN v END AS v FROM ix JOIN two ON two.t = src), m AS ({m_sql('b', [1, 4], 'rep')}), k AS (SELECT rep, h, quantile_cont(m, 0.05) AS k FROM m GROUP BY ALL) SELECT h, round(quantile_cont(k, 0.05), 4) AS p5, round(quantile_cont(k, 0.5), 4) AS p50, round(quantile_cont(k, 0.95), 4) AS p95 FROM k GROUP BY h")
def block_bootstrap_k(spark, sf_dir):
    """Moving blocks of a week; the last hour of a block is a gap, so that no window reaches over a splice."""
    f = fleet(telemetry(spark, sf_dir))
    b = f.join(resample.block_index(span(f), REPS, BLOCK, BLOCK_SEED), F.col("t") == F.col("src")).select("rep", F.col("pos").alias("t"), F.when((F.col("pos") + 1) % 168 != 0, F.col("v")).alias("v"))
    k = minima(b, [1, 4], ["rep"]).groupBy("rep", "h").agg(F.percentile("m", F.lit(0.05)).alias("k"))
    q = k.groupBy("h").agg(F.percentile("k", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select("h", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p5", "p50", "p95"))])


@query(f"WITH {TWO}, {BLOCKS_SQL} SELECT rep, count(v) AS n, round(covar_pop(v, c), 4) AS cov, round(covar_pop(v, c) / (stddev_pop(v) * stddev_pop(c)), 6) AS rho FROM ix JOIN two ON two.t = src GROUP BY rep")
def block_moment_boot(spark, sf_dir):
    """Covariances of resampled hours from sums of moments alone."""
    f = two(telemetry(spark, sf_dir))
    x = f.where("v is not null")
    z = x.select("t", F.lit(1.0).alias("n"), F.col("v").alias("x"), F.col("c").alias("y"), (F.col("v") * F.col("c")).alias("xy"), (F.col("v") * F.col("v")).alias("xx"), (F.col("c") * F.col("c")).alias("yy"))
    s = z.join(resample.block_index(span(f), REPS, BLOCK, BLOCK_SEED), F.col("t") == F.col("src")).groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xy", "xx", "yy")])
    cov = lambda a, b, ab: F.col(ab) / F.col("n") - F.col(a) / F.col("n") * F.col(b) / F.col("n")
    rho = cov("x", "y", "xy") / F.sqrt(cov("x", "x", "xx") * cov("y", "y", "yy"))
    return s.select("rep", F.col("n").cast("long").alias("n"), F.round(cov("x", "y", "xy"), 4).alias("cov"), F.round(rho, 6).alias("rho"))


CHAIN = f"""WITH {ZERO_LP}, fl AS (SELECT t, sum(w) AS l FROM tele GROUP BY t), a AS (SELECT t, sum(v) AS v FROM lanes GROUP BY t), {SHIFTS_SQL}, {TREND_SQL}, {ROLL_SQL},
mi AS ({m_sql('de', [4], 'draw')}), ki AS (SELECT avg(k) AS p2 FROM (SELECT draw, quantile_cont(m, 0.05) AS k FROM mi GROUP BY draw)), ma AS ({m_sql('a', [4])}), ka AS (SELECT quantile_cont(m, 0.05) AS p3 FROM ma),
c AS (SELECT 0.5 * (SELECT avg(l) FROM fl) AS p0, (SELECT avg(v) FROM a) AS p1, p2, p3 FROM ki, ka)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p0, p1, p2, p3): a share of the mean load, the mean of the eligible part, its dependable level if clusters were
    independent, and as it is."""
    tele = telemetry(spark, sf_dir)
    part = zero(lanes(tele, F.when(F.col("priority_class") == "LP", F.col("w"))))
    a = part.groupBy("t").agg(F.sum("v").alias("v"))
    p0 = tele.groupBy("t").agg(F.sum("w").alias("l")).agg((0.5 * F.avg("l")).alias("p0"))
    p2 = resample.benchmark(trend(part, 84, 83, 24, ["cluster_id"]), "cluster_id", N_NULL, SHIFT_SEED, 4, 0.05).withColumnRenamed("k", "p2")
    p3 = firm(a, [4], [0.95]).select(F.col("k").alias("p3"))
    return p0.crossJoin(a.agg(F.avg("v").alias("p1"))).crossJoin(p2).crossJoin(p3)


@query(f"{CHAIN} SELECT round(p0, 4) AS p0, round(p1, 4) AS p1, round(p2, 4) AS p2, round(p3, 4) AS p3, round(p1 / nullif(p0, 0), 6) AS a_scope, round(p2 / nullif(p1, 0), 6) AS a_persist, round(p3 / nullif(p2, 0), 6) AS a_coinc FROM c")
def chain_factors(spark, sf_dir):
    r = lambda a, b, n: F.round(F.try_divide(a, b), 6).alias(n)
    return chain(spark, sf_dir).select(*[F.round(c, 4).alias(c) for c in ("p0", "p1", "p2", "p3")], r("p1", "p0", "a_scope"), r("p2", "p1", "a_persist"), r("p3", "p2", "a_coinc"))


@query(f"{CHAIN} SELECT round(ln(nullif(p1 / nullif(p0, 0), 0)), 6) AS scope, round((ln(nullif(p2 / nullif(p1, 0), 0)) + ln(nullif(p3 / nullif(p1, 0), 0))) / 2, 6) AS duration, round(ln(nullif(p3 / nullif(p2, 0), 0)) / 2, 6) AS coincidence FROM c")
def shapley(spark, sf_dir):
    """Each factor's mean log contribution over the six orders, in closed form: coincidence alone does nothing."""
    ln = lambda a, b: F.log(F.nullif(F.try_divide(a, b), F.lit(0.0)))
    return chain(spark, sf_dir).select(F.round(ln("p1", "p0"), 6).alias("scope"), F.round((ln("p2", "p1") + ln("p3", "p1")) / 2, 6).alias("duration"), F.round(ln("p3", "p2") / 2, 6).alias("coincidence"))


SCREEN = f"""WITH {TWO}, pr AS (SELECT t, coalesce(v, 0) / (SELECT max(v) FROM two) AS s, coalesce(c, 0) / (SELECT max(v) FROM two) AS c FROM two), de AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, d FROM (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / 1000 AS d FROM orders GROUP BY 1)),
x AS (SELECT i, d, s, c FROM de, span JOIN pr ON pr.t = lo + i % n), g AS (SELECT margin, x.*, (SELECT max(d) FROM x) * (1 + margin) - d AS room FROM x, (SELECT unnest([0.02, 0.05, 0.1])::DOUBLE AS margin)),
q AS (SELECT margin, room / s AS q, row_number() OVER (PARTITION BY margin ORDER BY room / s) AS i FROM g WHERE s > 0), b AS (SELECT margin, min(CASE WHEN s > c THEN room / (s - c) END) AS hard, min(CASE WHEN s > 0 THEN room / s END) AS rigid, count(*) AS n FROM g GROUP BY margin),
hd AS (SELECT margin, budget, CASE WHEN least(hard, q, 20000) >= 1 THEN least(hard, q, 20000) ELSE 0 END AS load, rigid FROM b CROSS JOIN (SELECT unnest([0.0025, 0.005, 0.01, 0.02])::DOUBLE AS budget) LEFT JOIN q USING (margin) WHERE q.i = CAST(floor(round(budget * n, 6)) AS BIGINT) + 1)"""


def screened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = two(telemetry(spark, sf_dir))
    top = x.agg(F.max("v").alias("top"))
    zero = F.lit(0.0)
    profile = x.crossJoin(top).select("t", (F.coalesce("v", zero) / F.col("top")).alias("s"), (F.coalesce("c", zero) / F.col("top")).alias("c"))
    day = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((F.sum("o_totalprice") / 1000).alias("d"))
    from pyspark.sql.window import Window

    demand = day.select((F.row_number().over(Window.orderBy("day")) - 1).cast("long").alias("i"), "d")
    hours = demand.crossJoin(span(x)).withColumn("t", F.expr("lo + i % n")).join(profile, "t").select("i", "d", "s", "c")
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} double")
    return hours, screen.headroom(hours, frame([0.02, 0.05, 0.1], "margin"), frame([0.0025, 0.005, 0.01, 0.02], "budget"))


@query(f"{SCREEN} SELECT margin, budget, round(load, 4) AS load FROM hd")
def headroom(spark, sf_dir):
    return screened(spark, sf_dir)[1].select("margin", "budget", F.round("load", 4).alias("load"))


@query(f"{SCREEN} SELECT DISTINCT margin, round(rigid, 4) AS rigid FROM hd")
def headroom_noflex(spark, sf_dir):
    return screened(spark, sf_dir)[1].select("margin", F.round("rigid", 4).alias("rigid")).distinct()


@query(f"{SCREEN}, ov AS (SELECT margin, budget, i AS t, d + load * s > (SELECT max(d) FROM x) * (1 + margin) * (1 + 1e-9) AS on_ FROM x, hd), e AS (SELECT *, CASE WHEN on_ AND NOT coalesce(lag(on_) OVER (PARTITION BY margin, budget ORDER BY t), false) THEN 1 ELSE 0 END AS edge FROM ov), r AS (SELECT *, sum(edge) OVER (PARTITION BY margin, budget ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM e), z AS (SELECT margin, budget, run, count(*) AS hours FROM r WHERE on_ GROUP BY ALL) SELECT margin, budget, count(*) AS events, sum(hours)::BIGINT AS hours, max(hours) AS longest FROM z GROUP BY ALL")
def headroom_events(spark, sf_dir):
    """Runs of periods in which the new load would have to yield."""
    hours, room = screened(spark, sf_dir)
    peak = F.broadcast(hours.agg(F.max("d").alias("peak")))
    on = hours.crossJoin(peak).crossJoin(F.broadcast(room)).select("margin", "budget", F.col("i").alias("t"), (F.col("d") + F.col("load") * F.col("s") > F.col("peak") * (1 + F.col("margin")) * (1 + 1e-9)).alias("on_"))
    z = events.runs(on, "on_", ["margin", "budget"])
    return z.groupBy("margin", "budget").agg(F.count("*").alias("events"), F.sum("hours").alias("hours"), F.max("hours").alias("longest"))


@query(f"WITH {LANES}, x AS (SELECT cluster_id, avg(v) AS a, stddev_samp(v) AS s, count(v) AS n FROM lanes GROUP BY 1) SELECT cluster_id, round(a, 4) AS mean_v, round(s, 4) AS sd, n, round(s / a, 6) AS cv FROM x")
def unit_stats(spark, sf_dir):
    x = lanes(telemetry(spark, sf_dir)).groupBy("cluster_id").agg(F.avg("v").alias("a"), F.stddev_samp("v").alias("s"), F.count("v").alias("n"))
    return x.select("cluster_id", F.round("a", 4).alias("mean_v"), F.round("s", 4).alias("sd"), "n", F.round(F.col("s") / F.col("a"), 6).alias("cv"))


