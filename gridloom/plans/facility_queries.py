"""Facility power from pods, idle devices and hosts; parameter draws; eligibility; corrections by utilisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import power
from gridloom.operators import asof, facility, lookups
from gridloom.operators.resample import uniform, uniform_sql
from gridloom.operators.rolling import dense, firm, spine
from gridloom.plans.firm_queries import m_sql
from gridloom.plans.model_queries import ROWS, STATS, rows, statistics
from gridloom.plans.registry import query
from gridloom.sources.tables import SPINE, TELE, telemetry

r6 = facility.rounded


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows with the cores that a pod asks for, and how busy they are."""
    return telemetry(spark, sf_dir).withColumns({"cores": 1.0 + F.col("pod_id") % 8, "busy": F.col("k") / 100.0})


USAGE = f"{TELE}, us AS (SELECT *, 1.0::DOUBLE + pod_id % 8 AS cores, k / 100.0::DOUBLE AS busy FROM tele)"


@query(f"WITH {USAGE} SELECT t, cluster_id, round(sum(cores), 6) AS cpu_req_cores, round(coalesce(sum(cores * busy), 0), 6) AS cpu_used_cores FROM us GROUP BY ALL")
def host_stats(spark, sf_dir):
    """Cores asked for, and cores kept busy: sums that merge like the devices' statistics."""
    return r6(facility.cores(usage(spark, sf_dir), ["t", "cluster_id"]), "cpu_req_cores", "cpu_used_cores")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, cluster_id, spec, gpu_count, cores): what is installed, by hour."""
    tele = telemetry(spark, sf_dir)
    seen = tele.groupBy("cluster_id", "spec").agg(F.min("t").alias("t"), F.max("t").alias("last"))
    hours = spine(seen.select("t").unionByName(seen.select(F.col("last").alias("t"))))
    kinds = seen.where("spec is not null").select("cluster_id", "spec", (40.0 + 10 * F.length("cluster_id")).alias("gpu_count"))
    return hours.crossJoin(kinds).withColumn("cores", 2 * F.col("gpu_count"))


INV = "inv AS (SELECT t, cluster_id, spec, 40.0::DOUBLE + 10 * length(cluster_id) AS gpu_count, 2 * (40.0::DOUBLE + 10 * length(cluster_id)) AS cores FROM spine, (SELECT DISTINCT cluster_id, spec FROM tele WHERE spec IS NOT NULL))"
FAC = f"""{ROWS}, {SPINE}, {INV}, occ AS (SELECT t, cluster_id, spec, sum(gpu_hours) AS gh FROM st WHERE spec IS NOT NULL GROUP BY ALL),
fl AS (SELECT t, sum(greatest(gpu_count - coalesce(gh, 0), 0) * {power.TDP_SQL} * {power.IDLE}) AS idle_floor, sum(cores) * {power.HOST_IDLE} AS host_idle FROM inv LEFT JOIN occ USING (t, cluster_id, spec) GROUP BY t),
ho AS (SELECT t, sum((1.0::DOUBLE + pod_id % 8) * k / 100.0::DOUBLE) FILTER (state <> 'Standby') * {power.HOST_PEAK - power.HOST_IDLE} AS host_busy FROM tele GROUP BY t),
po AS (SELECT t, sum(gpu_hours) AS gh, sum(idle + active) AS pods, coalesce(sum({power.TDP_SQL} * {1 - power.IDLE} * {power.online_offset()} * gpu_hours) FILTER (job_type = 'online_inference' AND state <> 'Standby'), 0) AS online_part FROM pw GROUP BY t),
fa AS (SELECT s.t, coalesce(gh > 0, false) AND fl.t IS NOT NULL AS good, coalesce(pods, 0) AS pods, coalesce(idle_floor, 0) AS idle_floor, coalesce(host_idle, 0) + coalesce(host_busy, 0) AS host, coalesce(online_part, 0) AS online_part FROM spine s LEFT JOIN po USING (t) LEFT JOIN fl USING (t) LEFT JOIN ho USING (t))"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, good, pods, idle_floor, host, online_part): an hour is good if it is in the inventory and pods ran in it."""
    return facility.hourly(rows(spark, sf_dir), usage(spark, sf_dir), inventory(spark, sf_dir))


@query(f"WITH {FAC} SELECT t, good, round(pods, 6) AS pods, round(idle_floor, 6) AS idle_floor, round(host, 6) AS host, round(online_part, 6) AS online_part, round(pods + idle_floor + host, 6) AS it, round({power.PUE} * (pods + idle_floor + host), 6) AS facility FROM fa")
def facility_power(spark, sf_dir):
    """Pods, devices that nobody took, hosts; times the facility's overhead."""
    it = F.col("pods") + F.col("idle_floor") + F.col("host")
    out = hourly(spark, sf_dir).withColumn("it", it).withColumn("facility", power.PUE * it)
    return r6(out, "pods", "idle_floor", "host", "online_part", "it", "facility")


@query(f"WITH {FAC} SELECT count(*) AS hours, round(100 * sum(pods) / sum(pods + idle_floor + host), 6) AS pods_pct, round(100 * sum(idle_floor) / sum(pods + idle_floor + host), 6) AS idle_floor_pct, round(100 * sum(host) / sum(pods + idle_floor + host), 6) AS host_pct, round(100 * sum(online_part) / sum(pods + idle_floor + host), 6) AS online_pct FROM fa WHERE good")
def component_shares(spark, sf_dir):
    """What each component has of the good hours' energy."""
    total = F.sum(F.col("pods") + F.col("idle_floor") + F.col("host"))
    share = lambda c, n: F.round(100 * F.sum(c) / total, 6).alias(n)
    return hourly(spark, sf_dir).where("good").agg(F.count("*").alias("hours"), share("pods", "pods_pct"), share("idle_floor", "idle_floor_pct"), share("host", "host_pct"), share("online_part", "online_pct"))


ELIG_SQL = " UNION ALL ".join(f"SELECT '{e}' AS eligibility, *, {power.layer_sql(e)} AS part FROM pw" for e in power.ELIGIBILITY)


@query(f"WITH {ROWS}, el AS ({ELIG_SQL}) SELECT eligibility, part, round(sum(idle), 6) AS idle, round(sum(active), 6) AS active, round(sum(CASE WHEN part = 'curtail' THEN idle + active END), 6) AS attributed, round(sum(CASE WHEN part = 'curtail' THEN active END), 6) AS idle_retained, round(sum(CASE WHEN part = 'curtail' THEN idle + active END), 6) AS node_sleep FROM el GROUP BY ALL")
def eligibility_grid(spark, sf_dir):
    """Three readings of who may be curtailed, by three boundaries of what that frees; one pass over the rows."""
    el = rows(spark, sf_dir).select("idle", "active", F.explode(F.array(*[F.struct(F.lit(e).alias("eligibility"), power.layer(e).alias("part")) for e in power.ELIGIBILITY])).alias("x")).select("idle", "active", "x.*")
    cut = [F.round(F.sum(F.when(F.col("part") == "curtail", power.curtailed(b))), 6).alias(b) for b in power.BOUNDARIES]
    return el.groupBy("eligibility", "part").agg(F.round(F.sum("idle"), 6).alias("idle"), F.round(F.sum("active"), 6).alias("active"), *cut)


#: Number of drawn parameter sets; the first of them, 0, has the base values.
N_DRAWS, DRAW_SEED = 300, 17
TDP_ROWS = [(s, *power.TDP_RANGES.get(s, (v * (1 - power.TDP_SPREAD), v * (1 + power.TDP_SPREAD))), v) for s, v in sorted(power.TDP.items())] + [(f"XPU-{c}", *power.XPU_RANGE, power.TDP_XPU) for c in "ABCDE"]
PARAMS = [(n, *r, b) for n, (r, b) in power.PARAMETERS.items()] + [(f"tdp:{s}", a, b, v) for s, a, b, v in TDP_ROWS]
PARAMS_SQL = "pa AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{n}', {a}::DOUBLE, {b}::DOUBLE, {v}::DOUBLE)" for i, (n, a, b, v) in enumerate(PARAMS)) + f") v(i, name, lo, hi, base)), pd AS (SELECT draw, name, CASE WHEN draw = 0 THEN base ELSE lo + (hi - lo) * {uniform_sql('draw', 'i', DRAW_SEED)} END AS value FROM pa, (SELECT range AS draw FROM range({N_DRAWS})))"


def parameters(spark: SparkSession, draws: int = N_DRAWS) -> DataFrame:
    """(draw, name, value); `family` under a half stands for the curves by kind of work, else for the straight line."""
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(PARAMS)], "i long, name string, lo double, hi double, base double")
    d = p.crossJoin(spark.range(draws).withColumnRenamed("id", "draw"))
    return d.select("draw", "name", F.when(F.col("draw") == 0, F.col("base")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * uniform("draw", "i", DRAW_SEED)).alias("value"))


@query(f"WITH {TELE}, {PARAMS_SQL}, sp AS (SELECT 'tdp:' || spec AS name, sum(w) AS hours FROM tele WHERE spec IS NOT NULL GROUP BY 1) SELECT draw, name, round(value, 9) AS value, round(hours, 4) AS hours FROM pd LEFT JOIN sp USING (name)")
def parameter_draws(spark, sf_dir):
    """All parameters of the power model, drawn from their ranges; those of a kind of device with the hours it was used."""
    hours = telemetry(spark, sf_dir).where("spec is not null").groupBy(F.concat(F.lit("tdp:"), F.col("spec")).alias("name")).agg(F.round(F.sum("w"), 4).alias("hours"))
    return parameters(spark).withColumn("value", F.round("value", 9)).join(hours, "name", "left").select("draw", "name", "value", "hours")


LINE_SQL = power.on_sql(power.LINEAR)
#: By hour and kind of device: sums that every draw's power is linear in, for both families of curves.
SPEC_SUMS = {
    "hours": "gpu_hours", "anchored": f"CASE WHEN state <> 'Standby' AND job_type <> 'online_inference' THEN {power.UTILISED_SQL} END", "line": f"CASE WHEN state <> 'Standby' AND job_type <> 'online_inference' THEN {LINE_SQL} END",
    "nul": "CASE WHEN state <> 'Standby' AND job_type <> 'online_inference' THEN gpu_hours_null_util END", "on_hours": "CASE WHEN state <> 'Standby' AND job_type = 'online_inference' THEN gpu_hours END",
    "on_anchored": f"CASE WHEN state <> 'Standby' AND job_type = 'online_inference' THEN {power.UTILISED_SQL} END", "on_line": f"CASE WHEN state <> 'Standby' AND job_type = 'online_inference' THEN {LINE_SQL} END", "on_nul": "CASE WHEN state <> 'Standby' AND job_type = 'online_inference' THEN gpu_hours_null_util END",
}
#: A draw's energy of a kind of device in an hour, from these sums and the draw's parameters.
DRAWN_ENERGY = """tdp * (phi * hours + (1 - phi) * (CASE WHEN family < 0.5 THEN anchored ELSE line END + null_level * nul + greatest(0, (online_floor - phi) / (1 - phi)) * on_hours
 + greatest(0, 1 - greatest(0, (online_floor - phi) / (1 - phi)) / (CASE WHEN family < 0.5 THEN 0.55 ELSE 1.0 END)) * (CASE WHEN family < 0.5 THEN on_anchored ELSE on_line END + null_level * on_nul)))"""
PLAIN = list(power.PARAMETERS)
MC = f"""{STATS}, {SPINE}, {INV}, {PARAMS_SQL}, dp AS (SELECT draw, {', '.join(f"max(value) FILTER (name = '{n}') AS {n}" for n in PLAIN)} FROM pd GROUP BY draw),
ss AS (SELECT t, spec, {', '.join(f'coalesce(sum({e}), 0) AS {n}' for n, e in SPEC_SUMS.items())} FROM st GROUP BY ALL), dt AS (SELECT draw, spec, coalesce(value, {power.TDP_DEFAULT}) AS tdp FROM (SELECT DISTINCT spec FROM st), (SELECT DISTINCT draw FROM pd) LEFT JOIN pd USING (draw) WHERE name = 'tdp:' || spec UNION ALL SELECT DISTINCT draw, NULL, {power.TDP_DEFAULT} FROM pd),
e AS (SELECT draw, t, sum({DRAWN_ENERGY}) AS pods FROM ss JOIN dt ON dt.spec IS NOT DISTINCT FROM ss.spec JOIN dp USING (draw) GROUP BY ALL), hc AS (SELECT t, sum(cores) AS cores FROM inv GROUP BY t),
bc AS (SELECT t, sum((1.0::DOUBLE + pod_id % 8) * k / 100.0::DOUBLE) FILTER (state <> 'Standby') AS busy FROM tele GROUP BY t),
mc AS (SELECT draw, t, pue * (pods + coalesce(cores, 0) * host_idle + coalesce(busy, 0) * (host_peak - host_idle)) AS p FROM e JOIN dp USING (draw) LEFT JOIN hc USING (t) LEFT JOIN bc USING (t))"""


def draws_of_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(draw, t, p): facility power without the idle floor, for every parameter draw."""
    d = parameters(spark)
    plain = d.where(~F.col("name").startswith("tdp:")).groupBy("draw").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in PLAIN])
    tdp = d.where(F.col("name").startswith("tdp:")).select("draw", F.substring("name", 5, 99).alias("spec"), F.col("value").alias("tdp"))
    sums = statistics(spark, sf_dir).groupBy("t", "spec").agg(*[F.coalesce(F.sum(F.expr(e)), F.lit(0.0)).alias(n) for n, e in SPEC_SUMS.items()])
    e = sums.crossJoin(plain).join(tdp, ["draw", "spec"], "left").withColumn("tdp", F.coalesce("tdp", F.lit(power.TDP_DEFAULT)))
    e = e.groupBy("draw", "t").agg(F.sum(F.expr(DRAWN_ENERGY)).alias("pods"))
    cores = inventory(spark, sf_dir).groupBy("t").agg(F.sum("cores").alias("cores"))
    busy = usage(spark, sf_dir).groupBy("t").agg(F.sum(F.when(F.col("state") != "Standby", F.col("cores") * F.col("busy"))).alias("busy"))
    p = e.join(plain, "draw").join(cores, "t", "left").join(busy, "t", "left")
    zero = F.lit(0.0)
    return p.select("draw", "t", (F.col("pue") * (F.col("pods") + F.coalesce("cores", zero) * F.col("host_idle") + F.coalesce("busy", zero) * (F.col("host_peak") - F.col("host_idle")))).alias("p"))


@query(f"WITH {MC}, a AS (SELECT draw, t % 24 AS hour, avg(p) AS p FROM mc GROUP BY ALL) SELECT hour, round(quantile_cont(p, 0.05), 4) AS p5, round(quantile_cont(p, 0.5), 4) AS p50, round(quantile_cont(p, 0.95), 4) AS p95 FROM a GROUP BY hour")
def mc_average_day(spark, sf_dir):
    """Bands of the average day over all parameters; draws multiply sums by hour and device, not rows."""
    a = draws_of_hours(spark, sf_dir).groupBy("draw", F.expr("t % 24").alias("hour")).agg(F.avg("p").alias("p"))
    return facility.banded(a, "p", ["hour"], 4)


@query(f"WITH {MC}, a AS (SELECT draw, avg(p) AS mean, max(p) AS peak, avg(p) / max(p) AS load_factor FROM mc GROUP BY draw) SELECT metric, round(quantile_cont(value, 0.05), 4) AS p5, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM (UNPIVOT a ON mean, peak, load_factor INTO NAME metric VALUE value) GROUP BY metric")
def mc_metrics(spark, sf_dir):
    """Bands of what each draw's hours come to."""
    a = draws_of_hours(spark, sf_dir).groupBy("draw").agg(F.avg("p").alias("mean"), F.max("p").alias("peak"), (F.avg("p") / F.max("p")).alias("load_factor"))
    return facility.banded(a.unpivot("draw", ["mean", "peak", "load_factor"], "metric", "value"), "value", ["metric"], 4)


METERED = 0.18
ERR = f"""{TELE}, b AS (SELECT least(floor(u * 10), 9)::BIGINT AS bin, avg(u) AS u, count(*) AS n, least(1.0, greatest(0.0, 0.1 + avg(w) / 150)) AS p FROM tele WHERE u IS NOT NULL GROUP BY 1), fam AS (SELECT unnest({list(power.CURVES)}) AS family),
er AS (SELECT family, bin, u, n, greatest(0, (p - {METERED}) / (1 - {METERED})) AS g_metered, CASE family {' '.join(f"WHEN '{f}' THEN {power.curve_sql('u', v)}" for f, v in power.CURVES.items())} END AS g_model FROM b, fam),
ra AS (SELECT *, {METERED} + {1 - METERED} * g_metered AS p_met, {power.IDLE} + {1 - power.IDLE} * g_model AS p_mod FROM er)"""


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, bin, u, n, g_metered, g_model, p_met, p_mod): metered and modelled power by bin of utilisation."""
    b = telemetry(spark, sf_dir).where("u is not null").groupBy(F.least(F.floor(F.col("u") * 10), F.lit(9)).alias("bin")).agg(F.avg("u").alias("u"), F.count("*").alias("n"), F.avg("w").alias("w"))
    b = b.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.1 + F.col("w") / 150)))
    fam = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), lookups.curve("u", power.KNOTS, v).alias("g_model")) for f, v in power.CURVES.items()])).alias("x")
    e = b.select("bin", "u", "n", F.greatest(F.lit(0.0), (F.col("p") - METERED) / (1 - METERED)).alias("g_metered"), fam).select("*", "x.*").drop("x")
    return e.withColumns({"p_met": METERED + (1 - METERED) * F.col("g_metered"), "p_mod": power.IDLE + (1 - power.IDLE) * F.col("g_model")})


@query(f"WITH {ERR} SELECT family, bin, n, round(g_metered, 6) AS g_metered, round(g_model, 6) AS g_model, round(100 * (p_mod / p_met - 1), 6) AS error_pct FROM ra")
def utilisation_error(spark, sf_dir):
    """How far the model is from the meter, by utilisation."""
    return errors(spark, sf_dir).select("family", "bin", "n", F.round("g_metered", 6).alias("g_metered"), F.round("g_model", 6).alias("g_model"), F.round(100 * (F.col("p_mod") / F.col("p_met") - 1), 6).alias("error_pct"))


@query(f"WITH {ERR} SELECT family, upto::DOUBLE AS upto, sum(n)::BIGINT AS n, round(sum(n * 100 * (p_mod / p_met - 1)) / sum(n), 6) AS error_pct FROM ra, (SELECT unnest([0.1, 0.3, 1.0]) AS upto) WHERE (bin + 1) / 10.0 <= upto + 1e-9 GROUP BY ALL")
def low_utilisation_error(spark, sf_dir):
    """The same, weighted, over the bins below a level."""
    upto = spark.createDataFrame([(0.1,), (0.3,), (1.0,)], "upto double")
    e = errors(spark, sf_dir).crossJoin(upto).where((F.col("bin") + 1) / 10.0 <= F.col("upto") + 1e-9)
    return e.groupBy("family", "upto").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * 100 * (F.col("p_mod") / F.col("p_met") - 1)) / F.sum("n"), 6).alias("error_pct"))


CORR = f"""kn AS (SELECT u, p_met / p_mod AS c FROM ra WHERE family = 'training'), ka AS (SELECT u, c FROM kn UNION ALL SELECT -1.0, arg_min(c, u) FROM kn UNION ALL SELECT 2.0, arg_max(c, u) FROM kn), kb AS (SELECT u AS x, c, lead(u) OVER (ORDER BY u) AS nx, lead(c) OVER (ORDER BY u) AS nc FROM ka),
co AS (SELECT pw.*, coalesce(c + (nc - c) * (ur - x) / (nx - x), 1) AS f FROM (SELECT *, CASE WHEN gpu_hours > 0 THEN least(1, greatest(0, s0 / gpu_hours)) ELSE 0 END AS ur FROM pw) pw LEFT JOIN kb ON ur >= x AND ur < nx)"""


def corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's rows with the factor f that brings their power to the meter's, by their utilisation."""
    knots = errors(spark, sf_dir).where("family = 'training'").select("u", (F.col("p_met") / F.col("p_mod")).alias("c"))
    ur = F.when(F.col("gpu_hours") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s0") / F.col("gpu_hours")))).otherwise(0.0)
    return asof.interpolated_at(rows(spark, sf_dir).withColumn("ur", ur), knots, "ur", "f").withColumn("f", F.coalesce("f", F.lit(1.0)))


@query(f"""WITH {FAC}, {ERR.replace(TELE + ', ', '')}, {CORR}, h AS (SELECT t, sum(idle + active) AS a0, sum((idle + active) * f) AS a1, coalesce(sum(active) FILTER (layer = 'curtail'), 0) AS c0, coalesce(sum(active * f) FILTER (layer = 'curtail'), 0) AS c1 FROM co GROUP BY t),
i AS (SELECT a0, a1, c0, c1, a0 + idle_floor + host AS i0, a1 + idle_floor + host AS i1 FROM h JOIN fa USING (t) WHERE a0 > 0), w AS (SELECT unnest(['workload', 'it', 'facility']) AS boundary, unnest([a0, i0, {power.PUE} * i0]) AS p0, unnest([a1, i1, {power.PUE} * i1]) AS p1, c0, c1 FROM i)
SELECT boundary, round(avg(p0), 4) AS mean_w, round(avg(p1), 4) AS corrected_w, round(100 * (avg(p1) / avg(p0) - 1), 6) AS shift_pct, round(avg(c0) / avg(p0), 6) AS scope, round(avg(c1) / avg(p1), 6) AS scope_corrected FROM w GROUP BY boundary""")
def corrected_scope(spark, sf_dir):
    """What a correction by utilisation does to the load, and to the share of it that can be curtailed, by boundary."""
    lp = lambda c: F.coalesce(F.sum(F.when(F.col("layer") == "curtail", c)), F.lit(0.0))
    e = F.col("idle") + F.col("active")
    h = corrected(spark, sf_dir).groupBy("t").agg(F.sum(e).alias("a0"), F.sum(e * F.col("f")).alias("a1"), lp(F.col("active")).alias("c0"), lp(F.col("active") * F.col("f")).alias("c1")).where("a0 > 0")
    i = h.join(hourly(spark, sf_dir).select("t", (F.col("idle_floor") + F.col("host")).alias("rest")), "t")
    parts = {"workload": ("a0", "a1"), "it": ("a0 + rest", "a1 + rest"), "facility": (f"{power.PUE}D * (a0 + rest)", f"{power.PUE}D * (a1 + rest)")}
    w = i.select("c0", "c1", F.explode(F.array(*[F.struct(F.lit(n).alias("boundary"), F.expr(a).alias("p0"), F.expr(b).alias("p1")) for n, (a, b) in parts.items()])).alias("x")).select("c0", "c1", "x.*")
    r = lambda a, b, n: F.round(F.avg(a) / F.avg(b), 6).alias(n)
    return w.groupBy("boundary").agg(F.round(F.avg("p0"), 4).alias("mean_w"), F.round(F.avg("p1"), 4).alias("corrected_w"), F.round(100 * (F.avg("p1") / F.avg("p0") - 1), 6).alias("shift_pct"), r("c0", "p0", "scope"), r("c1", "p1", "scope_corrected"))


SETS = f"""{ROWS}, {SPINE}, ce AS (SELECT cluster_id, t, coalesce(sum(active) FILTER (layer = 'curtail'), 0) AS lp, coalesce(sum(active) FILTER (priority_class = 'HP' AND job_type IN ('training', 'offline_inference')), 0) AS hp FROM pw GROUP BY ALL),
me AS (SELECT cluster_id, sum(lp) / (SELECT n FROM span) AS mean_lp, sum(hp) / (SELECT n FROM span) AS mean_hp FROM ce GROUP BY 1), th AS (SELECT *, mean_lp >= 0.95 * avg(mean_lp) OVER () AS kept FROM me),
sc AS (SELECT scope, frac, s.t, coalesce(sum(lp + frac * hp), 0) AS v FROM spine s CROSS JOIN (SELECT unnest(['kept', 'all']) AS scope) CROSS JOIN (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS frac) LEFT JOIN (SELECT ce.*, kept FROM ce JOIN th USING (cluster_id)) x ON x.t = s.t AND (kept OR scope = 'all') GROUP BY ALL),
go AS (SELECT scope, frac, t, CASE WHEN t IN (SELECT t FROM pw GROUP BY t HAVING sum(idle + active) > 0) THEN v END AS v FROM sc)"""


@query(f"WITH {SETS}, m AS ({m_sql('go', [1, 4, 24], 'scope, frac')}), k AS (SELECT scope, frac, h, quantile_cont(m, 0.05) AS k FROM m GROUP BY ALL) SELECT a.h, a.frac, round(a.k, 4) AS kept, round(b.k, 4) AS every, round(b.k - a.k, 4) AS delta, round(100 * (b.k / nullif(a.k, 0) - 1), 6) AS delta_pct FROM k a JOIN k b USING (h, frac) WHERE a.scope = 'kept' AND b.scope = 'all'")
def cluster_set_consistency(spark, sf_dir):
    """Whether leaving out the clusters below a least mean changes the dependable level."""
    pw = rows(spark, sf_dir)
    zero = F.lit(0.0)
    hp = (F.col("priority_class") == "HP") & F.col("job_type").isin("training", "offline_inference")
    part = lambda test, n: F.coalesce(F.sum(F.when(test, F.col("active"))), zero).alias(n)
    ce = pw.groupBy("cluster_id", "t").agg(part(F.col("layer") == "curtail", "lp"), part(hp, "hp"), F.sum(F.col("idle") + F.col("active")).alias("e"))
    th = ce.groupBy("cluster_id").agg(F.sum("lp").alias("lp_sum")).withColumn("kept", F.col("lp_sum") >= 0.95 * F.avg("lp_sum").over(Window.partitionBy())).select("cluster_id", "kept")
    grid = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0)])).alias("frac")
    sums = ce.join(th, "cluster_id").groupBy("t").agg(F.sum(F.when(F.col("kept"), F.col("lp"))).alias("lk"), F.sum(F.when(F.col("kept"), F.col("hp"))).alias("hk"), F.sum("lp").alias("la"), F.sum("hp").alias("ha"), F.sum("e").alias("e"))
    s = dense(sums).select("t", "lk", "hk", "la", "ha", "e", grid)
    level = lambda a, b: F.when(F.col("e") > 0, F.coalesce(F.col(a) + F.col("frac") * F.col(b), zero))
    two = F.explode(F.array(F.struct(F.lit("kept").alias("scope"), level("lk", "hk").alias("v")), F.struct(F.lit("all").alias("scope"), level("la", "ha").alias("v")))).alias("x")
    k = firm(s.select("t", "frac", two).select("t", "frac", "x.*"), [1, 4, 24], [0.95], ["scope", "frac"]).groupBy("h", "frac").agg(F.max(F.when(F.col("scope") == "kept", F.col("k"))).alias("a"), F.max(F.when(F.col("scope") == "all", F.col("k"))).alias("b"))
    return k.select("h", "frac", F.round("a", 4).alias("kept"), F.round("b", 4).alias("every"), F.round(F.col("b") - F.col("a"), 4).alias("delta"), F.round(100 * (F.try_divide("b", "a") - 1), 6).alias("delta_pct"))
