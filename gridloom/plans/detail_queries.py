"""Smaller operators: joins and masks, calendars, shapes, levels of synchrony, panels of evaluations, text facts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import power
from gridloom.operators import covariance, facts, lookups, rollups
from gridloom.operators.facility import rounded as r6
from gridloom.operators.resample import block_index
from gridloom.operators.rolling import deseasoned, firm, fleet, lanes, minima, over, quantile, span
from gridloom.plans.firm_queries import JOBS, TWO, jobs, k_sql, m_sql, two
from gridloom.plans.model_queries import CHAIN, SCREEN, blocks_sql, chain, screened
from gridloom.plans.registry import query
from gridloom.plans.series_queries import RESID, residuals
from gridloom.sources.tables import FLEET, LANES, TELE, table, telemetry


# joins, masks and lookups


@query("SELECT c_nationkey AS nation, count(*) AS n, round(sum(x), 2) AS total FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS x FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def one_to_one_join(spark, sf_dir):
    """A join that fails if either side repeats a key."""
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    right = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("x"))
    return rollups.one_to_one(left, right, "k").groupBy("nation").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"))


SENSORS = f"{TELE}, se AS (SELECT pod_id AS node, t // 24 AS day, cluster_id AS sensor, avg(w) AS x, count(*) AS n FROM tele GROUP BY ALL)"


@query(f"WITH {SENSORS}, b AS (SELECT * FROM se WHERE sensor = 'view'), o AS (SELECT * FROM se WHERE sensor = 'signup' AND n >= 2) SELECT b.node, b.day, round(b.x, 6) AS base, round(o.x, 6) AS cap FROM b LEFT JOIN o ON o.node = b.node AND o.day = b.day")
def optional_sensors(spark, sf_dir):
    """A sensor that every row needs, and one that may be missing or too thin."""
    se = telemetry(spark, sf_dir).where("cluster_id IN ('view', 'signup')").groupBy(F.col("pod_id").alias("node"), F.expr("t div 24").alias("day")).pivot("cluster_id", ["view", "signup"]).agg(F.avg("w").alias("x"), F.count("w").alias("n"))
    return se.where("view_x is not null").select("node", "day", F.round("view_x", 6).alias("base"), F.round(F.when(F.col("signup_n") >= 2, F.col("signup_x")), 6).alias("cap"))


@query(f"WITH {LANES}, st AS (SELECT cluster_id, avg(v) AS a, stddev_samp(v) AS s FROM lanes GROUP BY 1), sh AS (SELECT cluster_id, sum(w) FILTER (job_type = 'training') / sum(w) AS share FROM tele WHERE priority_class <> 'Other' GROUP BY 1) SELECT st.cluster_id, round(s / a, 6) AS cv, round(share, 6) AS training FROM st LEFT JOIN sh USING (cluster_id) WHERE share IS NOT NULL")
def stats_with_share(spark, sf_dir):
    """Statistics of units beside a share that comes from the rows."""
    tele = telemetry(spark, sf_dir)
    st = lanes(tele).groupBy("cluster_id").agg(F.avg("v").alias("a"), F.stddev_samp("v").alias("s"))
    sh = tele.where("priority_class <> 'Other'").groupBy("cluster_id").agg((F.sum(F.when(F.col("job_type") == "training", F.col("w"))) / F.sum("w")).alias("share"))
    return st.join(sh, "cluster_id", "left").dropna(subset=["share"]).select("cluster_id", F.round(F.col("s") / F.col("a"), 6).alias("cv"), F.round("share", 6).alias("training"))


TOL = "tol AS (SELECT o_orderpriority AS job, sum(l_quantity) FILTER (date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) >= 30) / sum(l_quantity) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> (SELECT max(o_orderpriority) FROM orders) GROUP BY 1)"


@query(f"WITH {TOL} SELECT o_orderpriority AS job, o_orderstatus AS status, round(sum(o_totalprice * coalesce(s, 0)), 2) AS tolerant, count(*) AS n FROM orders LEFT JOIN tol ON job = o_orderpriority GROUP BY ALL")
def tolerance_lookup(spark, sf_dir):
    """A share by kind looked up for each row; a kind without one counts as none."""
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderpriority").alias("last"))
    d = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).crossJoin(last).where("o_orderpriority <> last")
    tol = rollups.tolerance(d.select(F.col("o_orderpriority").alias("job"), F.col("l_quantity").alias("w"), F.datediff("l_shipdate", "o_orderdate").alias("d")), ["job"], "d", "w", [30], digits=None)
    sums = o.groupBy(F.col("o_orderpriority").alias("job"), F.col("o_orderstatus").alias("status")).agg(F.sum("o_totalprice").alias("x"), F.count("*").alias("n"))
    return sums.join(tol, "job", "left").select("job", "status", F.round(F.col("x") * F.coalesce("s_30", F.lit(0.0)), 2).alias("tolerant"), "n")


@query(f"WITH {LANES}, g AS (SELECT t, count(v) >= 3 AS good FROM lanes GROUP BY t), f AS (SELECT cluster_id, l.t, good, CASE WHEN good THEN v END AS v FROM lanes l JOIN g USING (t)) SELECT cluster_id, count(*) AS hours, count(v) AS valid, round(avg(v), 6) AS mean_v, sum(first::INT)::BIGINT AS good_hours FROM f JOIN (SELECT t, any_value(good) AS first FROM f GROUP BY t) USING (t) GROUP BY cluster_id")
def hour_flags(spark, sf_dir):
    """Hours marked by how many clusters report; the mark goes to every row of the
    hour, and one of the equal marks of an hour stands for it."""
    s = lanes(telemetry(spark, sf_dir))
    g = s.groupBy("t").agg((F.count("v") >= 3).alias("good"))
    f = s.join(g, "t").withColumn("v", F.when(F.col("good"), F.col("v")))
    one = f.groupBy("t").agg(F.first("good").alias("first"))
    return f.join(one, "t").groupBy("cluster_id").agg(F.count("*").alias("hours"), F.count("v").alias("valid"), F.round(F.avg("v"), 6).alias("mean_v"), F.sum(F.col("first").cast("int")).alias("good_hours"))


@query(f"WITH {FLEET}, bad AS (SELECT unnest([126, 300]) AS t) SELECT count(*) AS hours, count(v) AS valid, round(sum(v), 4) AS total FROM (SELECT f.t, CASE WHEN bad.t IS NULL THEN v END AS v FROM fleet f LEFT JOIN bad USING (t))")
def bad_hours(spark, sf_dir):
    """Known bad hours are gaps, though rows exist."""
    f = fleet(telemetry(spark, sf_dir)).withColumn("v", F.when(~F.col("t").isin(126, 300), F.col("v")))
    return f.agg(F.count("*").alias("hours"), F.count("v").alias("valid"), F.round(F.sum("v"), 4).alias("total"))


@query(f"WITH {TELE}, sp AS (SELECT pod_id, min(t) AS t_min, max(t) AS t_max, sum(w) AS gh FROM tele WHERE coalesce(w, 0) > 0 GROUP BY pod_id), e AS (SELECT min(t) AS lo, max(t) AS hi FROM tele) SELECT pod_id, t_min, t_max, round(gh, 4) AS gh FROM sp, e WHERE NOT (t_min <= lo OR t_max >= hi)")
def censored_spans(spark, sf_dir):
    """Spans that begin and end inside the trace; rows without weight don't count, and that test reaches the files."""
    tele = telemetry(spark, sf_dir).where("w > 0")
    sp = rollups.spans(tele, "pod_id")
    e = telemetry(spark, sf_dir).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return sp.crossJoin(e).where("NOT (t_min <= lo OR t_max >= hi)").select("pod_id", "t_min", "t_max", F.round("gh", 4).alias("gh"))


@query(f"WITH {TELE}, a AS (SELECT DISTINCT spec FROM tele WHERE spec IS NOT NULL), b AS (SELECT unnest({list(power.TDP)}) AS spec), u AS (SELECT spec FROM a UNION SELECT spec FROM b) SELECT spec, spec IN (SELECT spec FROM a) AS seen, spec IN (SELECT spec FROM b) AS named FROM u")
def label_sets(spark, sf_dir):
    """Labels that are in the rows, in the parameters, or both."""
    a = telemetry(spark, sf_dir).where("spec is not null").select("spec").distinct()
    b = spark.createDataFrame([(x,) for x in power.TDP], "spec string")
    tagged = a.withColumn("i", F.lit(1)).unionByName(b.withColumn("i", F.lit(2)))
    return tagged.groupBy("spec").agg((F.max((F.col("i") == 1).cast("int")) == 1).alias("seen"), (F.max((F.col("i") == 2).cast("int")) == 1).alias("named"))


@query(f"WITH {LANES} SELECT cluster_id, t FROM lanes EXCEPT SELECT cluster_id, t FROM tele")
def missing_hours(spark, sf_dir):
    """The calendar's hours in which a cluster has no row."""
    tele = telemetry(spark, sf_dir)
    return lanes(tele).select("cluster_id", "t").join(tele.select("cluster_id", "t"), ["cluster_id", "t"], "left_anti")


@query(f"WITH {LANES}, m AS (SELECT cluster_id, avg(coalesce(v, 0)) AS a FROM lanes GROUP BY 1) SELECT cluster_id, round(a, 6) AS mean_v, row_number() OVER (ORDER BY a DESC, cluster_id) AS place FROM m WHERE a >= 0.95 * (SELECT avg(a) FROM m)")
def ordered_clusters(spark, sf_dir):
    """Clusters by falling mean, those under a least one left out; ties by name."""
    m = lanes(telemetry(spark, sf_dir)).groupBy("cluster_id").agg(F.avg(F.coalesce("v", F.lit(0.0))).alias("a")).withColumn("all", F.avg("a").over(Window.partitionBy()))
    m = m.where(F.col("a") >= 0.95 * F.col("all"))
    return m.select("cluster_id", F.round("a", 6).alias("mean_v"), F.row_number().over(Window.orderBy(F.desc("a"), "cluster_id")).cast("long").alias("place"))


@query("SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) DESC) AS place, o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority, o_orderstatus")
def stable_order(spark, sf_dir):
    """Rows in the order of several labels."""
    s = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    w = Window.orderBy("o_orderpriority", "o_orderstatus", F.desc("total"))
    return s.select(F.row_number().over(w).cast("long").alias("place"), "o_orderpriority", "o_orderstatus", "total")


# scalar functions


@query(f"WITH {TELE} SELECT pod_id, t, round(least(greatest(k / 100.0::DOUBLE, 0.1), 0.9), 6) AS clipped, sha256(cluster_id || ':' || pod_id) AS name, substr(spec, 1, 2) AS short, concat_ws('|', cluster_id, spec, job_type) AS path, round(CASE WHEN u < 0.25 THEN 60 + 480 * u WHEN u < 0.5 THEN 180 + 240 * (u - 0.25) WHEN u < 0.75 THEN 240 + 144 * (u - 0.5) ELSE 276 + 96 * (u - 0.75) END, 6) AS watts, round(ln(1 + w), 6) AS log_w FROM tele")
def scalar_functions(spark, sf_dir):
    """Clips at both ends, digests, slices, joined labels, a curve by cases, logarithms."""
    u = F.col("u")
    watts = F.when(u < 0.25, 60 + 480 * u).when(u < 0.5, 180 + 240 * (u - 0.25)).when(u < 0.75, 240 + 144 * (u - 0.5)).otherwise(276 + 96 * (u - 0.75))
    return telemetry(spark, sf_dir).select(
        "pod_id", "t", F.round(F.least(F.greatest(F.col("k") / 100.0, F.lit(0.1)), F.lit(0.9)), 6).alias("clipped"), F.sha2(F.concat_ws(":", "cluster_id", F.col("pod_id").cast("string")), 256).alias("name"),
        F.substring("spec", 1, 2).alias("short"), F.concat_ws("|", "cluster_id", "spec", "job_type").alias("path"), F.round(watts, 6).alias("watts"), F.round(F.log1p("w"), 6).alias("log_w"),
    )


@query("SELECT o_orderstatus, count(*) AS n, count(x) AS finite FROM (SELECT o_orderstatus, CASE WHEN isfinite(y) THEN y END AS x FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS y FROM orders)) WHERE o_orderstatus <> 'it''s' GROUP BY 1")
def finite_values(spark, sf_dir):
    """NaN becomes a gap when rows are read; a label with a quote is a parameter, not text in the statement."""
    table(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))).createOrReplaceTempView("finite_values_in")
    return spark.sql("SELECT o_orderstatus, count(*) AS n, count(CASE WHEN NOT isnan(y) AND abs(y) < double('infinity') THEN y END) AS finite FROM finite_values_in WHERE o_orderstatus <> :label GROUP BY o_orderstatus", args={"label": "it's"})


#: What each pod's readings say, as facts are written down: work, phase, a number as a text, and how it is known.
FACT = "CASE pod_id % 3 WHEN 0 THEN cast(lo AS {text}) WHEN 1 THEN concat('~', cast(hi AS {text})) ELSE concat(cast(lo AS {text}), '-', cast(hi AS {text})) END"
PHASE = "CASE WHEN state = 'Standby' AND spec IS NULL THEN 'deep idle' WHEN state = 'Standby' THEN 'idle' WHEN job_type = 'training' AND priority_class = 'LP' THEN 'comm trough' WHEN job_type = 'other' AND priority_class = 'HP' THEN 'burn' WHEN job_type = 'online_inference' AND spec IS NULL THEN 'facility' ELSE 'steady' END"
NOTES = "CASE WHEN spec = 'A10' THEN 'EXACT' WHEN spec = 'A100' THEN 'COMPUTED from hours' ELSE '' END"
FACTS_SQL = f"fc AS (SELECT job_type AS workload, {PHASE} AS phase, {FACT.format(text='VARCHAR')} AS s, {NOTES} AS notes FROM (SELECT pod_id, job_type, priority_class, spec, state, min(k) / 100.0::DOUBLE AS lo, max(k) / 100.0::DOUBLE AS hi FROM tele GROUP BY ALL))"


def facts_of(spark, sf_dir):
    """(workload, phase, s, notes): a fact of each pod and state."""
    x = telemetry(spark, sf_dir).groupBy("pod_id", "job_type", "priority_class", "spec", "state").agg((F.min("k") / 100.0).alias("lo"), (F.max("k") / 100.0).alias("hi"))
    return x.select(F.col("job_type").alias("workload"), F.expr(PHASE).alias("phase"), F.expr(FACT.format(text="STRING")).alias("s"), F.expr(NOTES).alias("notes"))


@query(f"WITH {TELE}, {FACTS_SQL}, x AS (SELECT workload, phase, notes, s FROM fc), {facts.PARSED}, g AS (SELECT {facts.category_sql()} AS category, number AS v, CASE WHEN starts_with(notes, 'EXACT') THEN 'EXACT' WHEN starts_with(notes, 'COMPUTED') THEN 'COMPUTED' ELSE 'APPROX' END AS tag FROM z) SELECT category, tag, count(*) AS n, round(min(v), 6) AS least, round(median(v), 6) AS middle, round(max(v), 6) AS most, round(CASE category {' '.join(f"WHEN '{k}' THEN {v!r}" for k, v in facts.MODELLED.items())} END, 6) AS modelled FROM g WHERE v <= 1.3 AND category IS NOT NULL GROUP BY ALL")
def facts_by_category(spark, sf_dir):
    """Facts by category and trust, beside what the model says."""
    g = facts_of(spark, sf_dir).select(facts.category(), rollups.number_of("s").alias("v"), F.when(F.col("notes").startswith("EXACT"), "EXACT").when(F.col("notes").startswith("COMPUTED"), "COMPUTED").otherwise("APPROX").alias("tag"))
    return g.where("v <= 1.3 and category is not null").groupBy("category", "tag").agg(F.count("*").alias("n"), F.round(F.min("v"), 6).alias("least"), F.round(F.median("v"), 6).alias("middle"), F.round(F.max("v"), 6).alias("most")).withColumn("modelled", F.round(F.try_element_at(F.create_map(*[F.lit(x) for kv in facts.MODELLED.items() for x in kv]), F.col("category")), 6))


# calendars, shapes and series


@query(f"WITH {FLEET}, m AS ({m_sql('fleet', [1, 4])}), c AS (SELECT h, m, unnest(['hour', 'weekday', 'month']) AS calendar, unnest([t % 24, (t // 24) % 7, t // 720]) AS part FROM m) SELECT calendar, h, part, round(quantile_cont(m, 0.05), 6) AS k, count(*) AS n FROM c GROUP BY ALL")
def k_by_calendar(spark, sf_dir):
    """By hour of day, day of week and block of thirty days that a window starts in; one pass."""
    part = F.explode(F.array(*[F.struct(F.lit(n).alias("calendar"), F.expr(e).alias("part")) for n, e in (("hour", "t % 24"), ("weekday", "(t div 24) % 7"), ("month", "t div 720"))])).alias("x")
    m = minima(fleet(telemetry(spark, sf_dir)), [1, 4]).select("h", "m", part).select("h", "m", "x.*")
    return m.groupBy("calendar", "h", "part").agg(F.round(quantile("m", 0.05), 6).alias("k"), F.count("*").alias("n"))


@query(f"WITH {FLEET}, x AS (SELECT t, row_number() OVER (ORDER BY t) AS i, v FROM fleet WHERE v IS NOT NULL) SELECT lag::BIGINT AS lag, round(corr(a.v, b.v), 6) AS acf, count(*) AS n FROM x a JOIN (SELECT unnest([1, 24, 168]) AS lag) ON true JOIN x b ON b.i = a.i + lag GROUP BY lag")
def autocorr_compressed(spark, sf_dir):
    """Autocorrelation after gaps are closed, each side with its own mean."""
    x = fleet(telemetry(spark, sf_dir)).where("v is not null")
    w = Window.orderBy("t")
    x = x.select("v", *[F.lead("v", k).over(w).alias(f"v{k}") for k in (1, 24, 168)])
    rows = x.select("v", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"v{k}").alias("y")) for k in (1, 24, 168)])).alias("p")).select("v", "p.*").where("y is not null")
    return rows.groupBy("lag").agg(F.round(F.corr("v", "y"), 6).alias("acf"), F.count("*").alias("n"))


@query(f"WITH {TWO}, s AS (SELECT 'all' AS model, t, v FROM two UNION ALL SELECT 'part', t, c FROM two), d AS (SELECT model, 0 AS h, v AS x FROM s UNION ALL SELECT model, h, m FROM ({m_sql('s', [1, 4, 24], 'model')})) SELECT model, h::BIGINT AS h, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95, round(avg(x) / nullif(max(x), 0), 6) AS load_factor FROM d WHERE x IS NOT NULL AND h > 0 GROUP BY ALL")
def fleet_shape(spark, sf_dir):
    """Quantiles of minima over the hours up to each one, and the load factor, for the whole and a part."""
    x = two(telemetry(spark, sf_dir))
    s = x.select("t", F.explode(F.array(F.struct(F.lit("all").alias("model"), F.col("v")), F.struct(F.lit("part").alias("model"), F.col("c").alias("v")))).alias("x")).select("t", "x.*")
    w = {h: over(["model"], -(h - 1), 0) for h in (1, 4, 24)}
    wide = s.select("model", *[F.when(F.count("v").over(w[h]) == h, F.min("v").over(w[h])).alias(f"m{h}") for h in w])
    m = wide.select("model", F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.col(f"m{h}").alias("m")) for h in w])).alias("x")).select("model", "x.*").where("m is not null")
    q = m.groupBy("model", "h").agg(F.percentile("m", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.round(F.try_divide(F.avg("m"), F.max("m")), 6).alias("load_factor"))
    return q.select("model", "h", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))], "load_factor")


@query(f"WITH {TWO} SELECT t % 24 AS hour, round(avg(v) / (SELECT avg(v) FROM two), 6) AS all_, round(avg(c) / (SELECT avg(c) FROM two), 6) AS part FROM two GROUP BY 1")
def clock_profile(spark, sf_dir):
    """The average day over the mean."""
    x = two(telemetry(spark, sf_dir))
    m = x.agg(F.avg("v").alias("mv"), F.avg("c").alias("mc"))
    return x.groupBy(F.expr("t % 24").alias("hour")).agg(F.avg("v").alias("v"), F.avg("c").alias("c")).crossJoin(m).select("hour", F.round(F.col("v") / F.col("mv"), 6).alias("all_"), F.round(F.col("c") / F.col("mc"), 6).alias("part"))


@query(f"WITH {FLEET}, me AS (SELECT t, 1.1 * sum(w) + t % 7 AS kw FROM tele GROUP BY t), c AS (SELECT f.t, kw / nullif(v, 0) AS ratio FROM fleet f LEFT JOIN me USING (t) WHERE kw > 0) SELECT count(*) AS hours, round(quantile_cont(ratio, 0.05), 6) AS p5, round(quantile_cont(ratio, 0.5), 6) AS p50, round(quantile_cont(ratio, 0.95), 6) AS p95 FROM c")
def closure_ratio(spark, sf_dir):
    """A meter over the sum of parts, in hours that the meter has."""
    tele = telemetry(spark, sf_dir)
    me = tele.groupBy("t").agg((1.1 * F.sum("w") + F.col("t") % 7).alias("kw"))
    c = fleet(tele).join(me, "t", "left").where("kw > 0").withColumn("ratio", F.try_divide("kw", "v"))
    q = c.agg(F.count("*").alias("hours"), F.percentile("ratio", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select("hours", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))])


MODELS = f"{FLEET}, md AS (SELECT t, v, avg(v) OVER (ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS day, lag(v, 24) OVER (ORDER BY t) AS yesterday, lag(v, 168) OVER (ORDER BY t) AS week FROM fleet), ev AS (SELECT t, v, unnest(['day', 'yesterday', 'week']) AS model, unnest([day, yesterday, week]) AS f FROM md), pa AS (SELECT ev.*, unnest(['all', 'trimmed', 'held_out']) AS panel, unnest([true, t BETWEEN lo + 168 AND lo + n - 169, (t // 24) % 5 = 0]) AS inside FROM ev, span)"


@query(f"WITH {MODELS}, ok AS (SELECT model, panel, f, v FROM pa WHERE inside AND f IS NOT NULL AND v > 0) SELECT model, panel, count(*) AS n, round(sum(f) / sum(v) - 1, 6) AS bias, round(avg(abs(f - v)), 6) AS mae, {', '.join(f'round(quantile_cont(f / v - 1, {p}), 6) AS q{int(100 * p)}' for p in (0.01, 0.05, 0.5, 0.95, 0.99))} FROM ok GROUP BY ALL")
def evaluation_panels(spark, sf_dir):
    """Three forecasts on three panels of hours: bias, error, quantiles of the relative error."""
    f = fleet(telemetry(spark, sf_dir))
    w = Window.orderBy("t")
    md = f.withColumns({"day": F.avg("v").over(over([], -24, -1)), "yesterday": F.lag("v", 24).over(w), "week": F.lag("v", 168).over(w)}).crossJoin(span(f))
    panels = {"all": "true", "trimmed": "t BETWEEN lo + 168 AND lo + n - 169", "held_out": "(t div 24) % 5 = 0"}
    rows = md.select("t", "v", "lo", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("f")) for m in ("day", "yesterday", "week")])).alias("x")).select("*", "x.*").where("f is not null and v > 0")
    rows = rows.select("model", "f", "v", F.explode(F.array(*[F.struct(F.lit(k).alias("panel"), F.expr(e).alias("inside")) for k, e in panels.items()])).alias("p")).where("p.inside").select("model", "f", "v", "p.panel")
    shares = (0.01, 0.05, 0.5, 0.95, 0.99)
    q = rows.groupBy("model", "panel").agg(F.count("*").alias("n"), F.round(F.sum("f") / F.sum("v") - 1, 6).alias("bias"), F.round(F.avg(F.abs(F.col("f") - F.col("v"))), 6).alias("mae"), F.percentile(F.col("f") / F.col("v") - 1, F.array(*[F.lit(p) for p in shares])).alias("q"))
    return q.select("model", "panel", "n", "bias", "mae", *[F.round(F.col("q")[i], 6).alias(f"q{int(100 * p)}") for i, p in enumerate(shares)])


@query(f"WITH {TELE}, j AS (SELECT cluster_id, t, priority_class, avg({power.curve_sql('u', power.CURVES['training'])}) AS raw, {power.curve_sql('avg(u)', power.CURVES['training'])} AS hm FROM tele WHERE u IS NOT NULL GROUP BY ALL) SELECT priority_class, count(*) AS n, round(sum(hm) / sum(raw) - 1, 6) AS weighted, round(quantile_cont(hm / raw - 1, 0.5), 6) AS p50, round(quantile_cont(hm / raw - 1, 0.95), 6) AS p95, round(quantile_cont(hm / raw - 1, 0.99), 6) AS p99 FROM j WHERE raw > 0 GROUP BY 1")
def jensen_gap(spark, sf_dir):
    """The curve of an hour's mean over the mean of the curve, by stratum."""
    c = lambda x: lookups.curve(x, power.KNOTS, power.CURVES["training"])
    j = telemetry(spark, sf_dir).where("u is not null").withColumn("g", c("u")).groupBy("cluster_id", "t", "priority_class").agg(F.avg("g").alias("raw"), F.avg("u").alias("mu")).withColumn("hm", c("mu")).where("raw > 0")
    q = j.groupBy("priority_class").agg(F.count("*").alias("n"), F.round(F.sum("hm") / F.sum("raw") - 1, 6).alias("weighted"), F.percentile(F.col("hm") / F.col("raw") - 1, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("q"))
    return q.select("priority_class", "n", "weighted", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


# dependable load


PRODUCT = f"{JOBS}, s AS (SELECT unnest([1, 4, 24])::BIGINT AS horizon, unnest([0.9, 0.6, 0.3]) AS share), p AS (SELECT horizon, t, lp + share * (tr + off) AS v FROM jobs, s)"


@query(f"WITH {PRODUCT}, m AS ({m_sql('p', [1, 4, 24], 'horizon')}) SELECT horizon, round(quantile_cont(m, 0.05), 6) AS k, count(*) AS n FROM m WHERE h = horizon GROUP BY horizon")
def horizon_product(spark, sf_dir):
    """What yields at once plus the share of the rest that tolerates a wait as long as the window."""
    s = spark.createDataFrame([(1, 0.9), (4, 0.6), (24, 0.3)], "horizon long, share double")
    p = jobs(telemetry(spark, sf_dir)).crossJoin(s).withColumn("v", F.col("lp") + F.col("share") * (F.col("tr") + F.col("off")))
    return minima(p, [1, 4, 24], ["horizon"]).where("h = horizon").groupBy("horizon").agg(F.round(quantile("m", 0.05), 6).alias("k"), F.count("*").alias("n"))


@query(f"WITH {LANES}, r AS (SELECT cluster_id, row_number() OVER (ORDER BY avg(v) DESC, cluster_id) AS place FROM lanes GROUP BY 1), ne AS (SELECT 'nested ' || n AS scope, t, CASE WHEN count(v) = n THEN sum(v) END AS v FROM r JOIN (SELECT place AS n FROM r) z ON place <= n JOIN lanes USING (cluster_id) GROUP BY n, t), er AS (SELECT 'era ' || t // 240 AS scope, t, CASE WHEN count(v) > 0 THEN sum(v) END AS v FROM lanes GROUP BY t), a AS (SELECT * FROM ne UNION ALL SELECT * FROM er UNION ALL SELECT 'fleet', t, sum(v) FROM lanes GROUP BY t), m AS ({m_sql('a', [1, 4], 'scope')}), k AS ({k_sql('m', 'scope', [0.9, 0.95])}) SELECT scope, h, alpha, round(k, 6) AS k, n_windows FROM k")
def scope_surface(spark, sf_dir):
    """The surface of the fleet, of the largest clusters together, and of eras, from one sort of all scopes."""
    s = lanes(telemetry(spark, sf_dir))
    r = s.groupBy("cluster_id").agg(F.avg("v").alias("a")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("a"), "cluster_id")).cast("long"))
    m = r.select("cluster_id", "place").join(r.select(F.col("place").alias("n")), F.col("place") <= F.col("n"))
    ne = s.join(m, "cluster_id").groupBy("n", "t").agg(F.count("v").alias("have"), F.sum("v").alias("x")).select(F.concat(F.lit("nested "), F.col("n")).alias("scope"), "t", F.when(F.col("have") == F.col("n"), F.col("x")).alias("v"))
    fl = s.groupBy("t").agg(F.sum("v").alias("v"))
    all_ = ne.unionByName(fl.withColumn("scope", F.lit("fleet"))).unionByName(fl.withColumn("scope", F.concat(F.lit("era "), F.expr("t div 240"))))
    return r6(firm(all_, [1, 4], [0.9, 0.95], ["scope"]), "k")


@query(f"WITH {TWO}, l AS ({m_sql('two', [1, 4, 24])}), c AS ({m_sql('two', [1, 4, 24], v='c')}), kl AS ({k_sql('l', shares=[0.95])}), kc AS ({k_sql('c', shares=[0.95])}), a AS (SELECT sum(c) / sum(v) AS share FROM two) SELECT h, round(kc.k / (share * kl.k), 6) AS scalar, round(kc.k / kl.k, 6) AS required, round(avg(kc.k / (share * kl.k)) OVER (), 6) AS mean_scalar FROM kl JOIN kc USING (h, alpha), a")
def tail_scalar(spark, sf_dir):
    """By how much a constant share has to be scaled to hold in the tail."""
    x = two(telemetry(spark, sf_dir))
    kl = firm(x, [1, 4, 24], [0.95]).select("h", F.col("k").alias("kl"))
    kc = firm(x.select("t", F.col("c").alias("v")), [1, 4, 24], [0.95]).select("h", F.col("k").alias("kc"))
    s = kl.join(kc, "h").crossJoin(x.agg((F.sum("c") / F.sum("v")).alias("share"))).withColumn("scalar", F.try_divide(F.col("kc"), F.col("share") * F.col("kl")))
    return s.select("h", F.round("scalar", 6).alias("scalar"), F.round(F.try_divide("kc", "kl"), 6).alias("required"), F.round(F.avg("scalar").over(Window.partitionBy()), 6).alias("mean_scalar"))


#: Shares of the curtailable part that are had, a margin of the peak, and a share of hours.
SHARES, HALF_MARGIN, HALF_BUDGET = 20, 0.05, 0.005
HALF = f"""{SCREEN.split(', g AS (SELECT margin')[0]}, pk AS (SELECT max(d) * {1 + HALF_MARGIN} AS cap, count(*) AS n FROM x), rm AS (SELECT i, s, c, cap - d AS room FROM x, pk), st AS (SELECT room / s AS q FROM (SELECT *, row_number() OVER (ORDER BY room / s) AS r FROM rm WHERE s > 0), pk WHERE r = CAST(floor(round({HALF_BUDGET} * n, 6)) AS BIGINT) + 1),
hq AS (SELECT q, min(CASE WHEN s > q * c THEN room / (s - q * c) END) AS hard FROM rm, (SELECT range / {SHARES}.0 AS q FROM range(0, {SHARES + 1})) GROUP BY q), h2 AS (SELECT min(room / (0.8 * s)) AS hard FROM rm WHERE s > 0), nf AS (SELECT min(room / s) AS y FROM rm WHERE s > 0),
ld AS (SELECT hq.q, least(hard, (SELECT q FROM st), 20000) AS y FROM hq), wa AS (SELECT unnest(['half_gain_q', 'break_even_q']) AS what, unnest([((SELECT y FROM ld WHERE q = 1) + (SELECT y FROM nf)) / 2, (SELECT least(hard, (SELECT q FROM st), 20000) FROM h2)]) AS want),
sg AS (SELECT *, lead(q) OVER (ORDER BY q) AS nq, lead(y) OVER (ORDER BY q) AS ny FROM ld)"""


@query(f"{HALF} SELECT what, round(want, 4) AS want, round((SELECT min(q + (nq - q) * (want - y) / (ny - y)) FROM sg WHERE y < want AND ny >= want), 6) AS q FROM wa")
def half_gain_share(spark, sf_dir):
    """The share of the curtailable part at which half of what it gains is had, and the share that gives as much as a
    fifth of the load would, both on the line between grid points; load and system are the tables' own."""
    hours = screened(spark, sf_dir)[0]
    cap = hours.agg((F.max("d") * (1 + HALF_MARGIN)).alias("cap"), F.count("*").alias("n"))
    x = hours.crossJoin(cap).withColumn("room", F.col("cap") - F.col("d"))
    stat = x.where("s > 0").select("n", (F.col("room") / F.col("s")).alias("stat")).withColumn("r", F.row_number().over(Window.orderBy("stat"))).where(F.col("r") == F.floor(F.round(HALF_BUDGET * F.col("n"), 6)) + 1).select("stat")
    grid = F.explode(F.array(*[F.lit(i / SHARES) for i in range(SHARES + 1)])).alias("q")
    hard = x.select("s", "c", "room", grid).groupBy("q").agg(F.min(F.when(F.col("s") > F.col("q") * F.col("c"), F.col("room") / (F.col("s") - F.col("q") * F.col("c")))).alias("hard"))
    load = hard.crossJoin(stat).select("q", F.least("hard", "stat", F.lit(20000.0)).alias("y"))
    own = x.where("s > 0").agg(F.min(F.col("room") / (0.8 * F.col("s"))).alias("hard"), F.min(F.col("room") / F.col("s")).alias("rigid")).crossJoin(stat)
    ends = own.crossJoin(load.where("q = 1").select(F.col("y").alias("full"))).select(((F.col("full") + F.col("rigid")) / 2).alias("half_gain_q"), F.least("hard", "stat", F.lit(20000.0)).alias("break_even_q"))
    want = ends.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("want")) for c in ("half_gain_q", "break_even_q")])).alias("x")).select("x.*")
    w = Window.orderBy("q")
    lines = load.withColumns({"nq": F.lead("q").over(w), "ny": F.lead("y").over(w)})
    at = lines.crossJoin(want).where("y < want AND ny >= want").groupBy("what").agg(F.min(F.col("q") + (F.col("nq") - F.col("q")) * (F.col("want") - F.col("y")) / (F.col("ny") - F.col("y"))).alias("q"))
    return want.join(at, "what", "left").select("what", F.round("want", 4).alias("want"), F.round("q", 6).alias("q"))


# synchrony and covariance


def resid_sql(unit: str, source: str) -> str:
    """CTE rs (unit, t, r): residuals of zero-filled series of a unit."""
    return f"""un AS (SELECT DISTINCT {unit} AS unit FROM {source}), pl AS (SELECT un.unit, s.t, coalesce(sum(w), 0) AS v FROM spine s CROSS JOIN un LEFT JOIN (SELECT {unit} AS unit, t, w FROM {source}) x ON x.t = s.t AND x.unit = un.unit GROUP BY un.unit, s.t),
ct AS (SELECT *, v - CASE WHEN count(v) OVER w >= 24 THEN avg(v) OVER w END AS d, t % 24 + 24 * ((t // 24) % 7) AS how FROM pl WINDOW w AS (PARTITION BY unit ORDER BY t ROWS BETWEEN 84 PRECEDING AND 84 FOLLOWING)), rs AS (SELECT unit, t, d - avg(d) OVER (PARTITION BY unit, how) AS r FROM ct)"""


LEVELS = [("priority in type", "cluster_id || '|' || job_type || '|' || priority_class", r"regexp_replace(unit, '\|[^|]*$', '')"), ("type in cluster", "cluster_id || '|' || job_type", r"regexp_replace(unit, '\|[^|]*$', '')"), ("cluster in fleet", "cluster_id", "'fleet'")]


def level_sql(name: str, unit: str, parent: str) -> str:
    return f"""(WITH {resid_sql(unit, 'tele')}, x AS (SELECT unit, {parent} AS parent, t, r FROM rs WHERE r IS NOT NULL), s AS (SELECT parent, stddev_samp(z) AS s FROM (SELECT parent, t, sum(r) AS z FROM x GROUP BY ALL) GROUP BY parent), q AS (SELECT parent, sum(q) AS q, count(*) AS units FROM (SELECT parent, unit, var_samp(r) AS q FROM x GROUP BY ALL) GROUP BY parent) SELECT '{name}' AS level, count(*) AS parents, sum(units)::BIGINT AS units, round(avg(s / sqrt(q)), 6) AS ratio FROM s JOIN q USING (parent) WHERE q > 0)"""


@query(f"WITH {FLEET} " + " UNION ALL ".join(level_sql(*x) for x in LEVELS))
def sync_levels(spark, sf_dir):
    """How far parts move together within their parents, for three pairs of levels."""
    tele = telemetry(spark, sf_dir)
    out = None
    for name, unit, parent in LEVELS:
        s = lanes(tele.withColumn("unit", F.expr(unit)), unit="unit").withColumn("v", F.coalesce("v", F.lit(0.0)))
        x = deseasoned(s, ["unit"]).select("unit", F.expr(parent.replace("\\", "\\\\")).alias("parent"), "t", "r").where("r is not null")
        total = x.groupBy("parent", "t").agg(F.sum("r").alias("z")).groupBy("parent").agg(F.stddev_samp("z").alias("s"))
        own = x.groupBy("parent", "unit").agg(F.var_samp("r").alias("q")).groupBy("parent").agg(F.sum("q").alias("q"), F.count("*").alias("units")).where("q > 0")
        one = total.join(own, "parent").agg(F.count("*").alias("parents"), F.sum("units").alias("units"), F.round(F.avg(F.col("s") / F.sqrt("q")), 6).alias("ratio")).withColumn("level", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {RESID}, ok AS (SELECT t FROM res GROUP BY t HAVING count(r) = (SELECT count(DISTINCT cluster_id) FROM res)), x AS (SELECT res.* FROM res JOIN ok USING (t)), cc AS (SELECT avg(c) AS rho FROM (SELECT corr(a.r, b.r) AS c FROM x a JOIN x b ON a.t = b.t AND a.cluster_id < b.cluster_id GROUP BY a.cluster_id, b.cluster_id)), n AS (SELECT count(DISTINCT cluster_id) AS n FROM x), m AS (SELECT stddev_samp(z) AS s FROM (SELECT t, sum(r) AS z FROM x GROUP BY t)), v AS (SELECT sum(q) AS q FROM (SELECT var_samp(r) AS q FROM x GROUP BY cluster_id)) SELECT n, round(rho, 6) AS rho, round(sqrt(1 + (n - 1) * rho), 6) AS equal_weight, round(s / sqrt(q), 6) AS measured FROM cc, n, m, v")
def equal_weight_identity(spark, sf_dir):
    """What the mean correlation alone would make of the ratio, and what it is."""
    x = covariance.complete(residuals(spark, sf_dir), "cluster_id")
    rho = covariance.pairs(x, "cluster_id", "r").groupBy("a", "b").agg(F.corr("x", "y").alias("c")).agg(F.avg("c").alias("rho"))
    n = x.agg(F.countDistinct("cluster_id").alias("n"))
    s = x.groupBy("t").agg(F.sum("r").alias("z")).agg(F.stddev_samp("z").alias("s"))
    q = x.groupBy("cluster_id").agg(F.var_samp("r").alias("q")).agg(F.sum("q").alias("q"))
    return rho.crossJoin(n).crossJoin(s).crossJoin(q).select("n", F.round("rho", 6).alias("rho"), F.round(F.sqrt(1 + (F.col("n") - 1) * F.col("rho")), 6).alias("equal_weight"), F.round(F.col("s") / F.sqrt("q"), 6).alias("measured"))


MASKED = f"""{RESID}, hi AS (SELECT t, bool_and(coalesce(v >= 0.02 * mx, false)) AS high, t BETWEEN any_value(lo) + 168 AND any_value(lo) + any_value(n) - 169 AS trim FROM (SELECT *, max(v) OVER (PARTITION BY cluster_id) AS mx FROM res), span GROUP BY t),
rr AS (SELECT unnest(['raw', 'deseason']) AS kind, unnest([v, r]) AS r, cluster_id, t FROM res), mk AS (SELECT t, unnest(['full', 'trim', 'allocated', 'both']) AS mask, unnest([true, trim, high, trim AND high]) AS inside FROM hi), xx AS (SELECT mask, kind, cluster_id, t, r FROM rr JOIN mk USING (t) WHERE inside),
okk AS (SELECT mask, kind, t FROM xx GROUP BY ALL HAVING count(r) = (SELECT count(DISTINCT cluster_id) FROM res)), yy AS (SELECT xx.* FROM xx JOIN okk USING (mask, kind, t)), cv AS (SELECT a.mask, a.kind, a.cluster_id AS a, b.cluster_id AS b, covar_pop(a.r, b.r) AS c, count(*) AS hours FROM yy a JOIN yy b ON a.t = b.t AND a.mask = b.mask AND a.kind = b.kind GROUP BY ALL),
nu AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS i FROM (SELECT DISTINCT cluster_id FROM res)), po AS (SELECT p, cluster_id FROM (SELECT range AS p FROM range(1, CAST(2 ** (SELECT count(*) FROM nu) AS BIGINT))), nu WHERE (p >> i) & 1 = 1 AND (bit_count(p) = 4 OR bit_count(p) = (SELECT count(*) FROM nu)))"""


@query(f"WITH {MASKED}, z AS (SELECT mask, kind, p, max(hours) AS hours, sum(c) AS v, sum(c) FILTER (a = b) AS s2, sum(sqrt(c)) FILTER (a = b) AS s1 FROM po x JOIN po y USING (p) JOIN cv ON cv.a = x.cluster_id AND cv.b = y.cluster_id GROUP BY ALL) SELECT mask, kind, p, hours, round(sqrt(v / s2), 6) AS ratio, round((v - s2) / (s1 * s1 - s2), 6) AS rho_w FROM z WHERE hours >= 24")
def cov_mask_grid(spark, sf_dir):
    """Ratio and weighted correlation of every four clusters and of all, by residual and by which hours count."""
    res = residuals(spark, sf_dir)
    hi = res.withColumn("mx", F.max("v").over(Window.partitionBy("cluster_id"))).groupBy("t").agg(F.bool_and(F.coalesce(F.col("v") >= 0.02 * F.col("mx"), F.lit(False))).alias("high")).crossJoin(span(res)).withColumn("trim", F.expr("t BETWEEN lo + 168 AND lo + n - 169"))
    masks = {"full": F.lit(True), "trim": F.col("trim"), "allocated": F.col("high"), "both": F.col("trim") & F.col("high")}
    mk = hi.select("t", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), e.alias("inside")) for k, e in masks.items()])).alias("m")).where("m.inside").select("t", "m.mask")
    rr = res.select("cluster_id", "t", F.explode(F.array(F.struct(F.lit("raw").alias("kind"), F.col("v").alias("r")), F.struct(F.lit("deseason").alias("kind"), F.col("r")))).alias("x")).select("cluster_id", "t", "x.*")
    units = res.agg(F.countDistinct("cluster_id").alias("units"))
    x = rr.join(mk, "t")
    good = x.groupBy("mask", "kind", "t").agg(F.count("r").alias("have")).crossJoin(units).where("have = units").select("mask", "kind", "t")
    cv = covariance.pairs(x.join(good, ["mask", "kind", "t"]), "cluster_id", "r", ["mask", "kind"], every=True).groupBy("mask", "kind", "a", "b").agg(F.covar_pop("x", "y").alias("c"), F.count("*").alias("hours")).where("hours >= 24")
    po = covariance.subsets(res, "cluster_id").crossJoin(units).where("n = 4 or n = units").select("p", "cluster_id")
    both = po.withColumnRenamed("cluster_id", "a").join(po.withColumnRenamed("cluster_id", "b"), "p").join(cv, ["a", "b"])
    own = F.col("a") == F.col("b")
    z = both.groupBy("mask", "kind", "p").agg(F.max("hours").alias("hours"), F.sum("c").alias("v"), F.sum(F.when(own, F.col("c"))).alias("s2"), F.sum(F.when(own, F.sqrt("c"))).alias("s1"))
    return z.select("mask", "kind", "p", "hours", F.round(F.sqrt(F.col("v") / F.col("s2")), 6).alias("ratio"), F.round((F.col("v") - F.col("s2")) / (F.col("s1") * F.col("s1") - F.col("s2")), 6).alias("rho_w"))


@query(f"WITH {RESID}, {blocks_sql(200, 168, 41)}, ok AS (SELECT t FROM res GROUP BY t HAVING count(r) = (SELECT count(DISTINCT cluster_id) FROM res)), fs AS (SELECT t, sum(r) AS z FROM res JOIN ok USING (t) GROUP BY t), v AS (SELECT rep, var_pop(z) AS v FROM ix JOIN fs ON fs.t = src GROUP BY rep), o AS (SELECT rep, sum(q) AS q FROM (SELECT rep, var_pop(r) AS q FROM ix JOIN res ON res.t = src JOIN ok ON ok.t = src GROUP BY rep, cluster_id) GROUP BY rep), f AS (SELECT sqrt(v / q) AS x FROM v JOIN o USING (rep)) SELECT count(*) AS reps, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.95), 6) AS p95, quantile_cont(x, 0.05) > 1 OR quantile_cont(x, 0.95) < 1 AS excludes_one FROM f")
def sync_interval(spark, sf_dir):
    """A band of the ratio over weeks drawn again, and whether it leaves out independence."""
    res = residuals(spark, sf_dir)
    x = covariance.complete(res, "cluster_id").withColumnRenamed("t", "src")
    ix = block_index(span(res), 200, 168, 41)
    v = x.groupBy("src").agg(F.sum("r").alias("z")).join(ix, "src").groupBy("rep").agg(F.var_pop("z").alias("v"))
    q = x.join(ix, "src").groupBy("rep", "cluster_id").agg(F.var_pop("r").alias("q")).groupBy("rep").agg(F.sum("q").alias("q"))
    b = v.join(q, "rep").withColumn("x", F.sqrt(F.col("v") / F.col("q"))).agg(F.count("*").alias("reps"), F.percentile("x", F.array(F.lit(0.05), F.lit(0.95))).alias("b"))
    return b.select("reps", F.round(F.col("b")[0], 6).alias("p5"), F.round(F.col("b")[1], 6).alias("p95"), ((F.col("b")[0] > 1) | (F.col("b")[1] < 1)).alias("excludes_one"))


# summaries


HEAD = f"{CHAIN}, mf AS ({m_sql('(SELECT t, sum(w) AS v FROM tele RIGHT JOIN spine USING (t) GROUP BY t)', [4])})"


@query(f"{HEAD} SELECT 'mean_load' AS metric, round((SELECT avg(l) FROM fl), 4) AS value UNION ALL SELECT 'k_4h_95', round(quantile_cont(m, 0.05), 4) FROM mf UNION ALL SELECT 'a_scope', round(p1 / nullif(p0, 0), 4) FROM c UNION ALL SELECT 'a_persist', round(p2 / nullif(p1, 0), 4) FROM c UNION ALL SELECT 'a_coinc', round(p3 / nullif(p2, 0), 4) FROM c")
def headline(spark, sf_dir):
    """The figures of other queries as rows of one table."""
    tele = telemetry(spark, sf_dir)
    f = fleet(tele)
    one = lambda df, name, value: df.select(F.lit(name).alias("metric"), F.round(value, 4).alias("value"))
    c = chain(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.try_divide(a, b), 4).alias("value")) for n, a, b in (("a_scope", "p1", "p0"), ("a_persist", "p2", "p1"), ("a_coinc", "p3", "p2"))])).alias("x")).select("x.*")
    return one(f.agg(F.avg("v").alias("v")), "mean_load", F.col("v")).unionByName(one(firm(f, [4], [0.95]), "k_4h_95", F.col("k"))).unionByName(c)
