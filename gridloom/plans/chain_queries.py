"""Bootstraps, ensembles, controls and nulls of the chain of factors; alignments of the screen; splits of backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import power
from gridloom.operators import chain, events, fitting, replicates, resample
from gridloom.operators.facility import banded
from gridloom.operators.resample import drawn, drawn_sql, uniform, uniform_sql
from gridloom.operators.rolling import filled, firm, fleet, lanes, minima, over, quantile, span, spine, supported, trend
from gridloom.plans.firm_queries import TWO, WINDOWS, m_sql, tested, two
from gridloom.plans.model_queries import BLOCK, N_NULL, STATS, ZERO, ZERO_LP, blocks_sql, shifts_sql, statistics, zero
from gridloom.plans.registry import query
from gridloom.sources.tables import FLEET, LANES, table, telemetry


def trend_sql(source: str, keys: str) -> str:
    """CTEs tw and tl (keys, t, v, trend) from a panel."""
    return f"""tw AS (SELECT *, CASE WHEN count(v) OVER w >= 24 THEN avg(v) OVER w END AS x FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY t ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)),
tl AS (SELECT {keys}, t, v, coalesce(first_value(x IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(x IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS trend FROM tw)"""


def rolled_sql(keys: str = "", clip: bool = True) -> str:
    """CTEs rl and de (keys, draw, t, v) from tl, nm and sh."""
    cols = f"{keys}, " if keys else ""
    x = "greatest(sum(r + trend), 0)" if clip else "sum(r + trend)"
    return f"""rl AS (SELECT {cols}draw, cluster_id, lo + (t - lo + shift) % n AS t, v - trend AS r FROM tl JOIN nm USING (cluster_id) JOIN sh USING (u), span),
de AS (SELECT {cols}draw, t, CASE WHEN count(r + trend) = count(*) THEN {x} END AS v FROM rl JOIN (SELECT {cols}cluster_id, t, trend FROM tl) USING ({cols}cluster_id, t) GROUP BY ALL)"""


def levels_sql(source: str, hours: list[int], keys: str = "") -> str:
    """CTE lv (keys, h, p1, p2, p3)."""
    cols = f"{keys}, " if keys else ""
    using = f"USING ({cols}h)"
    first = f"JOIN (SELECT {cols}avg(v) AS p1 FROM su GROUP BY {keys}) USING ({keys})" if keys else "CROSS JOIN (SELECT avg(v) AS p1 FROM su)"
    return f"""su AS (SELECT {cols}t, sum(v) AS v FROM {source} GROUP BY ALL), mi AS ({m_sql('de', hours, f'{cols}draw')}), ma AS ({m_sql('su', hours, keys)}),
lv AS (SELECT {cols}h, p1, p2, p3 FROM (SELECT {cols}h, avg(k) AS p2 FROM (SELECT {cols}draw, h, quantile_cont(m, 0.05) AS k FROM mi GROUP BY ALL) GROUP BY ALL) JOIN (SELECT {cols}h, quantile_cont(m, 0.05) AS p3 FROM ma GROUP BY ALL) {using} {first})"""


def bands_sql(source: str, value: str, keys: str, digits: int = 4) -> str:
    return f"SELECT {keys}, " + ", ".join(f"round(quantile_cont({value}, {p / 100}), {digits}) AS p{p}" for p in (5, 50, 95)) + f" FROM {source} GROUP BY ALL"


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, t, v): load of low priority, 0 in hours without any."""
    return zero(lanes(telemetry(spark, sf_dir), F.when(F.col("priority_class") == "LP", F.col("w"))))


#: Replicates of the chain, and draws of the benchmark within each.
CHAIN_REPS, CHAIN_DRAWS = 20, 4


@query(f"WITH {ZERO_LP}, {blocks_sql(CHAIN_REPS, BLOCK, 6)}, pn AS (SELECT rep, cluster_id, lo + pos AS t, CASE WHEN (pos + 1) % {BLOCK} <> 0 THEN v END AS v FROM ix JOIN lanes ON lanes.t = src, span), {shifts_sql(CHAIN_DRAWS, 1, 6)}, {trend_sql('pn', 'rep, cluster_id')}, {rolled_sql('rep')}, {levels_sql('pn', [1, 4], 'rep')}, f AS (SELECT h, unnest(['a_persist', 'a_coinc']) AS factor, unnest([p2 / nullif(p1, 0), p3 / nullif(p2, 0)]) AS x FROM lv) {bands_sql('f', 'x', 'h, factor')}")
def chain_bootstrap(spark, sf_dir):
    """The factors over blocks of weeks drawn again, all clusters alike; the last hour of a block is a gap."""
    f = chain.factors(replicates.chain_replicates(part(spark, sf_dir), "cluster_id", [1, 4], [0.05], CHAIN_DRAWS, CHAIN_REPS, BLOCK, 6, own=False))
    return banded(f.unpivot(["rep", "h"], ["a_persist", "a_coinc"], "factor", "x"), "x", ["h", "factor"], 4)


#: The bands' replicates, and draws of the benchmark in each.
BAND_REPS, BAND_DRAWS, BAND_BLOCKS = 1000, 2, ((168, 35), (336, 36))


def band_sql(block: int, seed: int) -> str:
    """The chain of every replicate of a block length."""
    return f"""SELECT {block}::BIGINT AS block, h, p1, p2, p3 FROM (WITH {blocks_sql(BAND_REPS, block, seed)}, pn AS (SELECT rep, cluster_id, lo + pos AS t, CASE WHEN (pos + 1) % {block} <> 0 THEN v END AS v FROM ix JOIN lanes ON lanes.t = src, span),
nm AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS u FROM (SELECT DISTINCT cluster_id FROM lanes)), sh AS (SELECT rep, draw, u, {drawn_sql(f'(rep * {BAND_DRAWS} + draw)', 'u', seed)} % n AS shift FROM nm, (SELECT range AS rep FROM range({BAND_REPS})), (SELECT range AS draw FROM range({BAND_DRAWS})), span), {trend_sql('pn', 'rep, cluster_id')},
rl AS (SELECT rep, draw, cluster_id, lo + (t - lo + shift) % n AS t, v - trend AS r FROM tl JOIN nm USING (cluster_id) JOIN sh USING (rep, u), span),
de AS (SELECT rep, draw, t, CASE WHEN count(r + trend) = count(*) THEN greatest(sum(r + trend), 0) END AS v FROM rl JOIN (SELECT rep, cluster_id, t, trend FROM tl) USING (rep, cluster_id, t) GROUP BY ALL), {levels_sql('pn', [1, 4, 24], 'rep')} SELECT * FROM lv)"""


BANDS = f"{ZERO_LP}, p0 AS (SELECT 0.5 * avg(l) AS p0 FROM (SELECT sum(w) AS l FROM tele GROUP BY t)), lw AS ({' UNION ALL '.join(band_sql(*x) for x in BAND_BLOCKS)}), f AS (SELECT block, h, unnest(['a_scope', 'a_persist', 'a_coinc', 'shapley_scope', 'shapley_duration', 'shapley_coincidence']) AS factor, unnest([p1 / nullif(p0, 0), p2 / nullif(p1, 0), p3 / nullif(p2, 0), p1 / nullif(p0, 0), sqrt(p2 * p3) / nullif(p1, 0), sqrt(p3 / nullif(p2, 0))]) AS x FROM lw, p0)"


@query(f"WITH {BANDS} {bands_sql('f', 'x', 'block, h, factor')}")
def chain_bands(spark, sf_dir):
    """Bands of the factors, and of their Shapley shares, over 1,000 replicates of each block length."""
    p, tele = part(spark, sf_dir), telemetry(spark, sf_dir)
    p0 = tele.groupBy("t").agg(F.sum("w").alias("l")).agg((0.5 * F.avg("l")).alias("p0"))
    rows = None
    for block, seed in BAND_BLOCKS:
        one = replicates.chain_replicates(p, "cluster_id", [1, 4, 24], [0.05], BAND_DRAWS, BAND_REPS, block, seed).withColumn("block", F.lit(block).cast("long"))
        rows = one if rows is None else rows.unionByName(one)
    f = chain.shares(chain.factors(rows.crossJoin(p0)))
    names = ["a_scope", "a_persist", "a_coinc", "shapley_scope", "shapley_duration", "shapley_coincidence"]
    return banded(f.unpivot(["block", "rep", "h"], names, "factor", "x"), "x", ["block", "h", "factor"], 4)


SURROGATES = 200


@query()
def surrogate_coincidence(spark, sf_dir):
    """The coincidence factor of panels whose clusters keep their trends and spectra but are independent: about 1."""
    z = zero(lanes(telemetry(spark, sf_dir)))
    lv = replicates.replicated(z, "cluster_id", SURROGATES, replicates.surrogate_levels([1, 4, 24], 0.05, 20, 37), "rep long, h long, p2 double, p3 double")
    x = lv.withColumn("x", F.try_divide("p3", "p2"))
    mean = x.groupBy("h").agg(F.round(F.avg("x"), 4).alias("mean"), F.count("x").alias("panels"))
    return banded(x, "x", ["h"], 4).join(mean, "h")


MEMBERS = 30
MEMBERS_SQL = f"mb AS (SELECT member, CASE WHEN member = 0 THEN 0.2 ELSE 0.15 + 0.1 * {uniform_sql('member', '0', 21)} END AS phi, CASE WHEN member = 0 THEN 0.3 ELSE 0.1 + 0.4 * {uniform_sql('member', '1', 21)} END AS null_level FROM (SELECT range AS member FROM range({MEMBERS})))"
ENSEMBLE = f"""{LANES}, {'st AS' + STATS.split(', st AS')[1]}, {MEMBERS_SQL},
ac AS (SELECT member, cluster_id, t, sum({power.active_sql('phi', 'null_level')}) AS a FROM st, mb WHERE {power.LAYER_SQL} = 'curtail' GROUP BY ALL),
pn AS (SELECT member, cluster_id, l.t, coalesce(a, 0) AS v FROM lanes l CROSS JOIN (SELECT member FROM mb) LEFT JOIN ac USING (member, cluster_id, t)), {shifts_sql(CHAIN_DRAWS, 1, 22)}, {trend_sql('pn', 'member, cluster_id')}, {rolled_sql('member')}, {levels_sql('pn', [1, 4, 24], 'member')},
f AS (SELECT member, h, p2 / nullif(p1, 0) AS a_persist, p3 / nullif(p2, 0) AS a_coinc FROM lv)"""


@query(f"WITH {ENSEMBLE}, g AS (SELECT member, max(a_persist) FILTER (h = 1) >= max(a_persist) FILTER (h = 4) AND max(a_persist) FILTER (h = 4) >= max(a_persist) FILTER (h = 24) AS mp, max(a_coinc) FILTER (h = 1) >= max(a_coinc) FILTER (h = 4) AND max(a_coinc) FILTER (h = 4) >= max(a_coinc) FILTER (h = 24) AS mc, bool_and(a_persist < 1 AND a_coinc < 1) AS lt FROM f GROUP BY member) SELECT count(*) AS members, round(avg(mp::INT), 6) AS persist_monotone, round(avg(mc::INT), 6) AS coinc_monotone, round(avg(lt::INT), 6) AS all_below_one FROM g")
def ensemble_structure(spark, sf_dir):
    """How many members of a parameter ensemble keep each factor below one and falling with duration."""
    mb = spark.range(MEMBERS).select(F.col("id").alias("member"), F.when(F.col("id") == 0, F.lit(0.2)).otherwise(0.15 + 0.1 * uniform("id", "0", 21)).alias("phi"), F.when(F.col("id") == 0, F.lit(0.3)).otherwise(0.1 + 0.4 * uniform("id", "1", 21)).alias("null_level"))
    ac = statistics(spark, sf_dir).where(power.layer() == "curtail").crossJoin(mb).withColumn("a", power.energy(F.col("phi"), F.col("null_level"))[1]).groupBy("member", "cluster_id", "t").agg(F.sum("a").alias("a"))
    grid = lanes(telemetry(spark, sf_dir)).select("cluster_id", "t").crossJoin(mb.select("member"))
    pn = grid.join(ac, ["member", "cluster_id", "t"], "left").select("member", "cluster_id", "t", F.coalesce("a", F.lit(0.0)).alias("v"))
    f = chain.factors(replicates.by_member(pn, "cluster_id", "member", replicates.chain_levels(None, [1, 4, 24], [0.05], CHAIN_DRAWS, 22), replicates.LEVELS)).withColumnRenamed("rep", "member")
    at = lambda c, h: F.max(F.when(F.col("h") == h, F.col(c)))
    falls = lambda c: (at(c, 1) >= at(c, 4)) & (at(c, 4) >= at(c, 24))
    g = f.groupBy("member").agg(falls("a_persist").alias("mp"), falls("a_coinc").alias("mc"), F.bool_and((F.col("a_persist") < 1) & (F.col("a_coinc") < 1)).alias("lt"))
    share = lambda c, n: F.round(F.avg(F.col(c).cast("int")), 6).alias(n)
    return g.agg(F.count("*").alias("members"), share("mp", "persist_monotone"), share("mc", "coinc_monotone"), share("lt", "all_below_one"))


SECOND = f"""ss AS (SELECT o_orderpriority AS cluster_id, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 7.0 AS a, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7.0 AS b, l_quantity AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cc AS (SELECT cluster_id, t, sum(w * (least(b, t + 1) - greatest(a, t))) AS v FROM (SELECT *, unnest(range(CAST(floor(a) AS BIGINT), CAST(ceil(b) AS BIGINT))) AS t FROM ss WHERE b > a AND w > 0) GROUP BY ALL), span AS (SELECT min(t) AS lo, max(t) - min(t) + 1 AS n FROM cc),
lanes AS (SELECT cluster_id, g.t, coalesce(v, 0) AS v FROM (SELECT DISTINCT cluster_id FROM cc) CROSS JOIN (SELECT unnest(range(lo, lo + n)) AS t FROM span) g LEFT JOIN cc USING (cluster_id, t)), {shifts_sql(N_NULL, 1, 23)}, {trend_sql('lanes', 'cluster_id')}, {rolled_sql()}, {levels_sql('lanes', [1, 4])}"""


@query(f"WITH {SECOND} SELECT h, round(p3 / nullif(p2, 0), 4) AS a_coinc FROM lv")
def second_panel_coincidence(spark, sf_dir):
    """The coincidence factor of another panel: open orders by priority, by week, from their sessions."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.datediff(c, F.lit("1995-01-01").cast("date")) / 7.0
    s = j.select(F.col("o_orderpriority").alias("cluster_id"), day("o_orderdate").alias("a"), day("l_shipdate").alias("b"), F.col("l_quantity").alias("w"))
    x = events.sessions(s, "a", "b", "w", ["cluster_id"])
    p = x.select("cluster_id").distinct().crossJoin(spine(x)).join(x, ["cluster_id", "t"], "left").select("cluster_id", "t", F.coalesce("x", F.lit(0.0)).alias("v"))
    f = chain.factors(chain.levels(p, "cluster_id", [1, 4], 0.05, N_NULL, 23))
    return f.select("h", F.round("a_coinc", 4).alias("a_coinc"))


SINGLE_DRAWS = 20


@query(f"WITH {ZERO}, {shifts_sql(SINGLE_DRAWS, 1, 24)}, {trend_sql('lanes', 'cluster_id')}, rl AS (SELECT draw, cluster_id, lo + (t - lo + shift) % n AS t, v - trend AS r FROM tl JOIN nm USING (cluster_id) JOIN sh USING (u), span), x AS (SELECT draw, cluster_id, t, r + trend AS x FROM rl JOIN (SELECT cluster_id, t, trend FROM tl) USING (cluster_id, t)), y AS (SELECT draw, cluster_id, t, greatest(x, 0) AS v FROM x), m AS ({m_sql('y', [1, 24], 'draw, cluster_id')}), k AS (SELECT cluster_id, h, avg(k) AS k FROM (SELECT draw, cluster_id, h, quantile_cont(m, 0.05) AS k FROM m GROUP BY ALL) GROUP BY ALL), o AS ({m_sql('lanes', [1, 24], 'cluster_id')}), ko AS (SELECT cluster_id, h, quantile_cont(m, 0.05) AS k FROM o GROUP BY ALL), ne AS (SELECT cluster_id, avg((x < -1e-9)::INT) AS negative, avg(x) AS mean_after FROM x GROUP BY 1), be AS (SELECT cluster_id, avg(v) AS mean_before FROM lanes GROUP BY 1) SELECT cluster_id, h, round(mean_before, 4) AS mean_before, round(mean_after, 4) AS mean_after, round(negative, 6) AS negative, round(ko.k, 4) AS before, round(k.k, 4) AS after FROM k JOIN ko USING (cluster_id, h) JOIN ne USING (cluster_id) JOIN be USING (cluster_id)")
def single_cluster_control(spark, sf_dir):
    """The procedure on one cluster at a time, where there is no coincidence to take away."""
    s = trend(zero(lanes(telemetry(spark, sf_dir))), 84, 83, 24, ["cluster_id"])
    own = resample.numbered(s, "cluster_id").crossJoin(spark.range(SINGLE_DRAWS).withColumnRenamed("id", "draw")).crossJoin(span(s)).withColumn("shift", drawn("draw", "u", 24) % F.col("n"))
    rolled = s.join(own, "cluster_id").select("draw", "cluster_id", (F.col("lo") + (F.col("t") - F.col("lo") + F.col("shift")) % F.col("n")).alias("t"), (F.col("v") - F.col("trend")).alias("r"))
    x = rolled.join(s.select("cluster_id", "t", "trend"), ["cluster_id", "t"]).select("draw", "cluster_id", "t", (F.col("r") + F.col("trend")).alias("x"))
    k = minima(x.withColumn("v", F.greatest("x", F.lit(0.0))), [1, 24], ["draw", "cluster_id"]).groupBy("draw", "cluster_id", "h").agg(quantile("m", 0.05).alias("k")).groupBy("cluster_id", "h").agg(F.avg("k").alias("after"))
    ko = firm(s, [1, 24], [0.95], ["cluster_id"]).select("cluster_id", "h", F.col("k").alias("before"))
    ne = x.groupBy("cluster_id").agg(F.avg((F.col("x") < -1e-9).cast("int")).alias("negative"), F.avg("x").alias("mean_after"))
    out = k.join(ko, ["cluster_id", "h"]).join(ne, "cluster_id").join(s.groupBy("cluster_id").agg(F.avg("v").alias("mean_before")), "cluster_id")
    return out.select("cluster_id", "h", *[F.round(c, 6 if c == "negative" else 4).alias(c) for c in ("mean_before", "mean_after", "negative", "before", "after")])


@query(f"WITH {ZERO}, {shifts_sql(N_NULL, 1, 25)}, {trend_sql('lanes', 'cluster_id')}, {rolled_sql(clip=False)}, d AS (SELECT draw, avg((v < -1e-9)::INT) AS hours, abs(sum(least(v, 0))) / (sum(greatest(v, 0)) + abs(sum(least(v, 0)))) AS energy, avg(greatest(v, 0)) AS mean FROM de WHERE v IS NOT NULL GROUP BY draw) SELECT count(*) AS draws, round(avg(hours), 6) AS hours_mean, round(max(hours), 6) AS hours_max, round(avg(energy), 6) AS energy_mean, round(max(energy), 6) AS energy_max, round(avg(mean), 4) AS mean FROM d")
def truncation_control(spark, sf_dir):
    """How often, and by how much, sums of shifted residuals fall below zero before they are cut there."""
    s = trend(zero(lanes(telemetry(spark, sf_dir))), 84, 83, 24, ["cluster_id"])
    de = resample.decorrelated(s, "cluster_id", N_NULL, 25, clip=False).where("v is not null")
    low, high = F.abs(F.sum(F.least("v", F.lit(0.0)))), F.sum(F.greatest("v", F.lit(0.0)))
    d = de.groupBy("draw").agg(F.avg((F.col("v") < -1e-9).cast("int")).alias("hours"), (low / (high + low)).alias("energy"), F.avg(F.greatest("v", F.lit(0.0))).alias("mean"))
    return d.agg(F.count("*").alias("draws"), F.round(F.avg("hours"), 6).alias("hours_mean"), F.round(F.max("hours"), 6).alias("hours_max"), F.round(F.avg("energy"), 6).alias("energy_mean"), F.round(F.max("energy"), 6).alias("energy_max"), F.round(F.avg("mean"), 4).alias("mean"))


@query(f"WITH {ZERO}, {shifts_sql(200, 1, 26)}, {trend_sql('lanes', 'cluster_id')}, {rolled_sql()}, m AS ({m_sql('de', [1, 4, 24], 'draw')}), k AS (SELECT draw, h, quantile_cont(m, 0.05) AS k FROM m GROUP BY ALL), f AS (SELECT h, k / nullif(avg(k) OVER (PARTITION BY h), 0) AS x FROM k) {bands_sql('f', 'x', 'h')}")
def coincidence_null_band(spark, sf_dir):
    """The band that the coincidence factor would lie in if clusters were independent."""
    s = trend(zero(lanes(telemetry(spark, sf_dir))), 84, 83, 24, ["cluster_id"])
    k = minima(resample.decorrelated(s, "cluster_id", 200, 26), [1, 4, 24], ["draw"]).groupBy("draw", "h").agg(quantile("m", 0.05).alias("k"))
    return banded(k.withColumn("x", F.try_divide(F.col("k"), F.avg("k").over(Window.partitionBy("h")))), "x", ["h"], 4)


def _variant(mode: str, step: int, whole: bool) -> str:
    tl = "(SELECT cluster_id, t, v, 0.0::DOUBLE AS trend FROM lanes)" if whole else "tl"
    sh = shifts_sql(N_NULL, step, 27).split(", sh AS ")[1]
    return f"""SELECT '{mode}' AS mode, draw, t, CASE WHEN count(r + trend) = count(*) THEN greatest(sum(r + trend), 0) END AS v FROM (SELECT draw, cluster_id, lo + (t - lo + shift) % n AS t, v - trend AS r FROM {tl} JOIN nm USING (cluster_id) JOIN {sh} sh USING (u), span) JOIN (SELECT cluster_id, t, trend FROM {tl}) USING (cluster_id, t) GROUP BY ALL"""


MODES = [("free", 1, False), ("calendar", 24, False), ("week", 168, False), ("whole", 1, True)]


@query(f"WITH {ZERO}, {shifts_sql(N_NULL, 1, 27).split(', sh AS ')[0]}, {trend_sql('lanes', 'cluster_id')}, va AS ({' UNION ALL '.join(_variant(*x) for x in MODES)}), m AS ({m_sql('va', [1, 4], 'mode, draw')}), k AS (SELECT mode, draw, h, quantile_cont(m, 0.05) AS k FROM m GROUP BY ALL) SELECT mode, h, round(avg(k), 4) AS mean_of_quantiles, round(any_value(p), 4) AS pooled_quantile FROM k JOIN (SELECT mode, h, quantile_cont(m, 0.05) AS p FROM m GROUP BY ALL) USING (mode, h) GROUP BY ALL")
def shift_variants(spark, sf_dir):
    """The independent benchmark by how far series may be rolled, and by how its draws are put together."""
    z = zero(lanes(telemetry(spark, sf_dir)))
    s, raw = trend(z, 84, 83, 24, ["cluster_id"]), z.withColumn("trend", F.lit(0.0))
    out = None
    for mode, step, whole in MODES:
        m = minima(resample.decorrelated(raw if whole else s, "cluster_id", N_NULL, 27, step), [1, 4], ["draw"])
        k = m.groupBy("draw", "h").agg(quantile("m", 0.05).alias("k")).groupBy("h").agg(F.round(F.avg("k"), 4).alias("mean_of_quantiles"))
        one = k.join(m.groupBy("h").agg(F.round(quantile("m", 0.05), 4).alias("pooled_quantile")), "h").withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


PAIRED = f"{TWO}, {blocks_sql(200, BLOCK, 28)}, b AS (SELECT rep, pos AS t, v, c FROM ix JOIN two ON two.t = src), mc AS ({m_sql('b', [4], 'rep', 'c')}), ml AS ({m_sql('b', [4], 'rep')}), p AS (SELECT rep, quantile_cont(mc.m, 0.05) AS obs FROM mc GROUP BY rep), q AS (SELECT rep, quantile_cont(ml.m, 0.05) AS kl FROM ml GROUP BY rep), s AS (SELECT rep, avg(c) / avg(v) AS s FROM b GROUP BY rep), f AS (SELECT unnest(['observed', 'constant', 'ratio']) AS what, unnest([obs, s * kl, obs / nullif(s * kl, 0)]) AS x FROM p JOIN q USING (rep) JOIN s USING (rep))"


@query(f"WITH {PAIRED} {bands_sql('f', 'x', 'what')}")
def paired_bootstrap(spark, sf_dir):
    """The dependable part and its constant-share baseline on the same replicates; blocks are joined without gaps."""
    f = two(telemetry(spark, sf_dir))
    b = f.withColumnRenamed("t", "src").join(resample.block_index(span(f), 200, BLOCK, 28), "src").select("rep", F.col("pos").alias("t"), "v", "c")
    kc = firm(b.select("rep", "t", F.col("c").alias("v")), [4], [0.95], ["rep"]).select("rep", F.col("k").alias("observed"))
    kl = firm(b, [4], [0.95], ["rep"]).select("rep", F.col("k").alias("kl"))
    x = kc.join(kl, "rep").join(b.groupBy("rep").agg((F.avg("c") / F.avg("v")).alias("s")), "rep").withColumn("constant", F.col("s") * F.col("kl")).withColumn("ratio", F.try_divide("observed", "constant"))
    return banded(x.unpivot("rep", ["observed", "constant", "ratio"], "what", "x"), "x", ["what"], 4)


EXACT = f"ex AS (SELECT rep, j, least({BLOCK}, n - j * {BLOCK}) AS size, lo, n FROM (SELECT range AS rep FROM range(1000)), (SELECT lo, n, unnest(range((n + {BLOCK} - 1) // {BLOCK})) AS j FROM span)), ey AS (SELECT rep, lo + {drawn_sql('rep', 'j', 29)} % (n - size + 1) AS first, size FROM ex)"


@query(f"WITH {TWO}, {EXACT}, z AS (SELECT rep, v, c FROM ey JOIN two ON two.t >= first AND two.t < first + size WHERE v IS NOT NULL) SELECT rep, count(*) AS n, round(covar_pop(v, c), 4) AS cov FROM z GROUP BY rep")
def exact_block_moments(spark, sf_dir):
    """Covariances over blocks whose last is as short as it must be, from differences of running sums at two places."""
    f = two(telemetry(spark, sf_dir))
    known = F.col("v").isNotNull()
    run = over([], Window.unboundedPreceding, 0)
    terms = {"n": F.lit(1.0), "x": F.col("v"), "y": F.col("c"), "xy": F.col("v") * F.col("c")}
    sums = f.select((F.col("t") + 1).alias("t"), *[F.sum(F.when(known, e).otherwise(0.0)).over(run).alias(k) for k, e in terms.items()])
    zero_row = span(f).select(F.col("lo").alias("t"), *[F.lit(0.0).alias(k) for k in terms])
    sums = sums.unionByName(zero_row)
    ex = span(f).crossJoin(spark.range(1000).withColumnRenamed("id", "rep")).select("rep", "lo", "n", F.explode(F.expr(f"sequence(0L, (n + {BLOCK} - 1) div {BLOCK} - 1)")).alias("j")).withColumn("size", F.least(F.lit(BLOCK), F.col("n") - F.col("j") * BLOCK))
    ey = ex.withColumn("first", F.col("lo") + drawn("rep", "j", 29) % (F.col("n") - F.col("size") + 1))
    ends = ey.select("rep", F.explode(F.array(F.struct((F.col("first") + F.col("size")).alias("t"), F.lit(1).alias("sign")), F.struct(F.col("first").alias("t"), F.lit(-1).alias("sign")))).alias("e")).select("rep", "e.*")
    d = ends.join(sums, "t").groupBy("rep").agg(*[F.sum(F.col("sign") * F.col(k)).alias(k) for k in terms])
    return d.select("rep", F.round("n").cast("long").alias("n"), F.round(F.col("xy") / F.col("n") - F.col("x") / F.col("n") * F.col("y") / F.col("n"), 4).alias("cov"))


BIAS = f"{FLEET}, d AS (SELECT t, v, avg(v) OVER (ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS f FROM fleet)"


def circular_sql(block: int, seed: int) -> str:
    return f"SELECT {block} AS block, rep, lo + (source + i) % n AS src FROM (SELECT rep, j, {drawn_sql('rep', 'j', seed)} % n AS source, lo, n FROM (SELECT range AS rep FROM range(200)), (SELECT lo, n, unnest(range((n + {block} - 1) // {block})) AS j FROM span) WHERE n >= {block}), (SELECT range AS i FROM range({block})) WHERE j * {block} + i < n"


@query(f"WITH {BIAS}, ix AS ({circular_sql(168, 30)} UNION ALL {circular_sql(336, 31)}), e AS (SELECT block, rep, sum(f) / sum(v) - 1 AS bias FROM ix JOIN d ON d.t = src WHERE f IS NOT NULL AND v IS NOT NULL GROUP BY ALL) SELECT block::BIGINT AS block, round(quantile_cont(bias, 0.025), 6) AS low, round(quantile_cont(bias, 0.5), 6) AS mid, round(quantile_cont(bias, 0.975), 6) AS high FROM e GROUP BY block")
def bias_bootstrap(spark, sf_dir):
    """A forecast's bias over blocks of the calendar that may go over its end."""
    d = fleet(telemetry(spark, sf_dir)).withColumn("f", F.avg("v").over(over([], -24, -1)))
    ix = None
    for block, seed in ((168, 30), (336, 31)):
        one = resample.block_index(span(d), 200, block, seed, circular=True).withColumn("block", F.lit(block).cast("long"))
        ix = one if ix is None else ix.unionByName(one)
    e = d.where("f is not null and v is not null").withColumnRenamed("t", "src").join(ix, "src").groupBy("block", "rep").agg((F.sum("f") / F.sum("v") - 1).alias("bias"))
    q = e.groupBy("block").agg(F.percentile("bias", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select("block", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("low", "mid", "high"))])


NATIONS = "n AS (SELECT CAST(c_nationkey AS BIGINT) AS k, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 2), x AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS u FROM n WHERE s > 0)"


@query(f"WITH {NATIONS}, pk AS (SELECT rep, {drawn_sql('rep', 'u', 32)} % (SELECT count(*) FROM x) AS u FROM x, (SELECT range AS rep FROM range(500))), b AS (SELECT rep, regr_slope(log10(s), log10(m)) AS slope FROM pk JOIN x USING (u) GROUP BY rep HAVING count(DISTINCT u) > 2) SELECT round((SELECT regr_slope(log10(s), log10(m)) FROM x), 6) AS slope, round(quantile_cont(slope, 0.025), 4) AS low, round(quantile_cont(slope, 0.975), 4) AS high FROM b")
def slope_interval(spark, sf_dir):
    """The slope of spread against mean on a log scale, with an interval from units drawn again."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = o.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.count("*").alias("n")).where("n > 2 and s > 0")
    x = n.join(resample.numbered(n, "k"), "k")
    slope = F.regr_slope(F.log10("s"), F.log10("m"))
    b = resample.picks(x, 500, 32).join(x, "u").groupBy("rep").agg(slope.alias("slope"), F.countDistinct("u").alias("different")).where("different > 2")
    q = b.agg(F.percentile("slope", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return x.agg(F.round(slope, 6).alias("slope")).crossJoin(q).select("slope", F.round(F.col("q")[0], 4).alias("low"), F.round(F.col("q")[1], 4).alias("high"))


RACKS = f"{FLEET}, ra AS (SELECT pod_id // 5 AS rack, u AS x, w AS y FROM tele WHERE u IS NOT NULL AND (pod_id // 5) % 5 <> 0), g AS (SELECT rack, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, row_number() OVER (ORDER BY rack) - 1 AS u FROM ra GROUP BY rack), pk AS (SELECT rep, {drawn_sql('rep', 'u', 33)} % (SELECT count(*) FROM g) AS u FROM g, (SELECT range AS rep FROM range(100))), b AS (SELECT rep, sum(n) AS n, sum(sx) AS sx, sum(sxx) AS sxx, sum(sy) AS sy, sum(sxy) AS sxy FROM pk JOIN g USING (u) GROUP BY rep)"


@query(f"WITH {RACKS}, l AS (SELECT (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope, (sy - (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) * sx) / n AS intercept FROM b), f AS (SELECT unnest(['slope', 'intercept']) AS what, unnest([slope, intercept]) AS x FROM l) SELECT what, round(quantile_cont(x, 0.025), 4) AS low, round(quantile_cont(x, 0.5), 4) AS mid, round(quantile_cont(x, 0.975), 4) AS high FROM f GROUP BY what")
def rack_bootstrap(spark, sf_dir):
    """The host line over racks drawn again, from each rack's sums; every fifth rack is held out."""
    rack = F.expr("pod_id div 5")
    ra = telemetry(spark, sf_dir).where("u is not null and (pod_id div 5) % 5 <> 0").withColumn("rack", rack)
    g = fitting.gram(ra, [F.lit(1.0), F.col("u")], "w", ["rack"])
    g = g.join(resample.numbered_many(g, "rack"), "rack")
    s = resample.picks(g, 100, 33).join(g.drop("n"), "u").groupBy("rep").agg(*[F.sum(F.col("g")[i]).alias(n) for i, n in ((0, "n"), (1, "sx"), (3, "sxx"))], F.sum(F.col("b")[0]).alias("sy"), F.sum(F.col("b")[1]).alias("sxy"))
    line = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    l = s.withColumn("slope", line).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    q = l.unpivot("rep", ["slope", "intercept"], "what", "x").groupBy("what").agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select("what", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("low", "mid", "high"))])


#: Alignments of the load's profile with the system's calendar.
N_ALIGN, MARGIN, BUDGET = 200, 0.05, 0.005
PROFILE = f"""pf AS (SELECT t - lo AS i, n, v / nameplate AS s, c / nameplate AS c, 0.25 * v / {power.PUE} / nameplate AS cap25, (SELECT sum(c) / sum(v) FROM pz) AS share FROM (SELECT *, first_value(x IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nameplate FROM (SELECT *, CASE WHEN count(v) OVER w >= 24 THEN max(v) OVER w END AS x FROM pz WINDOW w AS (ORDER BY t ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))), span)"""
ALIGN = f"""{TWO}, pz AS (SELECT t, coalesce(v, 0) AS v, coalesce(c, 0) AS c FROM two), {PROFILE}, dm AS (SELECT row_number() OVER (ORDER BY day) - 1 AS j, d FROM (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / 1000 AS d FROM orders GROUP BY 1)), pk AS (SELECT max(d) * {1 + MARGIN} AS cap, count(*) AS nh FROM dm),
al AS (SELECT range AS a, {drawn_sql('range', '0', 34)} % (SELECT n FROM span) AS off FROM range({N_ALIGN})),
x AS (SELECT a, j, d, s, cap - d AS room, nh, unnest(['full', 'measured', 'cap25', 'constant', 'linear']) AS scenario, unnest([s, c, cap25, share * s, c * (1 + 0.1 * s)]) AS c FROM dm, pk, al JOIN pf ON pf.i = (j - off + {10**6} * n) % n),
hr AS (SELECT scenario, a, min(CASE WHEN s > c THEN room / (s - c) END) AS hard, min(room / greatest(s, 1e-6)) AS rigid, any_value(nh) AS nh FROM x GROUP BY ALL), qr AS (SELECT scenario, a, room / s AS q, row_number() OVER (PARTITION BY scenario, a ORDER BY room / s) AS r FROM x WHERE s > 0),
ld AS (SELECT scenario, a, rigid, CASE WHEN least(hard, q, 20000) >= 1 THEN least(hard, q, 20000) ELSE 0 END AS load FROM (SELECT *, CAST(floor(round({BUDGET} * nh, 6)) AS BIGINT) + 1 AS r FROM hr) LEFT JOIN qr USING (scenario, a, r))"""


def aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, loads): hours of the system under each alignment and scenario, and the load that each admits."""
    z = two(telemetry(spark, sf_dir)).select("t", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("c", F.lit(0.0)).alias("c"))
    p = z.withColumn("x", supported(F.max("v"), "v", over([], -167, 0), 24)).withColumn("nameplate", filled("x", back_only=True)).crossJoin(z.agg((F.sum("c") / F.sum("v")).alias("share"))).crossJoin(span(z))
    s, c = F.col("v") / F.col("nameplate"), F.col("c") / F.col("nameplate")
    cases = {"full": s, "measured": c, "cap25": 0.25 * F.col("v") / power.PUE / F.col("nameplate"), "constant": F.col("share") * s, "linear": c * (1 + 0.1 * s)}
    p = p.select((F.col("t") - F.col("lo")).alias("i"), s.alias("s"), F.array(*[F.struct(F.lit(k).alias("scenario"), e.alias("c")) for k, e in cases.items()]).alias("cases"))
    day = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((F.sum("o_totalprice") / 1000).alias("d"))
    d = day.select((F.row_number().over(Window.orderBy("day")) - 1).cast("long").alias("j"), "d").crossJoin(day.agg((F.max("d") * (1 + MARGIN)).alias("cap"), F.count("*").alias("nh")))
    al = spark.range(N_ALIGN).crossJoin(span(z)).select(F.col("id").alias("a"), "n", (drawn("id", "0", 34) % F.col("n")).alias("off"))
    x = d.crossJoin(al).withColumn("i", F.pmod(F.col("j") - F.col("off"), F.col("n"))).join(p, "i").select("a", "j", "d", "s", "cap", "nh", F.explode("cases").alias("x"))
    x = x.select("a", "j", "d", "s", "nh", (F.col("cap") - F.col("d")).alias("room"), "x.scenario", "x.c")
    hr = x.groupBy("scenario", "a").agg(F.min(F.when(F.col("s") > F.col("c"), F.col("room") / (F.col("s") - F.col("c")))).alias("hard"), F.min(F.col("room") / F.greatest("s", F.lit(1e-6))).alias("rigid"), F.first("nh").alias("nh"))
    qr = x.where("s > 0").select("scenario", "a", (F.col("room") / F.col("s")).alias("q")).withColumn("r", F.row_number().over(Window.partitionBy("scenario", "a").orderBy("q")))
    ld = hr.withColumn("r", F.floor(F.round(BUDGET * F.col("nh"), 6)) + 1).join(qr, ["scenario", "a", "r"], "left").withColumn("load", F.least("hard", "q", F.lit(20000.0)))
    return x, ld.select("scenario", "a", "rigid", F.when(F.col("load") >= 1, F.col("load")).otherwise(0.0).alias("load"))


@query(f"WITH {ALIGN} SELECT scenario, round(quantile_cont(load, 0.05), 4) AS p5, round(quantile_cont(load, 0.5), 4) AS p50, round(quantile_cont(load, 0.95), 4) AS p95, round(quantile_cont(rigid, 0.5), 4) AS rigid, (SELECT arg_min(y.a, (round(abs(y.load - quantile_cont), 9), y.a)) FROM ld y, (SELECT quantile_cont(load, 0.5) AS quantile_cont FROM ld z WHERE z.scenario = ld.scenario) WHERE y.scenario = ld.scenario) AS representative FROM ld GROUP BY scenario")
def alignment_headroom(spark, sf_dir):
    """Headroom over alignments by what may be curtailed, and the alignment closest to the median."""
    ld = aligned(spark, sf_dir)[1]
    q = ld.groupBy("scenario").agg(F.percentile("load", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.round(quantile("rigid", 0.5), 4).alias("rigid"))
    rep = ld.join(q, "scenario").groupBy("scenario").agg(F.min_by("a", F.struct(F.round(F.abs(F.col("load") - F.col("q")[1]), 9), "a")).alias("representative"))
    return q.join(rep, "scenario").select("scenario", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p5", "p50", "p95"))], "rigid", "representative")


STRUCTURE = f"""{ALIGN}, r AS (SELECT a, j, greatest(0, load * s - room) AS r, load * s AS own FROM x JOIN ld USING (scenario, a) WHERE scenario = 'measured'), o AS (SELECT *, r > 1e-9 AS on_ FROM r), e AS (SELECT *, CASE WHEN on_ AND NOT coalesce(lag(on_) OVER (PARTITION BY a ORDER BY j), false) THEN 1 ELSE 0 END AS edge FROM o), i AS (SELECT *, sum(edge) OVER (PARTITION BY a ORDER BY j ROWS UNBOUNDED PRECEDING) AS run FROM e),
z AS (SELECT a, run, count(*) AS hours FROM i WHERE on_ GROUP BY ALL), za AS (SELECT a, count(*) AS n_events, sum(hours) AS hours, max(hours) AS longest, median(hours) AS middle FROM z GROUP BY a), en AS (SELECT a, 100 * sum(r) / greatest(sum(own), 1e-9) AS energy_pct, max(r / greatest(own, 1e-9)) AS depth FROM r GROUP BY a),
f AS (SELECT unnest(['n_events', 'hours', 'longest', 'middle', 'energy_pct', 'depth']) AS what, unnest([coalesce(n_events, 0)::DOUBLE, coalesce(hours, 0)::DOUBLE, coalesce(longest, 0)::DOUBLE, coalesce(middle, 0)::DOUBLE, energy_pct, depth]) AS x FROM en LEFT JOIN za USING (a))"""


@query(f"WITH {STRUCTURE} {bands_sql('f', 'x', 'what')}")
def alignment_events(spark, sf_dir):
    """What the load would have to do at each alignment's own limit: events, hours, depth, energy."""
    x, ld = aligned(spark, sf_dir)
    r = x.where("scenario = 'measured'").join(ld, ["scenario", "a"]).select("a", F.col("j").alias("t"), F.greatest(F.lit(0.0), F.col("load") * F.col("s") - F.col("room")).alias("r"), (F.col("load") * F.col("s")).alias("own"))
    z = events.runs(r.withColumn("on_", F.col("r") > 1e-9), "on_", ["a"]).groupBy("a").agg(F.count("*").cast("double").alias("n_events"), F.sum("hours").cast("double").alias("hours"), F.max("hours").cast("double").alias("longest"), F.median("hours").alias("middle"))
    e = r.groupBy("a").agg((100 * F.sum("r") / F.greatest(F.sum("own"), F.lit(1e-9))).alias("energy_pct"), F.max(F.col("r") / F.greatest("own", F.lit(1e-9))).alias("depth"))
    f = e.join(z, "a", "left").fillna(0.0, ["n_events", "hours", "longest", "middle"])
    return banded(f.unpivot("a", ["n_events", "hours", "longest", "middle", "energy_pct", "depth"], "what", "x"), "x", ["what"], 4)


BY_ORIGIN = f"{WINDOWS}, w AS (SELECT o, m / k AS q, m / (k / tm * sm) AS qn, 1.0 / count(*) OVER (PARTITION BY o) AS weight FROM te JOIN tr USING (o) JOIN (SELECT o, avg(v) FILTER (t >= o - 168 AND t < o) AS tm, avg(v) FILTER (t >= o AND t < o + 72) AS sm FROM fleet, o GROUP BY o) USING (o) WHERE k > 0)"


def by_origin_sql(q: str) -> str:
    return f"SELECT round(greatest(0.3, least(1.5, max({q}))), 6) FROM (SELECT {q}, sum(weight) OVER (ORDER BY {q} DESC) / (SELECT sum(weight) FROM w) AS share FROM w) WHERE share >= 0.95 - 1e-9"


@query(f"{BY_ORIGIN} SELECT 'abs' AS unit, ({by_origin_sql('q')}) AS d UNION ALL SELECT 'norm', ({by_origin_sql('qn')})")
def derating_by_origin(spark, sf_dir):
    """The largest factor whose coverage, meaned by origin, holds: a weighted order statistic. Levels as they are, and
    scaled by the means of training and test."""
    f = fleet(telemetry(spark, sf_dir))
    te = tested(f).where("k > 0").select("o", "m", "k")
    at = te.select("o").distinct()
    means = f.join(at, (F.col("t") >= F.col("o") - 168) & (F.col("t") < F.col("o") + 72)).groupBy("o").agg(F.avg(F.when(F.col("t") < F.col("o"), F.col("v"))).alias("tm"), F.avg(F.when(F.col("t") >= F.col("o"), F.col("v"))).alias("sm"))
    w = te.join(means, "o").withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("o")))
    both = w.select("weight", F.explode(F.array(F.struct(F.lit("abs").alias("unit"), (F.col("m") / F.col("k")).alias("q")), F.struct(F.lit("norm").alias("unit"), (F.col("m") / (F.col("k") / F.col("tm") * F.col("sm"))).alias("q")))).alias("x")).select("weight", "x.*")
    share = F.sum("weight").over(Window.partitionBy("unit").orderBy(F.desc("q")).rangeBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(Window.partitionBy("unit"))
    return both.withColumn("share", share).where(F.col("share") >= 0.95 - 1e-9).groupBy("unit").agg(F.round(F.greatest(F.lit(0.3), F.least(F.lit(1.5), F.max("q"))), 6).alias("d"))


SPLITS = f"{WINDOWS}, ra AS (SELECT o, row_number() OVER (ORDER BY o) <= (SELECT count(*) // 2 FROM tr) AS early FROM tr), wi AS (SELECT early, o, m, k FROM te JOIN tr USING (o) JOIN ra USING (o)), sp AS (SELECT split, early = (split = 'forward') AS fits, o, m, k FROM wi, (SELECT unnest(['forward', 'reverse']) AS split)), de AS (SELECT split, q AS d FROM (SELECT split, m / k AS q, row_number() OVER (PARTITION BY split ORDER BY m / k DESC) AS i, count(*) OVER (PARTITION BY split) AS n FROM sp WHERE fits AND k > 0) WHERE i = CAST(ceil(round(0.95 * n, 6)) AS BIGINT))"


@query(f"{SPLITS} SELECT split, round(any_value(greatest(0.3, least(1.5, d))), 6) AS d, round(avg((m >= k)::INT) FILTER (fits), 6) AS fitted, round(avg((m >= k)::INT) FILTER (NOT fits), 6) AS tested, round(avg((m >= greatest(0.3, least(1.5, d)) * k)::INT) FILTER (NOT fits), 6) AS tested_derated, count(DISTINCT o) FILTER (NOT fits) AS origins FROM sp JOIN de USING (split) GROUP BY split")
def derating_splits(spark, sf_dir):
    """A factor from the earlier half of the origins tried on the later half, and the other way round."""
    te = tested(fleet(telemetry(spark, sf_dir))).select("o", "m", "k")
    at = te.select("o").distinct()
    rank = at.withColumn("early", F.row_number().over(Window.orderBy("o")) <= F.expr("count(*) over () div 2"))
    both = te.join(rank, "o").select("o", "m", "k", "early", F.explode(F.array(F.lit("forward"), F.lit("reverse"))).alias("split")).withColumn("fits", F.col("early") == (F.col("split") == "forward"))
    w = Window.partitionBy("split")
    q = both.where("fits and k > 0").select("split", (F.col("m") / F.col("k")).alias("q"))
    q = q.select("split", "q", F.row_number().over(w.orderBy(F.desc("q"))).alias("i"), F.count("*").over(w).alias("n")).where(F.col("i") == F.ceil(F.round(0.95 * F.col("n"), 6)))
    d = q.select("split", F.greatest(F.lit(0.3), F.least(F.lit(1.5), "q")).alias("d"))
    held = lambda fits, level, n: F.round(F.avg(F.when(fits, (F.col("m") >= level).cast("int"))), 6).alias(n)
    fits, other = F.col("fits"), ~F.col("fits")
    return both.join(d, "split").groupBy("split").agg(F.round(F.first("d"), 6).alias("d"), held(fits, F.col("k"), "fitted"), held(other, F.col("k"), "tested"), held(other, F.col("d") * F.col("k"), "tested_derated"), F.countDistinct(F.when(other, F.col("o"))).alias("origins"))
