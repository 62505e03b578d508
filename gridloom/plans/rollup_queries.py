"""Aggregates, joins and audits over usage rows and the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import rollups
from gridloom.operators.rolling import fleet
from gridloom.plans.registry import query
from gridloom.sources.tables import FLEET, LANES, TELE, table, telemetry

KEYS = ["cluster_id", "spec", "job_type", "priority_class", "state"]
STATS_SQL = "count(*) AS n_pods, round(sum(w), 4) AS gpu_hours, round(coalesce(sum(CASE WHEN u IS NULL THEN w END), 0), 4) AS gpu_hours_null_util, round(sum(w * greatest(coalesce(u, 0), 0)), 4) AS s0, round(sum(w * greatest(coalesce(u, 0) - 0.25, 0)), 4) AS s25, round(sum(w * greatest(coalesce(u, 0) - 0.5, 0)), 4) AS s50, round(sum(w * greatest(coalesce(u, 0) - 0.75, 0)), 4) AS s75"


def r4(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"WITH {TELE} SELECT t // 24 AS day, t % 24 AS hour, {', '.join(KEYS)}, {STATS_SQL} FROM tele GROUP BY ALL")
def agg_sufficient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mergeable statistics of usage by hour and labels; null labels are groups, null utilisation has its own weight."""
    rows = telemetry(spark, sf_dir).withColumn("day", F.expr("t div 24")).withColumn("hour", F.expr("t % 24"))
    return r4(rollups.sufficient(rows, ["day", "hour", *KEYS]), *rollups.STATS)


@query(f"WITH {TELE} SELECT spec, job_type, {STATS_SQL} FROM tele GROUP BY ALL")
def agg_null_keys(spark, sf_dir):
    return r4(rollups.sufficient(telemetry(spark, sf_dir), ["spec", "job_type"]), *rollups.STATS)


@query(f"WITH {TELE} SELECT spec, job_type, {STATS_SQL} FROM tele WHERE spec IS NOT NULL AND job_type IS NOT NULL GROUP BY ALL")
def agg_drop_null_keys(spark, sf_dir):
    return r4(rollups.sufficient(telemetry(spark, sf_dir).dropna(subset=["spec", "job_type"]), ["spec", "job_type"]), *rollups.STATS)


@query(f"WITH {TELE} SELECT cluster_id, job_type, priority_class, CAST(grouping(cluster_id, job_type, priority_class) AS BIGINT) AS level, round(sum(w), 4) AS gpu_hours, count(*) AS n FROM tele GROUP BY ROLLUP (cluster_id, job_type, priority_class)")
def rollup_levels(spark, sf_dir):
    """Four levels of aggregation at once, from cluster, type and priority to the fleet."""
    out = telemetry(spark, sf_dir).rollup("cluster_id", "job_type", "priority_class").agg(F.grouping_id().alias("level"), F.round(F.sum("w"), 4).alias("gpu_hours"), F.count("*").alias("n"))
    return out


@query(f"""WITH {TELE}, raw AS (SELECT cluster_id, t, epoch_us(ts) // 300000000 AS bin, ts, avg(w) AS a, count(*) AS n FROM (SELECT t, cluster_id, w, ts FROM (SELECT *, row_number() OVER () AS i FROM tele) POSITIONAL JOIN (SELECT ts FROM events)) GROUP BY ALL),
bins AS (SELECT cluster_id, t, bin, avg(a) AS b, sum(n) AS n, count(*) AS stamps FROM raw GROUP BY ALL)
SELECT cluster_id, t, round(avg(b), 9) AS mean_w, count(*) AS n_bins, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) - sum(stamps) AS BIGINT) AS n_repeats FROM bins GROUP BY ALL""")
def mean_of_means(spark, sf_dir):
    """Equal stamps, then five-minute bins, then hours: each level is a mean of the means below."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("cluster_id"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))").alias("us"), F.col("value").alias("w"))
    return r4(rollups.mean_of_means(e.withColumn("t", F.expr("(us - 1704067200000000) div 3600000000"))), "mean_w", digits=9)


@query(f"WITH {TELE} SELECT pod_id, min(t) AS t_min, max(t) AS t_max, round(sum(w), 4) AS gh FROM tele GROUP BY pod_id")
def span_minmax(spark, sf_dir):
    return r4(rollups.spans(telemetry(spark, sf_dir), "pod_id"), "gh")


DELAY = "(SELECT o_orderpriority, l_quantity AS w, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"SELECT o_orderpriority, round(sum(w) FILTER (d >= 1) / sum(w), 6) AS s_1, round(sum(w) FILTER (d >= 30) / sum(w), 6) AS s_30, round(sum(w) FILTER (d >= 365) / sum(w), 6) AS s_365 FROM {DELAY} GROUP BY ALL")
def tolerance_share(spark, sf_dir):
    """The share of weight whose delay is at least so long."""
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = d.select("o_orderpriority", F.col("l_quantity").alias("w"), F.datediff("l_shipdate", "o_orderdate").alias("d"))
    return rollups.tolerance(rows, ["o_orderpriority"], "d", "w", [1, 30, 365])


BINS = [0, 500, 1000, 2000, 4000, 8000, 16000, 1 << 40]


@query(f"WITH m AS (SELECT d.n_chars, l.doc_id IS NOT NULL AS matched, {rollups.bin_sql('d.n_chars', BINS)} AS bin FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT bin, count(*) AS n, round(100 * avg(CAST(matched AS INT)), 6) AS pct, round(100 * sum(n_chars) FILTER (matched) / sum(n_chars), 6) AS weight_pct FROM m GROUP BY bin")
def coverage_by_bin(spark, sf_dir):
    """How many rows, and how much weight, have a match, by size."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    return rollups.coverage(rollups.with_match(d, lab, "doc_id"), rollups.bin_of("n_chars", BINS), "n_chars")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unmatched(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_matched(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'unmatched' ELSE 'matched' END AS side, coalesce(lang, '__MISSING__') AS lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def union_tagged(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").select("doc_id")
    both = d.join(lab, "doc_id", "left_semi").withColumn("side", F.lit("matched")).unionByName(d.join(lab, "doc_id", "left_anti").withColumn("side", F.lit("unmatched")))
    return both.groupBy("side", F.coalesce("lang", F.lit("__MISSING__")).alias("lang")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("WITH m AS (SELECT lang, n_chars, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN labels l USING (doc_id)), s AS (SELECT sum(n_chars) AS total, sum(n_chars) FILTER (NOT matched) AS u FROM m), g AS (SELECT lang, sum(n_chars) FILTER (matched) AS x FROM m GROUP BY lang) SELECT lang, round(100 * (x - least(x, u)) / (total - u), 6) AS lower_pct, round(100 * x / (total - u), 6) AS upper_pct FROM g, s")
def composition_bounds(spark, sf_dir):
    """Between which shares a label's true share lies when part of the weight has no match."""
    m = rollups.with_match(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")
    return rollups.composition_bounds(m, "lang", "n_chars")


@query(f"WITH {TELE}, a AS (SELECT spec, sum(w) AS x FROM tele WHERE t < 300 AND priority_class = 'HP' AND spec <> 'A10' GROUP BY spec), b AS (SELECT spec, sum(w) AS y FROM tele WHERE t >= 300 AND spec <> 'H800' GROUP BY spec) SELECT coalesce(a.spec, b.spec) AS spec, round(coalesce(x, 0), 4) AS early, round(coalesce(y, 0), 4) AS late FROM a FULL JOIN b ON a.spec = b.spec")
def full_outer_labels(spark, sf_dir):
    a = telemetry(spark, sf_dir, until=300).where("priority_class = 'HP' AND spec <> 'A10'").groupBy("spec").agg(F.sum("w").alias("x"))
    b = telemetry(spark, sf_dir, first=300).where("spec <> 'H800'").groupBy("spec").agg(F.sum("w").alias("y"))
    zero = F.lit(0.0)
    return a.join(b, "spec", "full").select("spec", F.round(F.coalesce("x", zero), 4).alias("early"), F.round(F.coalesce("y", zero), 4).alias("late"))


@query("WITH cap AS (SELECT s_nationkey, count(s_suppkey) AS n, sum(2000000.0 * s_suppkey) AS c FROM supplier GROUP BY ALL), occ AS (SELECT s_nationkey, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT CAST(n_nationkey AS BIGINT) AS nation, coalesce(cap.n, 0) AS suppliers, round(greatest(coalesce(c, 0) - coalesce(q, 0), 0), 2) AS idle FROM nation LEFT JOIN cap ON n_nationkey = cap.s_nationkey LEFT JOIN occ ON n_nationkey = occ.s_nationkey")
def inventory_idle(spark, sf_dir):
    """Capacity that use leaves idle, never below zero; places without use or capacity count as zero."""
    s = table(spark, sf_dir, "supplier")
    cap = s.groupBy("s_nationkey").agg(F.count("s_suppkey").alias("n"), F.sum(F.lit(2000000.0) * F.col("s_suppkey")).alias("c"))
    use = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))  # before the join
    occ = use.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum("q").alias("q"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    out = n.join(cap, "s_nationkey", "left").join(occ, "s_nationkey", "left")
    idle = F.greatest(F.coalesce("c", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)), F.lit(0.0))
    return out.select(F.col("s_nationkey").cast("long").alias("nation"), F.coalesce("n", F.lit(0)).alias("suppliers"), F.round(idle, 2).alias("idle"))


@query(f"WITH {TELE} SELECT cluster_id, count(DISTINCT pod_id) AS pods, count(DISTINCT t) AS hours, count(DISTINCT spec) AS specs FROM tele GROUP BY ALL")
def distinct_entities(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("cluster_id").agg(F.countDistinct("pod_id").alias("pods"), F.countDistinct("t").alias("hours"), F.countDistinct("spec").alias("specs"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity * l_discount) / sum(l_quantity), 8) AS discount FROM lineitem GROUP BY ALL")
def weighted_average(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(rollups.weighted("l_discount", "l_quantity"), 8).alias("discount"))


@query(f"WITH {TELE}, s AS (SELECT job_type, cluster_id, sum(w) AS x FROM tele GROUP BY ALL) SELECT job_type, round(sum((x / total) ** 2), 8) AS hhi FROM (SELECT *, sum(x) OVER (PARTITION BY job_type) AS total FROM s) GROUP BY job_type")
def hhi(spark, sf_dir):
    return r4(rollups.concentration(telemetry(spark, sf_dir), ["job_type"], "cluster_id", "w"), "hhi", digits=8)


@query(f"WITH {FLEET} SELECT t // 24 AS day, round(median(v), 6) AS median_v, round(max(v) - min(v), 9) AS amplitude, round(avg(v), 9) AS mean_v, round(100.0 * sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) / count(*), 9) AS null_pct FROM fleet GROUP BY ALL")
def median_by_day(spark, sf_dir):
    f = fleet(telemetry(spark, sf_dir)).groupBy(F.expr("t div 24").alias("day"))
    return f.agg(F.round(F.median("v"), 6).alias("median_v"), F.round(F.max("v") - F.min("v"), 9).alias("amplitude"), F.round(F.avg("v"), 9).alias("mean_v"), F.round(100.0 * F.sum(F.col("v").isNull().cast("int")) / F.count("*"), 9).alias("null_pct"))


@query(f"WITH {LANES} SELECT cluster_id, round(sum(v), 4) AS total FROM lanes GROUP BY 1 ORDER BY total DESC LIMIT 3")
def topk_lanes(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("cluster_id").agg(F.round(F.sum("w"), 4).alias("total")).orderBy(F.desc("total")).limit(3)


PIVOT = ", ".join(f"avg(w) FILTER (cluster_id = '{c}') AS {c}" for c in ("click", "view", "purchase"))


@query(f"WITH {TELE}, p AS (SELECT t, cluster_id, avg(w) AS x, count(*) AS n FROM tele WHERE w BETWEEN 0 AND 1000 GROUP BY ALL HAVING count(*) >= 2), c AS (SELECT t, count(*) AS sensors, sum(x) AS total, min(x) AS least, max(x) AS most FROM p GROUP BY t) SELECT t, sensors, round(total, 9) AS total, round(most - least, 9) AS spread FROM c WHERE sensors >= 4")
def sensor_pivot_hourly(spark, sf_dir):
    """Hours with enough rows of enough sensors, from one pivoting aggregate instead of a join per sensor."""
    p = telemetry(spark, sf_dir).where("w BETWEEN 0 AND 1000").groupBy("t", "cluster_id").agg(F.avg("w").alias("x"), F.count("*").alias("n")).where("n >= 2")
    c = p.groupBy("t").agg(F.count("*").alias("sensors"), F.sum("x").alias("total"), F.min("x").alias("least"), F.max("x").alias("most")).where("sensors >= 4")
    return c.select("t", "sensors", F.round("total", 9).alias("total"), F.round(F.col("most") - F.col("least"), 9).alias("spread"))


NUMBERS = ["0.4-0.5", "~0.3", "17", "Brand#17", "~2 - 4", "~ 2 - 4", " .5 ", "n/a", "1e3", ""]


PARSED = f"y AS (SELECT *, regexp_extract(trim(s), '{rollups.NUMBER_RANGE}', 1) AS a, regexp_extract(trim(s), '{rollups.NUMBER_RANGE}', 2) AS b, regexp_extract(trim(s), '{rollups.NUMBER}', 1) AS c FROM x), z AS (SELECT *, CASE WHEN a <> '' THEN (TRY_CAST(a AS DOUBLE) + TRY_CAST(b AS DOUBLE)) / 2 ELSE TRY_CAST(c AS DOUBLE) END AS number FROM y)"


@query(f"WITH x AS (SELECT unnest({NUMBERS}) AS s UNION ALL SELECT DISTINCT p_brand FROM part), {PARSED} SELECT s, number, starts_with(s, '~') AS approximate FROM z")
def parse_ranges(spark, sf_dir):
    x = spark.createDataFrame([(s,) for s in NUMBERS], "s string").unionByName(table(spark, sf_dir, "part").select(F.col("p_brand").alias("s")).distinct())
    return x.select("s", rollups.number_of("s").alias("number"), F.col("s").startswith("~").alias("approximate"))


RULES = [("first", ["src1", "src2"]), ("last", ["9"]), ("even", ["0", "4", "6", "8"])]


@query("SELECT category, lang, count(*) AS n FROM (SELECT CASE WHEN contains(source, 'src1') OR contains(source, 'src2') THEN 'first' WHEN contains(source, '9') THEN 'last' WHEN contains(source, '0') OR contains(source, '4') OR contains(source, '6') OR contains(source, '8') THEN 'even' END AS category, lang FROM documents) GROUP BY ALL")
def classify_text(spark, sf_dir):
    """Ordered keyword rules; what no rule takes has no category."""
    d = table(spark, sf_dir, "documents").select(rollups.category_of("source", RULES).alias("category"), "lang")
    return d.groupBy("category", "lang").agg(F.count("*").alias("n"))


#: CRC-32 of a number's digits, bit by bit.
CRC = "xor(list_reduce(list_transform(range(0, 8 * length({s})), lambda j: ((ascii({s}[j // 8 + 1]) >> (j % 8)) & 1)::BIGINT), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384), 4294967295::BIGINT), 4294967295)"


@query(f"SELECT CAST({CRC.format(s='(user_id::VARCHAR)')} % 16 AS BIGINT) AS bucket, count(*) AS n, count(DISTINCT user_id) AS pods FROM events GROUP BY 1")
def crc_buckets(spark, sf_dir):
    """Rows by CRC-32 bucket of the entity, as a bucketed sink deals them."""
    bucket = F.pmod(F.crc32(F.col("user_id").cast("string").cast("binary")), F.lit(16))
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("pods"))


@query(f"WITH {TELE}, x AS (SELECT cluster_id, t // 240 AS block, sum(w) AS x FROM tele GROUP BY ALL) SELECT cluster_id, block, round(100 * x / sum(x) OVER (PARTITION BY block), 6) AS pct FROM x")
def share_by_block(spark, sf_dir):
    x = telemetry(spark, sf_dir).groupBy("cluster_id", F.expr("t div 240").alias("block")).agg(F.sum("w").alias("x"))
    return x.select("cluster_id", "block", F.round(100 * F.col("x") / F.sum("x").over(Window.partitionBy("block")), 6).alias("pct"))


@query(f"WITH {TELE}, p AS (SELECT pod_id, min(t) AS t_min FROM tele GROUP BY pod_id), q AS (SELECT pod_id, t_min, quantile_cont(t_min, [1/3, 2/3]) OVER () AS e FROM p) SELECT CASE WHEN t_min <= e[1] THEN 0 WHEN t_min <= e[2] THEN 1 ELSE 2 END AS third, count(*) AS n, median(t_min)::DOUBLE AS median_t FROM q GROUP BY ALL")
def quantile_bins(spark, sf_dir):
    """Thirds by value: edges are quantiles, and an edge belongs to the bin below."""
    p = telemetry(spark, sf_dir).groupBy("pod_id").agg(F.min("t").alias("t_min"))
    e = p.agg(F.percentile("t_min", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e"))
    third = F.when(F.col("t_min") <= F.col("e")[0], 0).when(F.col("t_min") <= F.col("e")[1], 1).otherwise(2)
    return p.crossJoin(F.broadcast(e)).groupBy(third.alias("third")).agg(F.count("*").alias("n"), F.median("t_min").alias("median_t"))


@query("SELECT l_orderkey % 100 AS k, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def validated_join(spark, sf_dir):
    """A join that fails if the right side repeats a key."""
    j = rollups.many_to_one(table(spark, sf_dir, "lineitem").select("l_orderkey"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return j.groupBy((F.col("l_orderkey") % 100).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS pod_id, event_id, event_type AS cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_rows(spark, sf_dir):
    """One row for each entity, the first by an explicit order."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("pod_id")).agg(F.min(F.struct("ts", "event_id", "event_type")).alias("x")).select("pod_id", "x.event_id", F.col("x.event_type").alias("cluster_id"))
