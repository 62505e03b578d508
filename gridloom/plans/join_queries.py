"""Joins that move no rows, as-of and band joins by irregular keys, curves through knots of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import asof, buckets
from gridloom.plans.registry import query
from gridloom.sources.tables import table

US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"
HOUR = 3_600_000_000


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.expr(US).alias("us"))


def spans_and_jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spans by entity, and a row of an entity's job, both on as many buckets; nothing moves after the tables are read."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pod_id"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("gh"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pod_id"), "event_id", F.col("event_type").alias("job_type"))
    spans, jobs = buckets.bucket_table(o, "spans", "pod_id"), buckets.bucket_table(e, "jobs", "pod_id")
    spans = spans.groupBy("pod_id").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.sum("gh").alias("gh"))
    return spans, buckets.first_by(jobs, "pod_id", "event_id", "job_type").drop("event_id")


SPANS = "WITH sp AS (SELECT o_custkey AS pod_id, min(o_orderdate) AS t_min, max(o_orderdate) AS t_max, sum(o_totalprice) AS gh FROM orders GROUP BY 1), js AS (SELECT user_id AS pod_id, arg_min(event_type, event_id) AS job_type FROM events GROUP BY 1), m AS (SELECT sp.*, job_type, js.pod_id IS NOT NULL AS matched FROM sp LEFT JOIN js USING (pod_id))"


@query(f"{SPANS} SELECT matched, job_type, CAST(year(t_min) AS INT) AS year, count(*) AS spans, round(sum(gh), 2) AS gh, max(date_diff('day', CAST(t_min AS DATE), CAST(t_max AS DATE)))::INT AS longest FROM m GROUP BY ALL")
def bucket_join(spark, sf_dir):
    """Which spans have a job, by bucket; entities and spans meet without an exchange."""
    m = buckets.matched(*spans_and_jobs(spark, sf_dir), "pod_id")
    return m.groupBy("matched", "job_type", F.year("t_min").alias("year")).agg(F.count("*").alias("spans"), F.round(F.sum("gh"), 2).alias("gh"), F.max(F.datediff("t_max", "t_min")).alias("longest"))


@query(f"{SPANS} SELECT count(*) AS n, round(100.0 * avg(matched::INT), 6) AS span_pct, round(100.0 * sum(gh) FILTER (matched) / sum(gh), 6) AS weight_pct FROM m")
def bucket_coverage(spark, sf_dir):
    """The share of spans, and of their weight, that a job is known of."""
    m = buckets.matched(*spans_and_jobs(spark, sf_dir), "pod_id")
    return m.agg(F.count("*").alias("n"), F.round(100 * F.avg(F.col("matched").cast("int")), 6).alias("span_pct"), F.round(100 * F.sum(F.when(F.col("matched"), F.col("gh"))) / F.sum("gh"), 6).alias("weight_pct"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS entities, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1")
def bucket_distinct(spark, sf_dir):
    """Distinct entities by class, counted in their buckets."""
    rows = buckets.bucket_table(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), "items", "l_orderkey")
    return buckets.distinct_by(rows, "l_orderkey", ["l_returnflag"], F.sum("l_quantity").alias("quantity")).withColumn("quantity", F.round("quantity", 2))


BOUGHT = "(SELECT * FROM events WHERE event_type = 'purchase')"


@query(f"SELECT e.event_id, round(p.value, 4) AS last_value, (epoch_us(e.ts) - epoch_us(p.ts)) // 1000000 AS age FROM events e ASOF LEFT JOIN {BOUGHT} p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_by_key(spark, sf_dir):
    """Each reading with the last purchase of its user, which may be itself, and how old that is."""
    e = readings(spark, sf_dir)
    out = asof.asof(e.select("event_id", "user_id", "us"), e.where("event_type = 'purchase'"), ["user_id"], "us", ["value"], 24 * HOUR, ["event_id"])
    return out.select("event_id", F.round("value", 4).alias("last_value"), F.expr("(us - known_at) div 1000000").alias("age"))


@query(f"SELECT e.event_type, count(*) AS n, count(p.value) FILTER (epoch_us(e.ts) - epoch_us(p.ts) <= {6 * HOUR}) AS recent, round(sum(p.value) FILTER (epoch_us(e.ts) - epoch_us(p.ts) <= {6 * HOUR}), 4) AS total FROM events e ASOF LEFT JOIN {BOUGHT} p ON e.user_id = p.user_id AND e.ts >= p.ts GROUP BY 1")
def asof_tolerance(spark, sf_dir):
    """The same, if it is at most six hours old."""
    e = readings(spark, sf_dir)
    known = e.where("event_type = 'purchase'").withColumnRenamed("value", "last")
    out = asof.asof(e, known, ["user_id"], "us", ["last"], 12 * HOUR, ["event_id"], within=6 * HOUR)
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count("last").alias("recent"), F.round(F.sum("last"), 4).alias("total"))


@query(f"SELECT p.event_id AS span_id, count(*) AS n, round(sum(e.value), 4) AS total FROM events e JOIN {BOUGHT} p ON e.user_id = p.user_id AND epoch_us(e.ts) >= epoch_us(p.ts) AND epoch_us(e.ts) < epoch_us(p.ts) + CAST(floor(p.value * 600000000) AS BIGINT) GROUP BY 1")
def band_by_key(spark, sf_dir):
    """Readings in spans of their user that begin with a purchase and are as long as it is dear."""
    e = readings(spark, sf_dir)
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), F.col("us").alias("lo"), (F.col("us") + F.floor(F.col("value") * 600_000_000)).alias("hi"))
    met = asof.band(e.select("user_id", "us", "value"), spans, "us", "lo", "hi", 6 * HOUR, ["user_id"])
    return met.groupBy("span_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


KNOTS = f"""WITH e AS (SELECT event_id, event_type, value, (epoch_us(ts) // {HOUR}) / 24.0::DOUBLE AS x FROM events), k AS (SELECT event_type, floor(x) AS u, avg(value) AS c FROM e GROUP BY ALL HAVING max(value) > (SELECT avg(value) FROM e)),
s AS (SELECT *, lead(u) OVER w AS nu, lead(c) OVER w AS nc FROM k WINDOW w AS (PARTITION BY event_type ORDER BY u)), z AS (SELECT event_type, min(u) AS a, arg_min(c, u) AS ya, arg_max(c, u) AS yb FROM k GROUP BY 1)"""


@query(f"{KNOTS} SELECT event_id, round(CASE WHEN x < a THEN ya WHEN nu IS NULL THEN yb WHEN c = nc THEN c ELSE c + (nc - c) * (x - u) / (nu - u) END, 6) AS level FROM e JOIN z USING (event_type) ASOF LEFT JOIN s ON e.event_type = s.event_type AND e.x >= s.u")
def curve_by_key(spark, sf_dir):
    """The daily mean of a reading's kind at its hour, on the line through the days that have one."""
    e = readings(spark, sf_dir).select("event_id", "event_type", "value", (F.expr(f"us div {HOUR}") / F.lit(24.0)).alias("x"))
    mean = e.agg(F.avg("value").alias("mean"))
    k = e.groupBy("event_type", F.floor("x").cast("double").alias("u")).agg(F.avg("value").alias("c"), F.max("value").alias("most")).crossJoin(mean).where("most > mean")
    out = asof.interpolated_at(e, k.select("event_type", "u", "c"), "x", "level", ["event_type"])
    return out.select("event_id", F.round("level", 6).alias("level"))
