"""Declared schemas and readers. Gaps of hourly series are NULL, never zero or NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POD_HOURLY = """pod_id string, cluster_id string, gpu_spec_public string, job_type_public string, priority_class string,
state_public string, gpu_request double, used_gpu_hours double, avg_gpu_sm_util double, cpu_request_cores double,
avg_cpu_request_util double, day int, hour int"""
SERVER_HOURLY = "server_id string, cluster_id string, gpu_spec_public string, gpu_count double, cpu_capacity_cores double, day int, hour int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitioned(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """A table under key=value directories; filters on the keys prune directories."""
    return spark.read.schema(schema).parquet(root)


def utilisation_divisor(rows: DataFrame, column: str) -> float:
    """100 where a column of shares holds percentages (a maximum over 1.5), else 1."""
    most = rows.agg(F.max(column)).first()[0]
    return 100.0 if most is not None and most > 1.5 else 1.0


def coerced(frame: DataFrame, **kinds: str) -> DataFrame:
    """Text columns as other types; what doesn't parse is NULL, and NaN is NULL."""
    for c, kind in kinds.items():
        frame = frame.withColumn(c, F.expr(f"nullif(try_cast(`{c}` AS {kind}), double('NaN'))" if kind.lower() in ("double", "float") else f"try_cast(`{c}` AS {kind})"))
    return frame


def demand_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ts, demand_mw) of a CSV with text timestamps and numbers; repeated hours keep the first by value."""
    raw = spark.read.option("header", True).csv(path)
    ts = F.try_to_timestamp("utc_end", F.lit("MM/dd/yyyy hh:mm:ss a"))
    rows = raw.select(ts.alias("ts"), F.expr("try_cast(demand_mw AS double)").alias("demand_mw")).where("ts is not null")
    return rows.groupBy("ts").agg(F.min("demand_mw").alias("demand_mw"))


def missing_days(rows: DataFrame, done: DataFrame, key: str = "day") -> DataFrame:
    """The rows of partitions that a restartable sink hasn't written yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def write_days(rows: DataFrame, path: str, key: str = "day") -> None:
    """Replace the partitions that rows has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def telemetry(spark: SparkSession, sf_dir: str, first: int | None = None, until: int | None = None) -> DataFrame:
    """Usage rows from the event table: t (hour), cluster_id, pod_id, w, u (share or NULL), labels. Bounds on the hour
    are put on the stored time, so that they reach the files."""
    start = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, {})"
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("user_id") % n + 1).cast("int"))
    events = table(spark, sf_dir, "events")
    for bound, test in ((first, ">="), (until, "<")):
        if bound is not None:
            events = events.where(F.expr(f"ts {test} {start.format(bound)}"))
    rows = events.select(
        t.alias("t"), F.col("event_type").alias("cluster_id"), F.col("user_id").alias("pod_id"), F.col("value").alias("w"), F.when(k >= 10, k / F.lit(100.0)).alias("u"), k.alias("k"),
        pick(3, "LP", "HP", "Other").alias("priority_class"), pick(4, "training", "online_inference", "offline_inference", "other").alias("job_type"), pick(5, "A10", "A100", "H800", "XPU-A", None).alias("spec"),
    )
    return rows.withColumn("state", F.when((F.col("pod_id") % 17 == 0) & (F.col("t") >= 360), "Standby").otherwise("Unknown"))


#: The same views as common table expressions.
TELE = """tele AS (SELECT CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS BIGINT) AS t, event_type AS cluster_id, user_id AS pod_id, value AS w, k,
 CASE WHEN k >= 10 THEN k / 100.0::DOUBLE END AS u, ['LP', 'HP', 'Other'][user_id % 3 + 1] AS priority_class,
 ['training', 'online_inference', 'offline_inference', 'other'][user_id % 4 + 1] AS job_type, ['A10', 'A100', 'H800', 'XPU-A', NULL][user_id % 5 + 1] AS spec,
 CASE WHEN user_id % 17 = 0 AND (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 >= 360 THEN 'Standby' ELSE 'Unknown' END AS state
 FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events))"""
SPINE = "spine AS (SELECT unnest(range((SELECT min(t) FROM tele), (SELECT max(t) + 1 FROM tele))) AS t), span AS (SELECT min(t) AS lo, count(*) AS n FROM spine)"
FLEET = f"{TELE}, {SPINE}, fleet AS (SELECT s.t, sum(w) AS v FROM spine s LEFT JOIN tele USING (t) GROUP BY s.t)"
LANES = f"{TELE}, {SPINE}, lanes AS (SELECT s.t, c.cluster_id, sum(w) AS v FROM spine s CROSS JOIN (SELECT DISTINCT cluster_id FROM tele) c LEFT JOIN tele USING (t, cluster_id) GROUP BY s.t, c.cluster_id)"
