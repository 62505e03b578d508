"""Streamed aggregates, run to the end of the input, and their batch equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import rollups
from gridloom.plans.registry import query
from gridloom.plans.rollup_queries import STATS_SQL, r4
from gridloom.sources.shared import shared_path
from gridloom.sources.tables import TELE, table
from gridloom.streaming import incremental


@query(f"WITH {TELE} SELECT t, cluster_id, {STATS_SQL} FROM tele GROUP BY ALL")
def stream_sufficient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics accumulated from micro-batches."""
    stream = incremental.usage(incremental.event_stream(spark, sf_dir))
    return r4(incremental.accumulate(stream, ["t", "cluster_id"], shared_path(spark, "stream")), *rollups.STATS)


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 3600000000 AS hour, event_type AS cluster_id, round(sum(value), 4) AS v, count(*) AS n FROM events GROUP BY ALL")
def hourly_windows(spark, sf_dir):
    out = incremental.hourly(table(spark, sf_dir, "events"))
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(start AS timestamp_ntz))")
    return out.select(hour.alias("hour"), "cluster_id", F.round("v", 4).alias("v"), "n")


@query("WITH e AS (SELECT user_id, value, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS visit FROM e) SELECT user_id, min(us) AS us, count(*) AS n, round(sum(value), 4) AS v FROM s GROUP BY user_id, visit")
def session_windows(spark, sf_dir):
    out = incremental.visits(table(spark, sf_dir, "events"))
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(start AS timestamp_ntz))")
    return out.select("user_id", us.alias("us"), "n", F.round("v", 4).alias("v"))
