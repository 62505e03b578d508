"""Bands of the covariance between clusters: every four of them, by residual, by hours that count, by block length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import replicates
from gridloom.operators.resample import drawn_sql
from gridloom.operators.rolling import span
from gridloom.plans.detail_queries import MASKED
from gridloom.plans.registry import query
from gridloom.plans.series_queries import residuals

REPS, BLOCKS = 1000, ((168, 38), (336, 39))
KINDS, MASKS = ("raw", "deseason"), ("full", "trim", "allocated", "both")


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, t, raw, deseason, and a column of 0 and 1 for each mask)"""
    res = residuals(spark, sf_dir)
    high = F.bool_and(F.coalesce(F.col("v") >= 0.02 * F.col("mx"), F.lit(False)))
    hours = res.withColumn("mx", F.max("v").over(Window.partitionBy("cluster_id"))).groupBy("t").agg(high.alias("high")).crossJoin(span(res)).withColumn("inside", F.expr("t BETWEEN lo + 168 AND lo + n - 169"))
    number = lambda c: c.cast("double")
    hours = hours.select("t", F.lit(1.0).alias("full"), number(F.col("inside")).alias("trim"), number(F.col("high")).alias("allocated"), number(F.col("inside") & F.col("high")).alias("both"))
    return res.select("cluster_id", "t", F.col("v").alias("raw"), F.col("r").alias("deseason")).join(hours, "t")


def drawn_blocks(block: int, seed: int) -> str:
    return f"SELECT {block}::BIGINT AS block, rep, size, lo + {drawn_sql('rep', 'j', seed)} % (n - size + 1) AS first FROM (SELECT lo, n, j, least({block}, n - j * {block}) AS size FROM (SELECT lo, n, unnest(range((n + {block} - 1) // {block})) AS j FROM span) WHERE n >= {block}), (SELECT range AS rep FROM range({REPS}))"


KEYS = "block, rep, mask, kind"
#: Moments by hour as running sums, their differences over drawn blocks, covariances, and sums of these over sets.
BOOT = f"""{MASKED}, it AS (SELECT mask, kind, t, '' AS a, '' AS b, 1.0::DOUBLE AS z FROM okk UNION ALL SELECT mask, kind, t, cluster_id, '', r FROM yy UNION ALL SELECT x.mask, x.kind, x.t, x.cluster_id, y.cluster_id, x.r * y.r FROM yy x JOIN yy y USING (mask, kind, t)),
ru AS (SELECT mask, kind, a, b, t + 1 AS t, sum(coalesce(z, 0)) OVER (PARTITION BY mask, kind, a, b ORDER BY t) AS c FROM (SELECT DISTINCT mask, kind, a, b FROM it) CROSS JOIN spine LEFT JOIN it USING (mask, kind, a, b, t) UNION ALL SELECT DISTINCT mask, kind, a, b, lo, 0.0 FROM it, span),
bd AS ({' UNION ALL '.join(drawn_blocks(*x) for x in BLOCKS)}), mo AS (SELECT {KEYS}, s.a, s.b, sum(e.c - s.c) AS z FROM bd JOIN ru s ON s.t = first JOIN ru e USING (mask, kind, a, b) WHERE e.t = first + size GROUP BY ALL),
mn AS (SELECT {KEYS}, round(z) AS hours FROM mo WHERE a = ''), m1 AS (SELECT {KEYS}, a, z / hours AS mean FROM mo JOIN mn USING ({KEYS}) WHERE a <> '' AND b = ''), co AS (SELECT {KEYS}, x.a, x.b, hours, z / hours - p.mean * q.mean AS c FROM mo x JOIN mn USING ({KEYS}) JOIN m1 p USING ({KEYS}, a) JOIN (SELECT {KEYS}, a AS b, mean FROM m1) q USING ({KEYS}, b) WHERE hours >= 24),
se AS (SELECT {KEYS}, p, sum(c) AS v, sum(greatest(c, 0)) FILTER (a = b) AS s2, sum(sqrt(greatest(c, 0))) FILTER (a = b) AS s1 FROM co JOIN (SELECT x.p, x.cluster_id AS a, y.cluster_id AS b FROM po x JOIN po y USING (p)) USING (a, b) GROUP BY ALL),
st AS (SELECT {KEYS}, p, sqrt(greatest(v / nullif(s2, 0), 0)) AS ratio, (v - s2) / nullif(s1 * s1 - s2, 0) AS rho FROM se)"""


@query(f"WITH {BOOT} SELECT block, mask, kind, p, count(*) AS reps, round(quantile_cont(ratio, 0.05), 5) AS ratio_p5, round(quantile_cont(ratio, 0.95), 5) AS ratio_p95, round(quantile_cont(rho, 0.05), 5) AS rho_p5, round(quantile_cont(rho, 0.95), 5) AS rho_p95, quantile_cont(ratio, 0.05) > 1 OR quantile_cont(ratio, 0.95) < 1 AS excludes_one, quantile_cont(rho, 0.05) > 0 OR quantile_cont(rho, 0.95) < 0 AS excludes_zero FROM st GROUP BY ALL")
def covariance_bands(spark, sf_dir):
    """Bands of ratio and weighted correlation over 1,000 replicates of each block length, and whether they leave out
    independence; blocks are differences of running moments, sets are bits."""
    rows = replicates.replicated(masked(spark, sf_dir), "cluster_id", REPS, replicates.covariance_replicates(KINDS, MASKS, BLOCKS), replicates.COVARIANCES, [*KINDS, *MASKS])
    ends = F.array(F.lit(0.05), F.lit(0.95))
    q = rows.groupBy("block", "mask", "kind", "p").agg(F.count("*").alias("reps"), F.percentile("ratio", ends).alias("a"), F.percentile("rho_w", ends).alias("b"))
    r = lambda c, i, n: F.round(F.col(c)[i], 5).alias(n)
    return q.select("block", "mask", "kind", "p", "reps", r("a", 0, "ratio_p5"), r("a", 1, "ratio_p95"), r("b", 0, "rho_p5"), r("b", 1, "rho_p95"), ((F.col("a")[0] > 1) | (F.col("a")[1] < 1)).alias("excludes_one"), ((F.col("b")[0] > 0) | (F.col("b")[1] < 0)).alias("excludes_zero"))
