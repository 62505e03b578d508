"""Power of a facility by hour, from pods, the devices that nobody took, and hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import power
from gridloom.operators.rolling import spine


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def banded(rows: DataFrame, value: str, keys: Sequence[str], digits: int = 6, shares: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(keys, p5, p50, p95) of a value."""
    q = rows.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(x) for x in shares])).alias("q"))
    return q.select(*keys, *[F.round(F.col("q")[i], digits).alias(f"p{x * 100:g}") for i, x in enumerate(shares)])


def cores(usage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cpu_req_cores, cpu_used_cores) of rows with cores and the share of them that is busy."""
    return usage.groupBy(*keys).agg(F.sum("cores").alias("cpu_req_cores"), F.coalesce(F.sum(F.col("cores") * F.col("busy")), F.lit(0.0)).alias("cpu_used_cores"))


def hourly(pods: DataFrame, usage: DataFrame, inventory: DataFrame) -> DataFrame:
    """(t, good, pods, idle_floor, host, online_part) for each hour of the calendar; a missing part counts as 0.

    pods: the model's rows (idle, active); usage: rows with cores; inventory: devices and cores by hour, cluster, spec.
    """
    zero = F.lit(0.0)
    online = (F.col("job_type") == "online_inference") & (F.col("state") != "Standby")
    part = power.tdp() * (1 - power.IDLE) * power.online_offset() * F.col("gpu_hours")
    po = pods.groupBy("t").agg(F.sum("gpu_hours").alias("gh"), F.sum(F.col("idle") + F.col("active")).alias("pods"), F.coalesce(F.sum(F.when(online, part)), zero).alias("online_part"))
    taken = pods.where("spec is not null").groupBy("t", "cluster_id", "spec").agg(F.sum("gpu_hours").alias("gh"))
    free = F.greatest(F.col("gpu_count") - F.coalesce("gh", zero), zero)
    fl = inventory.join(taken, ["t", "cluster_id", "spec"], "left").groupBy("t").agg(F.sum(free * power.tdp() * power.IDLE).alias("idle_floor"), (F.sum("cores") * power.HOST_IDLE).alias("host_idle"))
    ho = usage.groupBy("t").agg((F.sum(F.when(F.col("state") != "Standby", F.col("cores") * F.col("busy"))) * (power.HOST_PEAK - power.HOST_IDLE)).alias("host_busy"))
    out = spine(po).join(po, "t", "left").join(fl.withColumn("known", F.lit(True)), "t", "left").join(ho, "t", "left")
    good = F.coalesce(F.col("gh") > 0, F.lit(False)) & F.col("known").isNotNull()
    return out.select("t", good.alias("good"), F.coalesce("pods", zero).alias("pods"), F.coalesce("idle_floor", zero).alias("idle_floor"), (F.coalesce("host_idle", zero) + F.coalesce("host_busy", zero)).alias("host"), F.coalesce("online_part", zero).alias("online_part"))
