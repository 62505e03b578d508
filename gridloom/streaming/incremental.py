"""Usage statistics of a stream: each micro-batch adds partial sums, and readers merge them.

The statistics are sums, so a batch's part is written under its number and a repeated batch replaces its own part; late
rows need no special case, since their hour gets one more part. For consumers that want closed hours only, hourly()
keeps windows behind a watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators import rollups


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 8) -> DataFrame:
    """The event table (a file, or a directory of files) as a stream."""
    path = f"{sf_dir}/events.parquet"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs_path).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def usage(events: DataFrame) -> DataFrame:
    """Rows (t, cluster_id, w, u) of events, streamed or not."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    t = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return events.select(t.alias("t"), F.col("event_type").alias("cluster_id"), F.col("value").alias("w"), F.when(k >= 10, k / F.lit(100.0)).alias("u"))


def accumulate(stream: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Run the stream to its end for now, adding parts below path; returns the merged statistics so far."""

    def add(batch: DataFrame, number: int) -> None:
        rollups.sufficient(batch, keys).write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    fields = rollups.sufficient(spark.createDataFrame([], stream.schema), keys).schema.fields
    return rollups.merged(spark.read.schema(T.StructType(fields)).parquet(f"{path}/parts"), keys)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(start, cluster_id, v, n) of tumbling hours behind a watermark; rows that come later than that are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("cluster_id"))
    return w.agg(F.sum("value").alias("v"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "cluster_id", "v", "n")


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(start, user_id, n, v): sessions of a user's events, closed by a gap."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("session_window.start").alias("start"), "user_id", "n", "v")
