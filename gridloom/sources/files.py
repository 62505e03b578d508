"""File sources and sinks beside plain tables: partitions by path, text tables, configurations, summaries, provenance."""

from __future__ import annotations

import hashlib
import json
import os
import re
import socket
import subprocess
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_path(spark: SparkSession, root: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The files below root with whole-number key=value parts of their paths as columns, where directories aren't to be
    taken as partitions (keys that some paths lack are NULL there)."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(root)
    return rows.withColumns({k: F.regexp_extract("_metadata.file_path", rf"/{k}=(\d+)/", 1).try_cast("int") for k in keys})


def sampled_divisor(rows: DataFrame, column: str, day: str = "day", hour: str = "hour", days: int = 3, at: int = 12) -> DataFrame:
    """(divisor): 100 where a column of shares holds percentages (a maximum over 1.5), by the middle days' rows of one
    hour alone; partitions by day and hour are pruned to these."""
    known = rows.select(day).distinct()
    middle = known.agg(F.sort_array(F.collect_set(day)).alias("all")).select(F.explode(F.expr(f"slice(all, greatest(1, cast((size(all) - {days}) div 2 AS int) + 1), {days})")).alias(day))
    return rows.where(F.col(hour) == at).join(middle, day, "left_semi").agg(F.when(F.max(column) > 1.5, 100.0).otherwise(1.0).alias("divisor"))


def row_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(name, n): rows of Parquet tables. No column is read, so that Spark takes the counts from the files' footers."""
    out = None
    for name, path in paths.items():
        one = spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every value as it stands."""
    return spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document (or several) as rows."""
    return spark.read.option("multiLine", True).json(path)


def config(spark: SparkSession, path: str) -> dict[str, Any]:
    """A YAML or JSON file of parameters, on the driver; nested values stay nested."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml  # where it is installed

        return yaml.safe_load(text)
    return json.loads(text)


def if_absent(rows: DataFrame, path: str) -> DataFrame:
    """What is at path; written first if nothing is."""
    rows.write.mode("ignore").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bucket(column: str, buckets: int = 16) -> Column:
    """The CRC-32 of a value's text, modulo buckets."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(buckets))


def bucketed(rows: DataFrame, path: str, column: str, buckets: int = 16) -> None:
    """Write rows so that equal values of a column lie in one bucket's directory; equal values meet in one task first."""
    rows.withColumn("bucket", bucket(column, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def markdown(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(value): a line of a list for each row."""
    return rows.select(F.concat(F.lit("- **"), F.col(name), F.lit("**: "), F.col(value).cast("string")).alias("value"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified) of the files at path or below that aren't empty; their contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def sampled_files(spark: SparkSession, path: str, schema: str, most: int = 3) -> DataFrame:
    """The rows of `most` files, evenly spread over the files at path in order of their names; no other file is opened.
    `path` of a row's file goes along."""
    files = listing(spark, path).where("path LIKE '%.parquet'").select("path")
    n = files.agg(F.count("*").alias("n"))
    ranked = files.withColumn("i", F.row_number().over(Window.orderBy("path")) - 1).crossJoin(n)  # a row for each file
    take = ranked.where(F.expr(f"n <= {most} OR (i * {most}) div n > ((i - 1) * {most}) div n OR i = 0")).limit(most).select("path").collect()
    return spark.read.schema(schema).option("basePath", path).parquet(*sorted(r.path for r in take)).withColumn("path", F.col("_metadata.file_path"))


def revision(folder: str | None = None) -> str | None:
    """The checked-out revision of a folder (this code's, if none is named), where git can tell."""
    try:
        out = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder or os.path.dirname(os.path.abspath(__file__)), capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return None
    return out.stdout.strip() or None


def hashed(path: str, chunk: int) -> tuple[str, int]:
    """(SHA-256, chunks) of a file, read through its file system a chunk at a time."""
    uri = path if re.match(r"\w[\w+.-]+://", path) else "file://" + re.sub(r"^file:/*", "/", path)
    source, name = fs.FileSystem.from_uri(uri)
    digest, n = hashlib.sha256(), 0
    with source.open_input_stream(name) as f:
        while data := f.read(chunk):
            digest.update(data)
            n += 1
    return digest.hexdigest(), n


def provenance(spark: SparkSession, path: str, chunk: int = 8 << 20) -> DataFrame:
    """(path, name, bytes, sha256, chunks, modified, host, revision, spark, read_at) of the files at path: what was read,
    when, by which code, and where. Files are dealt over tasks, each reads its own in chunks, so they may be of any size."""
    rows = listing(spark, path)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    code = revision()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed(x, chunk) for x in batch.column("path").to_pylist()]
            n = batch.num_rows
            out = [batch.column(c) for c in ("path", "bytes", "modified")] + [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([socket.gethostname()] * n, pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["path", "bytes", "modified", "sha256", "chunks", "host"])

    out = rows.repartition(tasks, "path").mapInArrow(run, "path string, bytes long, modified timestamp, sha256 string, chunks long, host string")
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return out.select("path", name, "bytes", "sha256", "chunks", "modified", "host", F.lit(code).alias("revision"), F.lit(spark.version).alias("spark"), F.current_timestamp().alias("read_at"))
