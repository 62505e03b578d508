"""Sources and sinks: each writes to the shared folder, reads back, and gives what SQL finds in the tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import power
from gridloom.operators.rolling import firm, fleet
from gridloom.operators.rollups import number_of
from gridloom.plans.firm_queries import k_sql, m_sql
from gridloom.plans.model_queries import STATS, statistics
from gridloom.plans.registry import query
from gridloom.plans.rollup_queries import CRC, PARSED
from gridloom.sources import files, tables
from gridloom.sources.shared import shared_path
from gridloom.sources.tables import FLEET, TELE, table, telemetry


def usage_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = telemetry(spark, sf_dir).groupBy("t", "cluster_id").agg(F.sum("w").alias("w"), F.max("k").alias("k"))
    return sums.select("cluster_id", "w", "k", F.expr("cast(t div 24 AS int)").alias("day"), F.expr("cast(t % 24 AS int)").alias("hour"))


def partitioned(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = shared_path(spark, name)
    usage_by_hour(spark, sf_dir).repartition("day").write.partitionBy("day", "hour").parquet(path)
    return path


HOURLY = f"{TELE}, hu AS (SELECT t // 24 AS day, t % 24 AS hour, cluster_id, sum(w) AS w, max(k) AS k FROM tele GROUP BY ALL)"
SCHEMA = "cluster_id string, w double, k int"


@query(f"WITH {HOURLY} SELECT day::INT AS day, hour::INT AS hour, count(*) AS n, round(sum(w), 4) AS w FROM hu WHERE day BETWEEN 3 AND 9 GROUP BY ALL")
def partition_scan(spark, sf_dir):
    """A table under day and hour directories; the days asked for are the only ones that are read."""
    rows = tables.partitioned(spark, partitioned(spark, sf_dir, "days"), f"{SCHEMA}, day int, hour int").where("day BETWEEN 3 AND 9")
    return rows.groupBy("day", "hour").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("w"))


@query(f"WITH {HOURLY} SELECT day::INT AS day, count(*) AS n, count(DISTINCT hour) AS hours, round(sum(w), 4) AS w FROM hu GROUP BY ALL")
def path_values(spark, sf_dir):
    """The same files with the values taken from their paths."""
    rows = files.by_path(spark, partitioned(spark, sf_dir, "paths"), SCHEMA, ["day", "hour"])
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("hour").alias("hours"), F.round(F.sum("w"), 4).alias("w"))


@query(f"WITH {HOURLY}, d AS (SELECT list(DISTINCT day ORDER BY day) AS a FROM hu), m AS (SELECT unnest(a[greatest(1, (len(a) - 3) // 2 + 1):greatest(1, (len(a) - 3) // 2 + 1) + 2]) AS day FROM d) SELECT CASE WHEN max(k) > 1.5 THEN 100.0 ELSE 1.0 END::DOUBLE AS divisor FROM hu WHERE hour = 12 AND day IN (SELECT day FROM m)")
def sampled_scale(spark, sf_dir):
    """Whether a column holds percentages, from a few hours of the middle days."""
    return files.sampled_divisor(tables.partitioned(spark, partitioned(spark, sf_dir, "scale"), f"{SCHEMA}, day int, hour int"), "k")


COUNTED = ["orders", "lineitem", "events", "customer", "part"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in COUNTED))
def footer_counts(spark, sf_dir):
    """Row counts without reading a column."""
    return files.row_counts(spark, {t: f"{sf_dir}/{t}.parquet" for t in COUNTED})


DEMAND = "d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / 1000 AS x, count(*) AS n FROM orders GROUP BY 1)"


@query(f"WITH {DEMAND} SELECT day::VARCHAR AS day, CASE WHEN n % 5 <> 0 THEN round(x, 3) END AS demand FROM d")
def demand_csv(spark, sf_dir):
    """A CSV with text times and numbers that don't all parse, written and read again."""
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice") / 1000, 3).alias("x"), F.count("*").alias("n"))
    text = d.select(F.date_format(F.col("day").cast("timestamp") + F.expr("INTERVAL 13 HOURS"), "MM/dd/yyyy hh:mm:ss a").alias("utc_end"), F.when(F.col("n") % 5 != 0, F.col("x").cast("string")).otherwise("n/a").alias("demand_mw"))
    path = shared_path(spark, "demand")
    files.csv(text.unionByName(text.where("demand_mw = 'n/a'")).unionByName(spark.createDataFrame([("no time", "1")], "utc_end string, demand_mw string")), path)
    return tables.demand_csv(spark, path).select(F.to_date("ts").cast("string").alias("day"), F.round("demand_mw", 3).alias("demand"))


@query("SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, min(o_custkey) AS low, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def sessions_csv(spark, sf_dir):
    """A few columns of a CSV by a declared schema, dates included."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("start"), "o_totalprice")
    path = shared_path(spark, "sessions")
    files.csv(o, path)
    rows = spark.read.option("header", True).schema("o_orderkey long, o_custkey long, start timestamp_ntz, o_totalprice double").csv(path).select("start", "o_custkey", "o_totalprice")
    return rows.groupBy(F.to_date("start").cast("string").alias("day")).agg(F.min("o_custkey").alias("low"), F.round(F.sum("o_totalprice"), 2).alias("total"))


#: A part's price as a text: a number, about a number, a range, or its brand.
PRICED = "CASE p_size % 4 WHEN 0 THEN cast(p_size AS {text}) WHEN 1 THEN concat('~', cast(p_size AS {text}), '.5') WHEN 2 THEN concat(cast(p_size AS {text}), ' - ', cast(p_size + 3 AS {text})) ELSE p_brand END"


@query(f"WITH x AS (SELECT p_partkey, {PRICED.format(text='VARCHAR')} AS s FROM part), {PARSED} SELECT p_partkey, s, number FROM z")
def facts_csv(spark, sf_dir):
    """Facts as they stand in a CSV, parsed after they are read."""
    path = shared_path(spark, "facts")
    x = table(spark, sf_dir, "part").select("p_partkey", F.expr(PRICED.format(text="STRING")).alias("s"))
    x.write.option("header", True).option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.text_table(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), F.coalesce("s", F.lit("")).alias("s"), number_of("s").alias("number"))


VARIANT = {"idle_frac": {"base": 0.25, "range": [0.15, 0.25]}, "pue": {"base": 1.3}, "gpu_tdp_w": {"A10": 160.0}}


@query(f"WITH {STATS} SELECT round(sum(1.3 * (CASE WHEN spec = 'A10' THEN 160.0 ELSE {power.TDP_SQL} END * 0.25 * gpu_hours)), 2) AS variant, round(sum({power.PUE} * ({power.TDP_SQL} * {power.IDLE} * gpu_hours)), 2) AS base FROM st")
def config_variant(spark, sf_dir):
    """Idle energy under the parameters of a configuration file, in JSON and in YAML, and under the base ones."""
    path, text = shared_path(spark, "config"), json.dumps(VARIANT)
    lines = [f"{k}:" + "".join(f"\n  {a}: {json.dumps(b)}" for a, b in v.items()) for k, v in VARIANT.items()]
    for end, value in ((".json", text), (".yaml", "\n".join(["# a variant", *lines]))):
        spark.createDataFrame([(value,)], "value string").coalesce(1).write.text(path + end)
    read = files.config(spark, path + ".yaml")
    if read != files.config(spark, path + ".json"):
        raise ValueError("the YAML and the JSON configuration differ")
    doc = files.json_document(spark, path + ".json").select("idle_frac.base", "pue.base").first()
    p = power.configured(read)
    if (doc[0], doc[1]) != (p["phi"], p["pue"]):
        raise ValueError("the document and the configuration differ")
    st = statistics(spark, sf_dir)
    own = F.when(F.col("spec").isin(list(p["tdp"])), F.element_at(F.create_map(*[F.lit(x) for kv in p["tdp"].items() for x in kv]), F.when(F.col("spec").isin(list(p["tdp"])), F.col("spec")))).otherwise(power.tdp())
    return st.agg(F.round(F.sum(p["pue"] * own * p["phi"] * F.col("gpu_hours")), 2).alias("variant"), F.round(F.sum(power.PUE * power.tdp() * power.IDLE * F.col("gpu_hours")), 2).alias("base"))


@query(f"WITH {HOURLY} SELECT day::INT AS day, round(sum(w) * CASE WHEN day = 5 THEN 2 ELSE 1 END, 4) AS w FROM hu GROUP BY day")
def restartable_sink(spark, sf_dir):
    """Days written in two runs: the second takes only those that are missing, and one day is replaced by itself."""
    rows = usage_by_hour(spark, sf_dir)
    path = shared_path(spark, "restart")
    tables.write_days(rows.where("day < 10"), path)
    done = spark.read.parquet(path)
    tables.write_days(tables.missing_days(rows, done.select("day")), path)
    tables.write_days(rows.where("day = 5").withColumn("w", 2 * F.col("w")), path)
    return tables.partitioned(spark, path, f"{SCHEMA}, hour int, day int").groupBy("day").agg(F.round(F.sum("w"), 4).alias("w"))


@query(f"WITH {HOURLY} SELECT cluster_id, round(sum(w), 4) AS w FROM hu GROUP BY 1")
def cached_table(spark, sf_dir):
    """A table that is written once: the second writer leaves it as it is."""
    path = shared_path(spark, "cache")
    rows = usage_by_hour(spark, sf_dir).groupBy("cluster_id").agg(F.round(F.sum("w"), 4).alias("w"))
    files.if_absent(rows, path)
    return files.if_absent(rows.withColumn("w", F.lit(0.0)), path)


@query(f"WITH {TELE} SELECT CAST({CRC.format(s='(pod_id::VARCHAR)')} % 16 AS INTEGER) AS bucket, count(*) AS n, count(DISTINCT pod_id) AS pods, round(sum(w), 4) AS w FROM tele GROUP BY 1")
def bucketed_sink(spark, sf_dir):
    """Entities dealt over buckets; an entity lies in one bucket alone, so that distinct counts add up."""
    path = shared_path(spark, "buckets")
    files.bucketed(telemetry(spark, sf_dir).select("pod_id", "w"), path, "pod_id")
    rows = spark.read.schema("pod_id long, w double, bucket int").parquet(path)
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("pod_id").alias("pods"), F.round(F.sum("w"), 4).alias("w"))


@query(f"WITH {HOURLY}, f AS (SELECT *, row_number() OVER (ORDER BY 'day=' || day || '/hour=' || hour || '/') - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day, hour FROM hu)), s AS (SELECT day, hour FROM f WHERE n <= 3 OR (i * 3) // n > ((i - 1) * 3) // n AND i > 0 OR i = 0) SELECT day::INT AS day, hour::INT AS hour, count(*) AS n, CASE WHEN max(k) > 1.5 THEN 100.0 ELSE 1.0 END::DOUBLE AS divisor FROM hu JOIN s USING (day, hour) GROUP BY ALL")
def sampled_by_file(spark, sf_dir):
    """Three of all files, evenly spread; whether a column holds percentages, by each."""
    rows = files.sampled_files(spark, partitioned(spark, sf_dir, "files"), f"{SCHEMA}, day int, hour int", 3)
    return rows.groupBy("day", "hour").agg(F.count("*").alias("n"), F.when(F.max("k") > 1.5, 100.0).otherwise(1.0).alias("divisor"))


SUMMARY = f"WITH {FLEET}, m AS ({m_sql('fleet', [1, 4])}), k AS ({k_sql('m', shares=[0.95])}), su AS (SELECT 'k_' || h AS name, round(k, 3) AS value FROM k)"


@query(f"{SUMMARY} SELECT 'json' AS kind, name AS line, value FROM su UNION ALL SELECT 'markdown', '- **' || name || '**: ', value FROM su")
def summary_sinks(spark, sf_dir):
    """Results as JSON rows and as lines of a list, written and read back."""
    k = firm(fleet(telemetry(spark, sf_dir)), [1, 4], [0.95]).select(F.concat(F.lit("k_"), F.col("h")).alias("name"), F.round("k", 3).alias("value"))
    a, b = shared_path(spark, "summary"), shared_path(spark, "lines")
    k.write.json(a)
    files.markdown(k, "name", "value").write.text(b)
    lines = spark.read.text(b).select(F.lit("markdown").alias("kind"), F.regexp_extract("value", r"^(.*: )", 1).alias("line"), F.regexp_extract("value", r": (.*)$", 1).cast("double").alias("value"))
    return spark.read.schema("name string, value double").json(a).select(F.lit("json").alias("kind"), F.col("name").alias("line"), "value").unionByName(lines)


@query(f"WITH {FLEET} SELECT count(*) AS hours, 0 AS differ FROM fleet")
def compare_saved(spark, sf_dir):
    """A saved series beside the same one made again: how many hours differ."""
    f = fleet(telemetry(spark, sf_dir))
    saved = files.if_absent(f.withColumnRenamed("v", "x"), shared_path(spark, "series"))
    both = f.join(saved, "t", "full")
    return both.agg(F.count("*").alias("hours"), F.sum((~F.col("v").eqNullSafe(F.col("x"))).cast("int")).cast("int").alias("differ"))


@query()
def provenance(spark, sf_dir):
    """Names, sizes and digests of input files, who read them, where and when."""
    return files.provenance(spark, f"{sf_dir}/nation.parquet").unionByName(files.provenance(spark, f"{sf_dir}/region.parquet"))
