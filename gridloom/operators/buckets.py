"""Tables dealt over buckets by a key, whose joins and distinct counts by that key move no rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.shared import shared_path


def bucket_table(rows: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """rows, written as a table of `buckets` buckets (the session's number of shuffle partitions) by key, sorted in each.

    Rows meet by key once, so that a bucket is one file. What reads the table by its key needs no exchange: groupings,
    distinct counts, and joins with another table of as many buckets. Null keys lie in one bucket; take them out first
    if they are many.
    """
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = rows.repartition(n, key).sortWithinPartitions(key)
    dealt.write.bucketBy(n, key).sortBy(key).option("path", shared_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def local_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join of two tables with the same buckets, a bucket of the one with that of the other, by merging."""
    return left.join(right.hint("merge"), key, how)


def first_by(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """A row for each key: that of the least order, with its columns. In a table with buckets by the key nothing moves."""
    return rows.groupBy(key).agg(F.min(F.struct(order, *columns)).alias("_x")).select(key, f"_x.{order}", *[f"_x.{c}" for c in columns])


def distinct_by(rows: DataFrame, key: str, classes: Sequence[str], *sums: Column) -> DataFrame:
    """(classes, entities, sums): how many keys each class has. In a table with buckets by the key a key is counted in
    its bucket, and only the counts move."""
    own = rows.where(F.col(key).isNotNull()).groupBy(*classes, key).agg(F.count("*").alias("_rows"), *sums)
    names = [c for c in own.columns if c not in (*classes, key, "_rows")]
    return own.groupBy(*classes).agg(F.count("*").alias("entities"), *[F.sum(c).alias(c) for c in names])


def matched(spans: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """spans with the columns of known, and whether there is a row of its key; both with the same buckets."""
    return local_join(spans, known.withColumn("matched", F.lit(True)), key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
