"""As-of and band joins for irregular keys, by equi-keys of bounded groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(rows: DataFrame, known: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], width: float, order: Sequence[str] = (), within: float | None = None) -> DataFrame:
    """rows with the values of the last row of known that has the same keys and isn't later; of equally late ones that of
    the largest `order`, then values. NULL where there is none, or (with `within`) where it is earlier by more than that. Rows with a
    null key or time are kept, and meet nothing; known rows with one are left out. `known_at` is the time of the match.

    Rows of both sides meet by keys and stretches of `width`, so that a key with most of the rows is dealt over tasks;
    each stretch starts with the last row of the stretches before it, found in a table of a row for each key and stretch.
    Within a stretch a window carries the last known row on.
    """
    stretch = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    entry = F.struct(F.col(at).alias("at"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    there = F.col(at).isNotNull()
    for k in keys:
        there = there & F.col(k).isNotNull()
    source = known.where(there).select(*keys, stretch(at).alias("_s"), F.col(at).alias("_at"), entry.alias("_e"))
    last = source.groupBy(*keys, "_s").agg(F.max("_e").alias("_e"))
    marks = last.unionByName(rows.where(there).select(*keys, stretch(at).alias("_s")).distinct(), allowMissingColumns=True).groupBy(*keys, "_s").agg(F.max("_e").alias("_e"))
    before = F.last("_e", True).over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    carried = marks.select(*keys, "_s", before.alias("_e")).where("_e is not null").select(*keys, "_s", F.lit(None).cast(rows.schema[at].dataType).alias("_at"), "_e")

    side = lambda df, n: df.withColumn("_side", F.lit(n))
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    left = rows.select(own.alias("_row"), *keys, F.when(there, stretch(at)).alias("_s"), F.col(at).alias("_at"))
    # rows that meet nothing are spread by their hash
    left = left.withColumn("_odd", F.when(F.col("_s").isNull(), F.xxhash64("_row")))
    both = side(left, 2).unionByName(side(source, 1), allowMissingColumns=True).unionByName(side(carried, 0), allowMissingColumns=True)
    seen = Window.partitionBy(*keys, "_s", "_odd").orderBy(F.col("_at").asc_nulls_first(), "_side", F.col("_e").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_e", F.last("_e", True).over(seen)).where("_side = 2")
    hit = F.col("_s").isNotNull()
    if within is not None:
        hit = hit & (F.col("_at") - F.col("_e.at") <= F.lit(within))
    return out.select("_row.*", F.when(hit, F.col("_e.at")).alias("known_at"), *[F.when(hit, F.col(f"_e.v{i}")).alias(c) for i, c in enumerate(values)])


def band(rows: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, width: float, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """rows with the spans lo <= at < hi that hold them (of the same keys): a span has a row for each stretch of `width`
    that it touches, a row has one, so that the join is one of equal keys and stretches. Choose width about as long as a
    span is."""
    stretch = lambda c: F.floor(c / F.lit(width)).cast("long")
    last = F.greatest(F.ceil(F.col(hi) / F.lit(width)).cast("long") - 1, stretch(F.col(lo)))
    dealt = spans.where(F.col(lo) < F.col(hi)).withColumn("_s", F.explode(F.sequence(stretch(F.col(lo)), last)))
    left = rows.withColumn("_s", stretch(F.col(at)))
    left, dealt = left.alias("a"), dealt.alias("b")
    on = F.col("a._s") == F.col("b._s")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    met = left.join(dealt, on & (F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi)), how)
    return met.select("a.*", *[F.col(f"b.`{c}`") for c in spans.columns if c not in keys]).drop("_s")


def interpolated_at(rows: DataFrame, knots: DataFrame, at: str, name: str, keys: Sequence[str] = (), x: str = "u", y: str = "c") -> DataFrame:
    """rows with the value at a place on the line through knots (keys, x, y), flat beyond the first and the last; NULL
    where a key has no knot. The stretches are as wide as knots lie apart on average."""
    w = Window.partitionBy(*keys).orderBy(x)
    spans = knots.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.lead(x).over(w).alias("_nx"), F.lead(y).over(w).alias("_ny"))
    ends = knots.groupBy(*keys).agg(F.min(x).alias("_a"), F.min_by(y, x).alias("_ya"), F.max(x).alias("_b"), F.max_by(y, x).alias("_yb"))
    size = knots.agg(F.max(x).alias("b"), F.min(x).alias("a"), F.count("*").alias("n")).first()
    width = (size.b - size.a) / size.n if size.n and size.b > size.a and math.isfinite(size.b - size.a) else 1.0
    met = band(rows, spans.where("_nx is not null"), at, "_x", "_nx", width, keys, "left")
    met = met.join(ends, list(keys), "left") if keys else met.crossJoin(ends)  # a row of knots' ends
    line = F.col("_y") + (F.col("_ny") - F.col("_y")) * (F.col(at) - F.col("_x")) / (F.col("_nx") - F.col("_x"))
    value = F.when(F.col(at) < F.col("_a"), F.col("_ya")).when(F.col(at) >= F.col("_b"), F.col("_yb")).otherwise(F.when(F.col("_y") == F.col("_ny"), F.col("_y")).otherwise(line))
    return met.withColumn(name, value).drop("_x", "_y", "_nx", "_ny", "_a", "_ya", "_b", "_yb")
