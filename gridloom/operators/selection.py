"""Exact order statistics of groups of any size, by passes that narrow down where a rank lies.

`percentile` keeps every distinct value of a group in one buffer. Here a pass takes approximate cuts of what is left of
a group (a sketch, merged map-side) and counts exactly how many values lie below, at and between two of them that hold
the rank; the next pass looks between these alone. A pass leaves about a fiftieth of the values, so a group of 10**12
needs four. At the end at most `limit` values of a group meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.shared import shared_path

CUTS = 128


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _met(values: DataFrame, open_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values strictly inside the interval of each rank; null keys are groups, and so meet null-safely."""
    on = F.lit(True)
    for k in keys:
        on = on & values[k].eqNullSafe(open_[k])
    met = values.join(open_, on) if keys else values.crossJoin(open_)
    low, high = F.col("_low").isNull() | (F.col("_v") > F.col("_low")), F.col("_high").isNull() | (F.col("_v") < F.col("_high"))
    return met.where(low & high).select(*[open_[k] for k in keys], "_rank", "_low", "_high", "_below", "_v")


def ranked(rows: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, limit: int) -> DataFrame:
    """(keys, _rank, _v): the value of each rank (from 0) in the order of a group's values; ranks: (keys, _rank), distinct.
    rows is read two times a pass; it should be a table. Values are not NULL or NaN."""
    values = rows.select(*keys, F.col(value).alias("_v"))
    none = F.lit(None).cast(rows.schema[value].dataType)
    state = _kept(ranks.select(*keys, "_rank", none.alias("_low"), none.alias("_high"), F.lit(0).cast("long").alias("_below")), "ranks")
    same = [*keys, "_rank", "_low", "_high", "_below"]
    found: list[DataFrame] = []
    while True:
        inside = _kept(_met(values, state, keys).groupBy(*same).agg(F.count("*").alias("_n"), F.percentile_approx("_v", [i / CUTS for i in range(CUTS + 1)], 20 * CUTS).alias("_c")), "cuts")
        few = inside.where(F.col("_n") <= limit)
        held = _met(values, few.select(*same), keys).groupBy(*same).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        found.append(_kept(held.select(*keys, "_rank", F.col("_all")[(F.col("_rank") - F.col("_below")).cast("int")].alias("_v")), "found"))
        many = inside.where(F.col("_n") > limit)
        if many.isEmpty():
            break
        at = F.floor((F.col("_rank") - F.col("_below")) * CUTS / F.col("_n")).cast("int")
        many = many.select(*same, F.col("_c")[F.greatest(at - 1, F.lit(0))].alias("_a"), F.col("_c")[F.least(at + 2, F.lit(CUTS))].alias("_b"))
        plain = many.select(*[F.col(c).alias(c) for c in (*same, "_a", "_b")])
        both = _met_with(values, plain, keys, same)
        count = lambda test: F.sum(test.cast("long"))
        v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
        n = both.groupBy(*same, "_a", "_b").agg(count(v < a).alias("n1"), count(v == a).alias("n2"), count((v > a) & (v < b)).alias("n3"), count((v == b) & (b > a)).alias("n4"))
        r, upto, total, where = F.col("_rank") - F.col("_below"), [], F.lit(0), F.lit(None)
        for c in ("n1", "n2", "n3", "n4"):
            total = total + F.col(c)
            upto.append(total)
        where = F.when(r < upto[0], 0).when(r < upto[1], 1).when(r < upto[2], 2).when(r < upto[3], 3).otherwise(4)
        n = _kept(n.withColumn("_at", where).withColumns({f"_u{i}": u for i, u in enumerate(upto)}), "counts")
        found.append(n.where("_at IN (1, 3)").select(*keys, "_rank", F.when(F.col("_at") == 1, a).otherwise(b).alias("_v")))
        low = F.when(F.col("_at") == 0, F.col("_low")).when(F.col("_at") == 2, a).otherwise(b)
        high = F.when(F.col("_at") == 0, a).when(F.col("_at") == 2, b).otherwise(F.col("_high"))
        below = F.col("_below") + F.when(F.col("_at") == 0, F.lit(0)).when(F.col("_at") == 2, F.col("_u1")).otherwise(F.col("_u3"))
        state = _kept(n.where("_at IN (0, 2, 4)").select(*keys, "_rank", low.alias("_low"), high.alias("_high"), below.alias("_below")), "ranks")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _met_with(values: DataFrame, cut: DataFrame, keys: Sequence[str], same: Sequence[str]) -> DataFrame:
    """As _met(), with the cuts of each rank."""
    own = [f"_k{i}" for i in range(len(keys))]
    cut = cut.withColumnsRenamed(dict(zip(keys, own, strict=True)))
    on = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(o))
    met = values.join(cut, on) if keys else values.crossJoin(cut)
    low, high = F.col("_low").isNull() | (F.col("_v") > F.col("_low")), F.col("_high").isNull() | (F.col("_v") < F.col("_high"))
    return met.where(low & high).select(*same, "_a", "_b", "_v")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], limit: int = 100_000) -> DataFrame:
    """(keys, share, q, n): quantiles on the line between the two values next to them, as `percentile` gives, of groups of
    any size. NULL and NaN values are left out; groups without any have no row."""
    values = _kept(rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_x")), "values")
    size = values.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 0")
    place = size.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("_p", (F.col("n") - 1) * F.col("share"))
    place = _kept(place.select(*keys, "n", "share", "_p", F.floor("_p").cast("long").alias("_i"), F.ceil("_p").cast("long").alias("_j")), "places")
    ranks = place.select(*keys, F.explode(F.array("_i", "_j")).alias("_rank")).distinct()
    got = ranked(values, keys, "_x", ranks, limit).withColumn("_x", F.col("_v"))
    both = place.select(*keys, "n", "share", "_p", "_i", F.explode(F.array("_i", "_j")).alias("_rank"))
    own = [f"_k{i}" for i in range(len(keys))]
    got = got.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col("_rank").alias("_r"), "_v")
    on = F.col("_rank") == F.col("_r")
    for k, o in zip(keys, own, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(o))
    line = F.min("_v") + (F.max("_v") - F.min("_v")) * (F.first("_p") - F.first("_i"))
    return both.join(got, on).groupBy(*keys, "share", "n").agg(line.alias("q")).select(*keys, "share", "q", "n")
