"""Joins without an exchange, and as-of and band joins, against plain Python; their plans."""

import random

import pytest

from gridloom.operators import asof, buckets
from gridloom.plans import join_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_bucket_join_moves_nothing(spark):
    r = random.Random(1)
    a = [(r.choice([None, *range(50)]), r.random()) for _ in range(400)]
    b = [(r.randrange(80), f"x{i}") for i in range(40)]
    left = buckets.bucket_table(spark.createDataFrame(a, "k long, w double"), "a", "k", 5)
    right = buckets.bucket_table(spark.createDataFrame(b, "k long, name string"), "b", "k", 5)
    one = buckets.first_by(right, "k", "name")
    got = buckets.matched(left, one, "k")
    assert "Exchange" not in plan(got) and "SortMergeJoin" in plan(got)
    want = {}
    for k, name in b:
        want[k] = min(want.get(k, name), name)
    assert sorted(((x.k, x.w, x.name, x.matched) for x in got.collect()), key=str) == sorted(((k, w, want.get(k), k in want) for k, w in a), key=str)
    count = buckets.distinct_by(left, "k", [])
    assert plan(count).count("Exchange") == 1 and count.first().entities == len({k for k, _ in a} - {None})


def test_the_join_query_has_one_exchange(spark, sf_dir):
    spans, jobs = join_queries.spans_and_jobs(spark, sf_dir)
    assert "Exchange" not in plan(buckets.matched(spans, jobs, "pod_id"))


@pytest.mark.parametrize("width", [0.5, 3.0, 1000.0])
def test_asof(spark, width):
    r = random.Random(3)
    known = [(r.choice(["a", "b", None]), r.choice([None, *range(-20, 40)]), i) for i in range(30)]
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), r.choice([None, -30.0, 2.5, r.randint(-25, 60)])) for i in range(200)]
    rows = [(i, k, None if t is None else float(t)) for i, k, t in rows]
    left = spark.createDataFrame(rows, "id long, k string, t double")
    right = spark.createDataFrame([(k, None if t is None else float(t), v) for k, t, v in known], "k string, t double, v long")
    for within in (None, 4.0):
        got = {x.id: (x.known_at, x.v) for x in asof.asof(left, right, ["k"], "t", ["v"], width, within=within).collect()}
        assert len(got) == 200
        for i, k, t in rows:
            hits = [(s, v) for q, s, v in known if k is not None and t is not None and q == k and s is not None and s <= t]
            best = max(hits, default=(None, None))
            assert got[i] == (best if best[0] is None or within is None or t - best[0] <= within else (None, None)), (i, k, t)


def test_asof_deals_out_a_key_with_most_rows(spark):
    left = spark.range(20_000).selectExpr("id", "1 AS k", "cast(id AS double) AS t")
    right = spark.range(0, 20_000, 1500).selectExpr("1 AS k", "cast(id AS double) AS t", "id AS v")
    out = asof.asof(left, right, ["k"], "t", ["v"], 100.0)
    assert out.where("v <> 1500 * (id div 1500)").count() == 0 and out.where("v is null").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = asof.asof(left, right, ["k"], "t", ["v"], 100.0).selectExpr("v", "spark_partition_id() AS p").groupBy("p").agg({"v": "count"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 6 and max(x["count(v)"] for x in sizes) < 8000


def test_band(spark):
    r = random.Random(5)
    rows = [(i, r.choice("ab"), r.uniform(-5, 25)) for i in range(150)]
    spans = [(j, r.choice("ab"), x := r.uniform(-5, 20), x + r.choice([-1.0, 0.0, 0.5, 7.0])) for j in range(25)]
    left, right = spark.createDataFrame(rows, "i long, k string, t double"), spark.createDataFrame(spans, "j long, k string, lo double, hi double")
    got = sorted((x.i, x.j) for x in asof.band(left, right, "t", "lo", "hi", 1.0, ["k"]).collect())
    assert got == sorted((i, j) for i, k, t in rows for j, q, lo, hi in spans if k == q and lo <= t < hi) and got
    joined = plan(asof.band(left, right, "t", "lo", "hi", 1.0, ["k"]))
    assert "NestedLoop" not in joined and "Cartesian" not in joined


def test_interpolated_at(spark):
    import numpy as np

    r = random.Random(6)
    knots = {"a": sorted((r.uniform(0, 9), r.uniform(-2, 2)) for _ in range(9)), "b": [(3.0, 1.5)]}
    rows = [(i, r.choice(["a", "b", "c"]), r.uniform(-3, 12)) for i in range(200)]
    k = spark.createDataFrame([(q, x, y) for q, v in knots.items() for x, y in v], "k string, u double, c double")
    out = asof.interpolated_at(spark.createDataFrame(rows, "i long, k string, t double"), k, "t", "y", ["k"])
    assert "NestedLoop" not in plan(out)
    got = {x.i: x.y for x in out.collect()}
    for i, q, t in rows:
        want = float(np.interp(t, *zip(*knots[q], strict=True))) if q in knots else None
        assert got[i] == (pytest.approx(want) if want is not None else None)
