"""Small cases with known results, and numpy versions of the core operators."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import power
from gridloom.operators import backtest, covariance, events, facility, facts, fitting, resample, rolling, rollups, screen
from gridloom.plans import facility_queries, registry
from gridloom.sources import files, tables

from .compare import connect, differences


def series(spark, values, **more):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "t long, v double")


def np_minima(v, h):
    v = np.array([np.nan if x is None else x for x in v], float)
    out = [v[i : i + h].min() for i in range(len(v) - h + 1)]
    return [x for x in out if not np.isnan(x)]


def test_windows_over_gaps_drop(spark):
    assert [r.m for r in rolling.minima(series(spark, [1, None, 2, 3]), [2]).collect()] == [2.0]
    assert rolling.minima(series(spark, [1, None, 2]), [2]).count() == 0


def test_levels_as_numpy(spark):
    r = random.Random(1)
    v = [None if r.random() < 0.1 else r.randint(0, 90) for _ in range(200)]
    got = {(x.h, x.alpha): (x.k, x.n_windows) for x in rolling.firm(series(spark, v), [1, 3, 6], [0.5, 0.9, 0.95]).collect()}
    for (h, a), (k, n) in got.items():
        m = np_minima(v, h)
        assert n == len(m) and k == pytest.approx(np.quantile(m, 1 - a))
    for h in (1, 3, 6):
        assert got[h, 0.5][0] >= got[h, 0.9][0] >= got[h, 0.95][0]
    half = {(x.h, x.alpha): x.k for x in rolling.firm(series(spark, [None if x is None else x / 2 for x in v]), [1, 3], [0.9]).collect()}
    assert all(k == pytest.approx(got[key][0] / 2) for key, k in half.items())


def test_equal_starts_are_monotone_and_parts_do_not_add(spark):
    v = [2, 5, 1, 4, 3, 6]
    m = {(x.t, x.h): x.m for x in rolling.minima(series(spark, v), [1, 2, 3]).collect()}
    assert all(m[t, 1] >= m[t, 2] >= m[t, 3] for t in range(4))
    k = lambda x: rolling.firm(series(spark, x), [1], [0.95]).first().k
    assert k([10, 10]) != k([0, 10]) + k([10, 0])


def test_one_missing_hour_of_4440(spark):
    v = [None if i == 126 else 1 for i in range(4440)]
    assert {x.h: x.n_windows for x in rolling.firm(series(spark, v), [1, 4, 24], [0.95]).collect()} == {1: 4439, 4: 4433, 24: 4393}


def test_moments_of_a_correlated_pair(spark):
    rows = [(u, t, x) for t, (a, b) in enumerate([(1, 2), (None, 999), (3, 6), (4, 8)]) for u, x in (("a", a), ("b", b))]
    df = spark.createDataFrame([(u, t, None if x is None else float(x)) for u, t, x in rows], "u string, t long, r double")
    got = covariance.portfolios(df, "u").first()
    assert got.ratio == pytest.approx(3 / 5**0.5, abs=1e-6) and got.rho_w == pytest.approx(1)


def test_interpolation_limit(spark):
    v = [None, 1, None, None, None, 5, None]
    x = lambda limit: [r.x for r in rolling.interpolated(series(spark, v), limit).orderBy("t").collect()]
    assert x(None) == [1, 1, 2, 3, 4, 5, 5] and x(1) == [1, 1, 2, 5, 5, 5, 5]


def test_islands_and_runs(spark):
    df = spark.createDataFrame([(1, 4), (3, 6), (7, 8), (10, 12)], "lo long, hi long")
    assert sorted(tuple(r) for r in rolling.islands(df, "lo", "hi").select("lo", "hi", "n").collect()) == [(1, 8, 3), (10, 12, 1)]
    on = spark.createDataFrame([(i, c == "x") for i, c in enumerate("xx.x..xxx")], "t long, on_ boolean")
    assert sorted(tuple(r) for r in events.runs(on, "on_").select("t", "hours").collect()) == [(0, 2), (3, 1), (6, 3)]


def test_changepoint(spark):
    df = spark.createDataFrame([(i + 1, 1.0 if i < 12 else 9.0) for i in range(30)], "i long, v double")
    assert events.changepoint(df).first().k == 12


def test_sessions_and_steps(spark):
    s = spark.createDataFrame([(0.5, 2.25, 2.0), (1.0, 1.0, 5.0), (1.0, 3.0, 0.0)], "a double, b double, w double")
    assert {r.t: r.x for r in events.sessions(s, "a", "b", "w").collect()} == {0: 1.0, 1: 2.0, 2: 0.5}
    st = spark.createDataFrame([(1.25, 4.0), (3.0, -4.0)], "p double, x double")
    assert [(r.t, r.level) for r in events.occupancy(st, "p", "x").orderBy("t").collect()] == [(1, 3.0), (2, 4.0), (3, 0.0), (4, 0.0)]


def test_order_statistic(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "m double").withColumn("g", F.lit(1))
    assert {r.alpha: r.cap for r in events.order_cap(df, ["g"], [0.5, 0.9, 0.95]).collect()} == {0.5: 6.0, 0.9: 2.0, 0.95: 1.0}


def test_headroom_equals_bisection(spark):
    r = random.Random(5)
    hours = [(i, r.uniform(400, 1000), r.uniform(0, 1), 0.0) for i in range(120)]
    hours = [(i, d, s, s * r.choice([0, 0.3, 1])) for i, d, s, _ in hours]
    grid = lambda v, n: spark.createDataFrame([(x,) for x in v], f"{n} double")
    got = screen.headroom(spark.createDataFrame(hours, "i long, d double, s double, c double"), grid([0.0, 0.05], "margin"), grid([0.0, 0.02, 0.1], "budget")).collect()
    assert len(got) == 6
    for row in got:
        cap = max(h[1] for h in hours) * (1 + row.margin)

        def fits(load, cap=cap, row=row):
            over = [max(0.0, d + load * s - cap) for _, d, s, _ in hours]
            return all(x <= load * c + 1e-9 for x, (_, _, _, c) in zip(over, hours, strict=True)) and sum(x > 1e-9 for x in over) <= int(row.budget * len(hours) + 1e-9)

        lo, hi = 0.0, 20000.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if fits(mid) else (lo, mid)
        assert row.load == pytest.approx(lo if fits(1.0) else 0.0, abs=1e-4)


def test_hinges_equal_interpolation():
    for values in [*power.CURVES.values(), power.LINEAR]:
        c = power.hinges(values)
        for u in np.linspace(0, 1, 41):
            assert sum(a * max(u - k, 0) for a, k in zip(c, power.KNOTS, strict=False)) == pytest.approx(np.interp(u, power.KNOTS, values))
    assert power.online_offset() == pytest.approx(0.2875)


def test_statistics_merge(spark):
    rows = spark.createDataFrame([(i % 3, float(i), None if i % 4 == 0 else i / 20) for i in range(20)], "g long, w double, u double")
    parts = rollups.sufficient(rows.where("w < 9"), ["g"]).unionByName(rollups.sufficient(rows.where("w >= 9"), ["g"]))
    close = lambda df: {r.g: [round(x, 9) for x in r[1:]] for r in df.collect()}
    assert close(rollups.merged(parts, ["g"])) == close(rollups.sufficient(rows, ["g"]))


def test_many_to_one_raises(spark):
    left, right = spark.createDataFrame([(1,), (1,)], "k long"), spark.createDataFrame([(1, "a"), (1, "b")], "k long, x string")
    assert rollups.many_to_one(left, right.limit(1), "k").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        rollups.many_to_one(left, right, "k").collect()


def test_numbers_and_bins(spark):
    df = spark.createDataFrame([("0.4-0.5",), ("~0.3",), ("n/a",)], "s string")
    assert [r.n for r in df.select(rollups.number_of("s").alias("n")).collect()] == [0.45, 0.3, None]
    b = spark.createDataFrame([(0,), (9,), (10,), (99,)], "x long").select(rollups.bin_of("x", [0, 10, 50]).alias("b"))
    assert [r.b for r in b.collect()] == [0, 0, 10, None]


def test_derating(spark):
    t = spark.createDataFrame([(0, i, 10.0, float(i)) for i in range(1, 21)], "o long, t long, k double, m double")
    assert backtest.derating(t, 0.9).first().d == pytest.approx(0.3)
    assert backtest.derating(t, 0.5).first().d == pytest.approx(1.1)


def test_blocks_and_shifts(spark):
    hours = spark.createDataFrame([(7, 50)], "lo long, n long")
    for circular in (False, True):
        b = resample.block_index(hours, 3, 20, 1, circular).collect()
        assert sorted((r.rep, r.pos) for r in b) == [(i, p) for i in range(3) for p in range(50)] and all(7 <= r.src < 57 for r in b)
        assert all(b[i].src + 1 in (b[i + 1].src, b[i + 1].src + 50) for i in range(149) if b[i + 1].pos == b[i].pos + 1 and b[i + 1].pos % 20)
    s = spark.createDataFrame([(c, t, float(t), 0.0) for c in "ab" for t in range(5)], "c string, t long, v double, trend double")
    got = resample.decorrelated(s, "c", 2, 3).collect()
    k = {(d, u): resample.drawn_numbers(np.array([d]), u, 3)[0] % 5 for d in range(2) for u in range(2)}
    assert {(r.draw, r.t): r.v for r in got} == {(d, t): float(sum((t - k[d, u]) % 5 for u in range(2))) for d in range(2) for t in range(5)}


def test_drawn_numbers_are_spread_and_the_same_everywhere(spark):
    rows = spark.range(2000).withColumn("b", F.col("id") % 7)
    got = [r.x for r in rows.select(resample.drawn("id", "b", 5).alias("x")).collect()]
    assert got == [int(resample.drawn_numbers(np.array([i]), i % 7, 5)[0]) for i in range(2000)]
    u = np.array(got) / resample.PRIME
    assert abs(u.mean() - 0.5) < 0.02 and abs(np.corrcoef(u[:-7], u[7:])[0, 1]) < 0.06 and np.histogram(u, 10)[0].min() > 150
    first, second = (resample.drawn_numbers(np.arange(2000), k, 5) % 720 for k in (0, 1))
    assert len(set(((second - first) % 720).tolist())) > 500


def usage_rows(spark, hours, units):
    return spark.createDataFrame([(t, f"c{u:02}", 1.0 + u + (t % 24) / 10) for t in hours for u in range(units)], "t long, cluster_id string, w double")


def test_calendars_and_units_come_from_the_rows(spark):
    """A thousand hours and fourteen units, hours that don't begin at 0, and a gap."""
    rows = usage_rows(spark, [t for t in range(5, 1005) if t != 77], 14)
    f = rolling.fleet(rows).collect()
    assert len(f) == 1000 and [r.t for r in f if r.v is None] == [77]
    assert sum(r.v for r in f if r.v) == pytest.approx(rows.agg(F.sum("w")).first()[0])
    s = rolling.lanes(rows)
    assert s.count() == 14000
    d = resample.decorrelated(s.withColumn("v", F.coalesce("v", F.lit(0.0))).withColumn("trend", F.lit(0.0)), "cluster_id", 2, 1)
    for r in d.groupBy("draw").agg(F.sum("v").alias("v"), F.count("*").alias("n")).collect():
        assert r.n == 1000 and r.v == pytest.approx(sum(x.v for x in f if x.v))
    x = resample.numbered(s, "cluster_id")
    assert {r.u for r in resample.picks(x, 40, 9).collect()} == set(range(14))


def test_many_units_are_drawn_not_enumerated(spark):
    rows = spark.createDataFrame([(f"c{u:02}",) for u in range(17)], "c string")
    got = covariance.subsets(rows, "c", draws=5)
    # as many as are asked for, or as there are: the set of all 17 comes once
    assert {r.n: r.p for r in got.groupBy("n").agg(F.countDistinct("p").alias("p")).collect()} == {n: min(5, math.comb(17, n)) for n in range(1, 18)}
    assert got.groupBy("p", "n").agg(F.countDistinct("c").alias("k")).where("k <> n").count() == 0
    few = covariance.subsets(rows.where("c < 'c04'"), "c")
    assert few.select("p").distinct().count() == 15 and few.where("bit_count(p) <> n").count() == 0


def test_sessions_of_any_length(spark):
    rows = [(0.25, 3.5, 2.0), (2.0, 3.0, 1.0), (2.5, 2.75, 4.0), (9.1, 9.2, 1.0), (5.0, 5.0, 9.0), (1.0, 4.0, 0.0)]
    got = {r.t: r.x for r in events.sessions(spark.createDataFrame(rows, "a double, b double, w double"), "a", "b", "w").collect()}
    want = {}
    for a, b, w in rows:
        for t in range(int(a), int(np.ceil(b))):
            if b > a and w > 0:
                want[t] = want.get(t, 0) + w * (min(b, t + 1) - max(a, t))
    assert got == pytest.approx(want)


def test_nnls():
    r = np.random.default_rng(3)
    a = r.random((40, 4))
    assert fitting.nnls(a.T @ a, a.T @ (a @ [1, 0, 2, 0.5])) == pytest.approx([1, 0, 2, 0.5], abs=1e-6)
    x = fitting.nnls(a.T @ a, a.T @ (a @ [1, -3, 2, 0.5]))
    assert (x >= 0).all()


def test_surrogates_keep_the_spectrum_of_the_residual(spark):
    r = np.random.default_rng(1)
    for n in (64, 65):
        rows = [("a", i, float(x) + i / 10, i / 10) for i, x in enumerate(r.random(n))]
        got = fitting.surrogates(spark.createDataFrame(rows, "cluster_id string, t long, v double, trend double"), 1).orderBy("t").toPandas()
        line = np.arange(n) / 10
        a, b = (np.abs(np.fft.rfft(got[c].to_numpy() - line)) for c in ("v", "s"))
        assert b == pytest.approx(a) and abs(got.s - got.v).max() > 0.01
    gap = spark.createDataFrame([("a", i, None if i == 3 else float(i), 0.0) for i in range(8)], "cluster_id string, t long, v double, trend double")
    assert [x.t for x in fitting.surrogates(gap, 1).collect() if x.s is None] == [3]


def test_a_saturating_curve_can_be_fitted(spark):
    rows = spark.createDataFrame([(u / 100, float(np.interp(u / 100, [0, 0.25, 0.5, 0.75, 1], [1, 5, 7, 7.5, 7.5]))) for u in range(101)], "u double, w double")
    x = [r.x for r in fitting.solved(fitting.gram(rows, fitting.increments("u", [0.0, 0.25, 0.5, 0.75], 0.25), "w")).orderBy("i").collect()]
    assert x == pytest.approx([1, 4, 2, 0.5, 0], abs=1e-6)


def test_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text("utc_end,demand_mw\n01/02/2024 03:00:00 PM,5.5\n01/02/2024 03:00:00 PM,9\nbad,1\n01/02/2024 04:00:00 PM,x\n")
    got = tables.demand_csv(spark, str(tmp_path / "d.csv")).orderBy("ts").collect()
    assert [r.demand_mw for r in got] == [5.5, None] and got[0].ts.hour == 15
    df = spark.createDataFrame([(0, "a"), (1, "b")], "day int, x string")
    tables.write_days(df, str(tmp_path / "days"))
    tables.write_days(df.where("day = 1").withColumn("x", F.lit("c")), str(tmp_path / "days"))
    back = spark.read.parquet(str(tmp_path / "days"))
    assert {r.day: r.x for r in back.collect()} == {0: "a", 1: "c"}
    assert tables.missing_days(spark.range(3).withColumnRenamed("id", "day"), back).count() == 1
    assert tables.utilisation_divisor(spark.createDataFrame([(55.0,)], "u double"), "u") == 100
    text = spark.createDataFrame([("1.5", "x"), ("NaN", "3")], "a string, b string")
    assert [tuple(r) for r in tables.coerced(text, a="double", b="int").collect()] == [(1.5, None), (None, 3)]


def test_paths_samples_and_configurations(spark, tmp_path):
    rows = spark.createDataFrame([(d, h, 55.0 + d) for d in range(5) for h in range(11, 14)], "day int, hour int, u double")
    rows.write.partitionBy("day", "hour").parquet(str(tmp_path / "t"))
    back = files.by_path(spark, str(tmp_path / "t"), "u double", ["day", "hour"])
    assert sorted(tuple(r) for r in back.select("day", "hour", "u").collect()) == sorted(tuple(r) for r in rows.collect())
    assert files.sampled_divisor(spark.read.parquet(str(tmp_path / "t")), "u").first().divisor == 100.0
    assert files.sampled_divisor(rows.withColumn("u", F.when(F.col("day") == 4, 99.0).otherwise(0.5)), "u").first().divisor == 1.0
    (tmp_path / "p.yaml").write_text("idle_frac: {base: 0.3, range: [0.2, 0.4]}\npue: 1.4\ngpu_tdp_w: {A10: 160, A100: {base: 410, range: [300, 460]}}\n")
    p = power.configured(files.config(spark, str(tmp_path / "p.yaml")))
    assert (p["phi"], p["pue"], p["null_level"], p["tdp"]) == (0.3, 1.4, 0.3, {"A10": 160.0, "A100": 410.0})


def test_written_once_and_in_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i % 7}") for i in range(70)], "i long, k string")
    assert files.if_absent(rows, str(tmp_path / "once")).count() == 70
    assert files.if_absent(rows.limit(1), str(tmp_path / "once")).count() == 70
    files.bucketed(rows, str(tmp_path / "b"), "k", 4)
    back = spark.read.parquet(str(tmp_path / "b"))
    assert {(r.k, r.bucket) for r in back.collect()} == {(f"k{i}", zlib.crc32(f"k{i}".encode()) % 4) for i in range(7)}
    assert all(len(list((tmp_path / "b" / f"bucket={x}").glob("*.parquet"))) == 1 for x in {r.bucket for r in back.collect()})


def test_provenance(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    r = files.provenance(spark, str(tmp_path / "x.bin")).first()
    assert (r.name, r.bytes, r.sha256) == ("x.bin", 3, hashlib.sha256(b"abc").hexdigest())


#: Invented facts: workload, phase, number, notes.
FACTS = [
    ("idle", "allocated", "0.2", "EXACT a"), ("idle_fleet", "any", "0.1-0.14", "COMPUTED"), ("llm", "node_idle", "~0.16", "read off a figure"), ("training", "mean", "0.9", "EXACT"), ("Training", "steady", "0.85-0.95", "COMPUTED"),
    ("llm", "training comm", "0.4", ""), ("gemm stress", "all", "1.0", "EXACT"), ("llm", "prefill", "~0.8", ""), ("llm", "decode", "0.4-0.5", "EXACT"), ("image", "diffusion", "0.75", ""), ("offline batch", "all", "0.7", "EXACT"),
    ("inference", "mixed", "0.5", "COMPUTED b"), ("chat", "online", "0.45", ""), ("chat", "facility", "0.6", "EXACT"), ("host", "online", "0.3", ""), ("training", "mean", "1e3", ""), ("training", "mean", "1.5", ""), ("unknown", "unknown", "0.5", ""),
]


def test_facts_have_the_first_category_that_fits(spark):
    got = {r.workload + "/" + r.phase: r.category for r in spark.createDataFrame(FACTS, "workload string, phase string, s string, notes string").select("workload", "phase", facts.category()).collect()}
    assert got["llm/node_idle"] == "idle: bare" and got["idle/allocated"] == "idle: allocated" and got["chat/facility"] is None and got["host/online"] is None
    assert got["llm/training comm"] == "training: comm trough" and got["Training/steady"] == "training: mean" and got["unknown/unknown"] is None


def test_whole_numbers_and_ranges_only(spark):
    want = {"1e3": None, "17": 17.0, "~2-4": 3.0, " .5 ": 0.5, "a1": None, "1-2-3": None, "": None}
    df = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r.s: r.n for r in df.select("s", rollups.number_of("s").alias("n")).collect()} == want


def test_plateaus_restart_where_the_last_ended(spark):
    v = [10.0] * 30 + [20.0] * 25 + [None] + [20.0] * 12 + [5.0] * 9
    got = fitting.plateaus(series(spark, v), least=10, spread=0.0, window=1).collect()
    assert got == []  # a mean of one value needs 24
    flat = fitting.plateaus(series(spark, [10.0] * 100 + [20.0] * 100), least=40, spread=0.01, window=24).orderBy("first").collect()
    assert flat[0].first == 12 and all(b.first > a.last for a, b in zip(flat, flat[1:], strict=False)) and len(flat) == 2


def test_equal_sides_of_a_join(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string"), spark.createDataFrame([(1, 5.0)], "k long, v double")
    assert [tuple(r) for r in rollups.one_to_one(a, b, "k").collect()] == [(1, "x", 5.0)]
    with pytest.raises(Exception, match="repeated key"):
        rollups.one_to_one(a.unionByName(a), b, "k").collect()


def test_hours_with_few_clusters_are_marked(spark, tmp_path):
    """Hour 1 has two clusters, hour 2 none; hour 5 has all three, as any other hour."""
    seen = {0: "abc", 1: "ab", 3: "abc", 4: "a", 5: "abc"}
    rows = [(f"2024-01-01 0{t}:30:00", 7, c, 10.0 * t + 1) for t, cs in seen.items() for c in cs]
    events = spark.createDataFrame(rows, "ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.withColumn("props", F.lit('{"k": 50}')).write.parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()["hour_flags"](spark, str(tmp_path)).orderBy("cluster_id").collect()
    assert [tuple(r) for r in got] == [(c, 6, 3, round((1 + 31 + 51) / 3, 6), 3) for c in "abc"]
    assert differences(spark, connect(str(tmp_path)), "hour_flags", registry.queries()["hour_flags"], registry.oracle_sql()["hour_flags"], str(tmp_path)) is None


def test_hours_outside_the_inventory_are_not_good(spark):
    """Hour 1 isn't in the inventory, in hour 2 no device worked, hour 3 has no row; hour 5 is as good as hour 0."""
    pods = [(t, "c", "A10", "training", "Unknown", gh, 10.0, 30.0) for t, gh in ((0, 3.0), (1, 3.0), (2, 0.0), (4, 9.0), (5, 3.0))]
    used = [(t, "Unknown", 8.0, 0.5) for t in (0, 1, 2, 4, 5)]
    devices = [(t, "c", "A10", 4.0, 8.0) for t in (0, 2, 3, 4, 5)]
    got = facility.hourly(
        spark.createDataFrame(pods, "t long, cluster_id string, spec string, job_type string, state string, gpu_hours double, idle double, active double"),
        spark.createDataFrame(used, "t long, state string, cores double, busy double"),
        spark.createDataFrame(devices, "t long, cluster_id string, spec string, gpu_count double, cores double"),
    )
    one, host, busy = power.TDP["A10"] * power.IDLE, 8 * power.HOST_IDLE, 4 * (power.HOST_PEAK - power.HOST_IDLE)
    want = [(0, True, 40.0, one, host + busy), (1, False, 40.0, 0.0, busy), (2, False, 40.0, 4 * one, host + busy), (3, False, 0.0, 4 * one, host), (4, True, 40.0, 0.0, host + busy), (5, True, 40.0, one, host + busy)]
    assert [(r.t, r.good, r.pods, pytest.approx(r.idle_floor), pytest.approx(r.host)) for r in got.orderBy("t").collect()] == want


def test_the_inventory_has_every_hour(spark, sf_dir):
    tele, inv = tables.telemetry(spark, sf_dir), facility_queries.inventory(spark, sf_dir)
    kinds = {tuple(r) for r in tele.where("spec is not null").select("cluster_id", "spec").distinct().collect()}
    lo, hi = tele.agg(F.min("t"), F.max("t")).first()
    assert sorted((r.t, r.cluster_id, r.spec) for r in inv.collect()) == sorted((t, *k) for t in range(lo, hi + 1) for k in kinds)
