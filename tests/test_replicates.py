"""Array replicates, drawn portfolios, level runs, exact selection, long windows and curve bootstraps against plain versions."""

import hashlib
import itertools
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import chain, covariance, fitting, replicates, resample, selection
from gridloom.operators.rolling import long_dense, long_minima, long_trend, minima, over, span, supported
from gridloom.plans import registry
from gridloom.sources import files

from .compare import connect, differences, value


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def panel(spark, units=3, hours=400, seed=1, gaps=True):
    r = random.Random(seed)
    rows = [(f"c{u}", t, None if gaps and r.random() < 0.03 else 50 + 20 * math.sin(t / 7 + u) + r.uniform(0, 30)) for u in range(units) for t in range(hours)]
    return spark.createDataFrame(rows, "cluster_id string, t long, v double")


def test_replicates_as_by_rows(spark):
    s, reps, block, draws = panel(spark), 5, 72, 3
    ix = resample.block_index(span(s), reps, block, 6).withColumnRenamed("src", "t")
    rows = s.join(ix, "t").select("rep", "cluster_id", F.col("pos").alias("t"), F.when((F.col("pos") + 1) % block != 0, F.col("v")).alias("v"))
    want = {(r.rep, r.h): (r.p1, r.p2, r.p3) for r in chain.levels(rows, "cluster_id", [1, 4], 0.05, draws, 6, ["rep"]).collect()}
    got = replicates.chain_replicates(s, "cluster_id", [1, 4], [0.05], draws, reps, block, 6, own=False).collect()
    assert {(r.rep, r.h) for r in got} == set(want) and len(got) == 2 * reps
    for r in got:
        assert (r.p1, r.p2, r.p3) == pytest.approx(want[r.rep, r.h], abs=1e-9)


def test_a_short_or_empty_panel_gives_no_replicates(spark):
    s = panel(spark, hours=40)
    assert replicates.chain_replicates(s, "cluster_id", [1], [0.05], 2, 4, 168, 6).collect() == []
    assert replicates.chain_replicates(s.limit(0), "cluster_id", [1], [0.05], 2, 4, 168, 6).collect() == []


def test_a_panel_has_a_bound(monkeypatch, spark):
    monkeypatch.setattr(replicates, "CELLS", 100)
    run = replicates.cells_of
    batch = replicates.panel(panel(spark), "cluster_id").toArrow().to_batches()[0]
    with pytest.raises(ValueError, match="too many cells"):
        run(batch, 0)


def test_covariance_replicates(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(5, 300)).cumsum(1)
    x[2, 40:60] = np.nan
    inside = np.tile((np.arange(300) % 11 != 3).astype(float), (5, 1))
    sets = replicates.sets_of(5, 4)
    assert sorted(sets.tolist()) == sorted(p for p in range(32) if p.bit_count() in (4, 5))
    got = replicates.covariance_bands(sets, 48, 9)([x, inside], np.arange(6))
    at = {(a, b): k for k, (a, b) in enumerate(zip(got["rep"].tolist(), got["p"].tolist(), strict=True))}
    good = (inside[0] > 0) & ~np.isnan(x).any(0)
    for rep in range(6):
        hours = []
        for j, size in enumerate([48] * 6 + [12]):
            start = int(resample.drawn_numbers(np.array([rep]), j, 9)[0]) % (300 - size + 1)
            hours += [t for t in range(start, start + size) if good[t]]
        cov = np.cov(x[:, hours], bias=True)
        for p in sets.tolist():
            u = [i for i in range(5) if p >> i & 1]
            c = cov[np.ix_(u, u)]
            s2, s1 = np.trace(c), np.sqrt(np.diag(c)).sum()
            k = at[rep, p]
            assert got["hours"][k] == len(hours)
            assert (got["ratio"][k], got["rho_w"][k]) == pytest.approx((math.sqrt(max(c.sum() / s2, 0)), (c.sum() - s2) / (s1 * s1 - s2)), abs=1e-8)


def test_surrogates_keep_the_spectrum():
    r = np.random.default_rng(3)
    for n in (200, 201):
        x = r.normal(size=n)
        x[5:9] = np.nan
        s = replicates.surrogate(x, r.uniform(0, 6, n // 2 + 1))
        assert (np.isnan(s) == np.isnan(x)).all() and not np.allclose(s[20:], x[20:])
        filled = np.where(np.isnan(x), np.nanmean(x), x)
        whole = replicates.surrogate(filled, r.uniform(0, 6, n // 2 + 1))
        assert np.allclose(np.abs(np.fft.rfft(whole)), np.abs(np.fft.rfft(filled)))


def members_of(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.n, r.p].append(r.cluster_id)
    return {k: tuple(sorted(v)) for k, v in out.items()}


def units(spark, n):
    return spark.createDataFrame([(f"u{i:03d}", 0, 1.0) for i in range(n)], "cluster_id string, t long, v double")


def unranked(rank, n, k):
    out = []
    for c in range(n - 1, -1, -1):
        if k and math.comb(c, k) <= rank:
            rank -= math.comb(c, k)
            k -= 1
            out.append(f"u{c:03d}")
    return tuple(sorted(out))


def test_drawn_portfolios_are_all_different(spark):
    import duckdb

    n = 16
    got = members_of(covariance.subsets(units(spark, n), "cluster_id"))
    for k in range(1, n + 1):
        own = [m for (size, _), m in got.items() if size == k]
        assert all(len(m) == k for m in own) and len(own) == len(set(own)) == min(200, math.comb(n, k))
    for (k, p), m in got.items():
        total = math.comb(n, k)
        rank = (int(resample.drawn_numbers(np.array([k]), 0, 5)[0]) + (p - k * 200) * 2147483647) % total
        assert m == unranked(rank, n, k)
    con = duckdb.connect()
    con.execute("CREATE TABLE lanes AS SELECT 'u' || lpad(range::VARCHAR, 3, '0') AS cluster_id FROM range(16)")
    rows = con.execute(f"WITH RECURSIVE {covariance.subsets_sql('lanes')} SELECT n, p, list_sort(list(cluster_id)) FROM mb GROUP BY n, p").fetchall()
    assert {(a, b): tuple(c) for a, b, c in rows} == got


def test_portfolios_of_few_and_of_very_many_units(spark):
    few = members_of(covariance.subsets(units(spark, 4), "cluster_id"))
    assert sorted(few.values()) == sorted(m for k in range(1, 5) for m in itertools.combinations([f"u{i:03d}" for i in range(4)], k))
    many = members_of(covariance.subsets(units(spark, 70), "cluster_id", draws=20))
    for k in (1, 2, 30, 69, 70):
        own = [m for (size, _), m in many.items() if size == k]
        assert len(own) == len(set(own)) == min(20, math.comb(70, k)) and all(len(m) == k for m in own)


def test_level_runs():
    r = random.Random(5)
    for spread in (0.05, 0.3):
        v = [100.0]
        for _ in range(400):
            v.append(v[-1] * (1 + r.choice([0, 0, 0.004, -0.006, 0.02, -0.02])))
        v = np.array(v)
        v[r.sample(range(401), 6)] = np.nan
        v[200:210] = -1.0
        run = fitting.Level(v, spread)
        for i in range(len(v)):
            j = i
            while j < len(v) and not np.isnan(v[j]) and v[i : j + 1].max() - v[i : j + 1].min() <= spread * v[i : j + 1].mean():
                j += 1
            assert run.stop(i) == j, (i, spread)


def test_exact_quantiles(spark):
    r = random.Random(7)
    groups = {
        "spread": [r.uniform(-1, 1) * 10 ** r.randint(-8, 12) for _ in range(3000)],
        "ties": [float(r.choice([0, 0, 0, 1, 1, 5])) for _ in range(2500)],
        "one": [4.25],
        "equal": [7.0] * 900,
        None: [float(i) for i in range(1500)],
    }
    rows = [(k, x) for k, v in groups.items() for x in v] + [("one", None), ("one", float("nan")), ("none", None)]
    r.shuffle(rows)
    shares = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = selection.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", shares, limit=40)
    out = {(x.k, x.share): (x.q, x.n) for x in got.collect()}
    assert len(out) == len(groups) * len(shares)
    for k, v in groups.items():
        for s in shares:
            assert out[k, s] == (pytest.approx(float(np.quantile(v, s)), rel=1e-12), len(v)), (k, s)


def test_exact_quantiles_without_keys_are_those_of_percentile(spark):
    df = spark.range(20_000).selectExpr("sin(id * 7.1) * 1000 AS x")
    want = df.agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.9))).alias("q")).first().q
    got = sorted((r.share, r.q) for r in selection.exact_quantiles(df, [], "x", [0.05, 0.9], limit=500).collect())
    assert [q for _, q in got] == pytest.approx(want)


def test_windows_over_a_long_series(spark):
    s = panel(spark, units=1, hours=1500).select("t", "v").withColumn("t", F.col("t") + 17)
    got = long_minima(s, [3, 50], block=64)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, minima(s, [3, 50]).collect()))
    w = over([], -30, 12)
    want = s.withColumn("trend", supported(F.avg("v"), "v", w, 20)).select("t", "v", "trend")
    back = long_trend(s, 30, 12, 20, block=25)
    clean = lambda df: sorted(tuple(value(x) for x in r) for r in df.collect())
    assert clean(back) == clean(want)
    for df in (got, back):
        assert "SinglePartition" not in plan(df)
    few = long_dense(s.where("t % 3 = 0"))
    assert few.count() == 1498 and few.where("v is null and t % 3 = 0").count() == s.where("v is null and t % 3 = 0").count()
    assert "SinglePartition" not in plan(few)


def brute_nnls(g, b):
    best = (0.0, np.zeros(len(b)))
    for k in range(1, len(b) + 1):
        for on in itertools.combinations(range(len(b)), k):
            x = np.zeros(len(b))
            x[list(on)] = np.linalg.lstsq(g[np.ix_(on, on)], b[list(on)], rcond=None)[0]
            if (x >= -1e-12).all():
                loss = x @ g @ x - 2 * b @ x
                if loss < best[0] - 1e-12:
                    best = (loss, x)
    return best[1]


def test_curves_over_racks_drawn_again(spark):
    r = random.Random(8)
    rows = [(rack, u := r.random(), 60 + 200 * min(u, 0.6) + r.gauss(0, 40) - (30 if u > 0.8 else 0)) for rack in range(9) for _ in range(r.randint(3, 40))]
    basis = fitting.increments("u", [0.0, 0.25, 0.5, 0.75], 0.25)
    sums = fitting.gram(spark.createDataFrame(rows, "rack long, u double, w double"), basis, "w", ["rack"])
    got = fitting.level_at(fitting.solved(fitting.resampled(sums, "rack", 12, 3), "rep long"), ["rep"]).collect()
    assert len(got) == 60
    x = lambda u: np.array([1.0, *(min(max((u - k) / 0.25, 0), 1) for k in (0, 0.25, 0.5, 0.75))])
    parts = {k: (sum(np.outer(x(u), x(u)) for q, u, _ in rows if q == k), sum(x(u) * w for q, u, w in rows if q == k)) for k in range(9)}
    for rep in range(12):
        picks = [int(resample.drawn_numbers(np.array([rep]), i, 3)[0]) % 9 for i in range(9)]
        want = np.cumsum(brute_nnls(sum(parts[p][0] for p in picks), sum(parts[p][1] for p in picks)))
        assert [c.x for c in sorted(got, key=lambda c: c.i) if c.rep == rep] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-6)


def test_digests_by_chunks(spark, tmp_path):
    data = {f"f{i}.bin": bytes(random.Random(i).randbytes(n)) for i, n in enumerate((1, 1000, 4096, 100_001))}
    for name, b in data.items():
        (tmp_path / name).write_bytes(b)
    got = {r.name: r for r in files.provenance(spark, str(tmp_path), chunk=1000).collect()}
    for name, b in data.items():
        r = got[name]
        assert (r.bytes, r.sha256, r.chunks) == (len(b), hashlib.sha256(b).hexdigest(), -(-len(b) // 1000))
        assert r.host and r.spark == spark.version and r.modified
    assert "content" not in plan(files.listing(spark, str(tmp_path)))


def test_sampled_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id div 10 AS day").repartition("day").write.partitionBy("day").parquet(path)
    rows = files.sampled_files(spark, path, "id long, day int", 3)
    assert sorted(r.day for r in rows.select("day").distinct().collect()) == [0, 4, 7] and rows.count() == 30
    assert files.sampled_files(spark, path, "id long, day int", 50).count() == 100


def test_many_units_are_numbered_in_order(spark):
    rows = [(f"k{random.Random(i).randint(0, 4000):05d}",) for i in range(6000)]
    df = spark.createDataFrame(rows, "unit string").repartition(5)
    got = {r.unit: r.u for r in resample.numbered_many(df, "unit").collect()}
    assert got == {k: i for i, k in enumerate(sorted({x for x, in rows}))}
    assert resample.numbered_many(df.limit(0), "unit").count() == 0


def exact_c2(x, y):
    """The quadratic coefficient of a least-squares parabola, in fractions."""
    x, y = [Fraction(v) for v in x], [Fraction(v) for v in y]
    s = [sum(v**k for v in x) for k in range(5)]
    r = [sum(v**k * w for v, w in zip(x, y, strict=True)) for k in range(3)]
    det = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - b[0] * (a[1] * c[2] - a[2] * c[1]) + c[0] * (a[1] * b[2] - a[2] * b[1])
    return float(det(s[:3], s[1:4], r) / det(s[:3], s[1:4], s[2:5]))


def orders_of(spark, path, prices):
    """The two tables that quadratic_interval reads, from (nation, prices)."""
    rows = [(i, nation, float(p)) for i, (nation, ps) in enumerate(prices) for p in ps]
    spark.createDataFrame([(i, n) for i, (n, _) in enumerate(prices)], "c_custkey long, c_nationkey int").write.parquet(str(path / "customer.parquet"))
    spark.createDataFrame([(i, p) for i, _, p in rows], "o_custkey long, o_totalprice double").write.parquet(str(path / "orders.parquet"))
    return str(path)


def test_an_interval_of_means_that_lie_close_together(spark, tmp_path):
    prices = [(k, [250_000 + 40 * k + s * (1000 + k * k * 37 % 501) for s in (-2, -1, 1, 2)]) for k in range(25)]
    got = registry.queries()["quadratic_interval"](spark, orders_of(spark, tmp_path, prices)).first()
    x, y = [math.log10(np.mean(p)) - 5.1 for _, p in prices], [math.log10(np.std(p, ddof=1)) for _, p in prices]
    picked = np.array([resample.drawn_numbers(np.arange(500), u, 43) % 25 for u in range(25)]).T
    reps = [exact_c2([x[i] for i in r], [y[i] for i in r]) for r in picked if len(set(r)) > 4]
    assert abs(got.c2 - exact_c2(x, y)) < 0.006
    assert (got.low, got.high) == pytest.approx(np.quantile(reps, [0.025, 0.975]), abs=0.06)


@pytest.mark.parametrize("nations", [(0, 1, 2, 3), (0, 1, 2, 3, 4, 5, None)])
def test_an_interval_of_few_or_unnamed_nations(spark, tmp_path, nations):
    path = orders_of(spark, tmp_path, [(n, [10.0 ** (i + 1), 2 * 10.0 ** (i + 1), (3 + i % 3) * 10.0 ** (i + 1)]) for i, n in enumerate(nations)])
    name = "quadratic_interval"
    assert differences(spark, connect(path), name, registry.queries()[name], registry.oracle_sql()[name], path) is None
