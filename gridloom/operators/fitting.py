"""Regressions from sums, and the few grouped numpy steps that Spark can't express."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.resample import PRIME, drawn_numbers, numbered, numbered_many, picks
from gridloom.operators.rolling import over, supported


def power_law(rows: DataFrame, x: str, y: str) -> DataFrame:
    p = rows.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log10(x).alias("x"), F.log10(y).alias("y"))
    return p.agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.pow(F.corr("y", "x"), 2), 6).alias("r2"))


def parabola(rows: DataFrame, keys: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """(keys, n, c0, c1, c2) of y = c0 + c1 x + c2 x^2 by Cramer's rule on the normal equations."""
    x, y = F.col("x"), F.col("y")
    a = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sx2"), F.sum(x * x * x).alias("sx3"), F.sum(x * x * x * x).alias("sx4"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x * y).alias("sx2y"))
    m = [["n", "sx", "sx2"], ["sx", "sx2", "sx3"], ["sx2", "sx3", "sx4"]]
    right = ["sy", "sxy", "sx2y"]

    def det(m: list[list[str]]):
        c = [[F.col(v) for v in r] for r in m]
        return c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])

    swap = lambda k: [[right[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
    return a.select(*keys, "n", *[F.round(F.try_divide(det(swap(k)), det(m)), digits).alias(f"c{k}") for k in range(3)])


def centred(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, x, y) less their means by keys. A parabola's c2 stays; its determinants no longer cancel where the x of a
    key lie close together far from 0."""
    w = Window.partitionBy(*keys)
    return rows.select(*keys, *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in ("x", "y")])


def surrogates(series: DataFrame, seed: int) -> DataFrame:
    """(cluster_id, t, v, s): the trend plus a residual with the amplitudes of its own spectrum and phases drawn anew.

    series: (cluster_id, t, v, trend) on a complete calendar. The phases of the mean and, for an even number of hours,
    of the last frequency stay 0, so that all amplitudes are kept. Gaps count as the mean residual and stay gaps.
    """
    rows = series.join(numbered(series, "cluster_id"), "cluster_id").select("cluster_id", "u", "t", "v", "trend")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        r = (pdf["v"] - pdf["trend"]).to_numpy(float)
        gap = np.isnan(r)
        if gap.all():
            return pdf.assign(s=np.nan)[["cluster_id", "t", "v", "s"]]
        spectrum = np.fft.rfft(np.where(gap, np.nanmean(r), r))
        phase = 2 * np.pi * drawn_numbers(np.arange(len(spectrum)), int(pdf["u"].iloc[0]), seed) / PRIME
        phase[0] = 0
        if len(r) % 2 == 0:
            phase[-1] = 0
        out = np.fft.irfft(np.abs(spectrum) * np.exp(1j * phase), len(r)) + pdf["trend"].to_numpy()
        return pdf.assign(s=np.where(gap, np.nan, out))[["cluster_id", "t", "v", "s"]]

    out = rows.groupBy("cluster_id").applyInPandas(one, "cluster_id string, t long, v double, s double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("v", "s")})


def plateaus(series: DataFrame, least: int, spread: float, window: int = 168, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, first, last, mean): runs of at least `least` hours whose centred mean over a window ranges by at most spread
    times its mean. A run starts where the last ended, or an hour after a start that doesn't reach; so it is a step for
    each start, not a window function. The series is an hour a row on a complete calendar; gaps end a run."""
    rows = series.select(*keys, "t", supported(F.avg("v"), "v", over(keys, -(window // 2), window - window // 2 - 1), 24).alias("v"))
    names = [*keys, "first", "last", "mean"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, v = pdf["t"].to_numpy(), pdf["v"].to_numpy(float)
        out, i, run = [], 0, Level(v, spread)
        while i < len(v):
            j = run.stop(i)
            if j - i >= least:
                out.append((*(pdf[k].iloc[0] for k in keys), int(t[i]), int(t[j - 1]), float(v[i:j].mean())))
                i = j
            else:
                i += 1
        return pd.DataFrame(out, columns=names)

    kinds = [f"{k} string" for k in keys] + ["first long", "last long", "mean double"]
    return rows.groupBy(*keys).applyInPandas(one, ", ".join(kinds))


class Level:
    """How far a series stays level from each place on, in O(log n) for a place.

    The range of a stretch only grows with its end, its mean lies between its least and its largest value. So the stretch
    is level up to where the range first passes spread * least, and broken from where it passes spread * largest; both are
    found by doubling steps over tables of minima and maxima, and the few places between them are tried by running sums.
    """

    def __init__(self, v: np.ndarray, spread: float):
        self.v, self.spread, self.n = v, spread, len(v)
        self.sums = np.concatenate([[0.0], np.cumsum(np.nan_to_num(v))])
        self.low, self.high = [v], [v]
        size = 1
        while 2 * size <= self.n:
            a, b = self.low[-1], self.high[-1]
            self.low.append(np.minimum(a[:-size], a[size:]))
            self.high.append(np.maximum(b[:-size], b[size:]))
            size *= 2

    def reach(self, i: int, low: float, high: float, j: int, largest: bool) -> tuple[int, float, float]:
        """(the first end for which the range is over spread times the least or the largest value, and the two before it);
        low, high: of v[i:j]."""
        for k in range(len(self.low) - 1, -1, -1):
            if j + (1 << k) <= self.n:
                a, b = min(low, self.low[k][j]), max(high, self.high[k][j])
                if not np.isnan(self.low[k][j]) and b - a <= self.spread * (b if largest else a):
                    j, low, high = j + (1 << k), a, b
        return j, low, high

    def stop(self, i: int) -> int:
        """The first place that the stretch from i can't have: a gap, the end, or one that breaks the level."""
        if np.isnan(self.v[i]):
            return i
        j, low, high = self.reach(i, self.v[i], self.v[i], i, False)
        end = self.reach(i, low, high, j, True)[0]  # with values of one sign; others are tried one by one
        while j < self.n and not np.isnan(self.v[j]):
            low, high = min(low, self.v[j]), max(high, self.v[j])
            if j >= end and low > 0 or high - low > self.spread * (self.sums[j + 1] - self.sums[i]) / (j + 1 - i):
                break
            j += 1
        return j


def nnls(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Non-negative least squares of the normal equations, by active sets."""
    n = len(right)
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(10 * n):
        w = right - gram @ x
        w[free] = -np.inf
        if free.all() or w.max() <= 1e-9:
            break
        free[int(w.argmax())] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(gram[np.ix_(free, free)], right[free], rcond=None)[0]
            bad = free & (z <= 0)
            if not bad.any():
                x = z
                break
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


def increments(u: str, knots: Sequence[float], width: float) -> list[Column]:
    """1, and how far u is into the segment after each knot, from 0 to 1: non-negative weights of these make any curve
    that doesn't fall, a saturating one too."""
    return [F.lit(1.0), *[F.least(F.greatest((F.col(u) - k) / width, F.lit(0.0)), F.lit(1.0)) for k in knots]]


def gram(rows: DataFrame, basis: Sequence[Column], y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, g, b, n): the sums of a least-squares problem as arrays; sums of these are those of the rows together."""
    n = len(basis)
    sums = rows.groupBy(*keys).agg(*[F.sum(basis[i] * basis[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(n)], *[F.sum(basis[i] * F.col(y)).alias(f"b{i}") for i in range(n)], F.count("*").alias("n"))
    return sums.select(*keys, F.array(*[F.coalesce(F.col(f"g{i}_{j}"), F.lit(0.0)) for i in range(n) for j in range(n)]).alias("g"), F.array(*[F.coalesce(F.col(f"b{i}"), F.lit(0.0)) for i in range(n)]).alias("b"), "n")


def resampled(sums: DataFrame, unit: str, reps: int, seed: int) -> DataFrame:
    """(rep, g, b, n): the sums of gram() over units drawn with replacement, as often as there are units. A unit's sums are
    multiplied by how many times it is picked, so that a replicate is a row for each unit that it has, whatever their rows."""
    own = sums.join(numbered_many(sums, unit), unit)
    times = picks(own, reps, seed).groupBy("rep", "u").agg(F.count("*").alias("_m"))
    rows = times.join(own, "u")
    size = sums.select(F.size("b").alias("k")).first()
    k = size.k if size else 0
    total = rows.groupBy("rep").agg(*[F.sum(F.col("_m") * F.col("g")[i]).alias(f"g{i}") for i in range(k * k)], *[F.sum(F.col("_m") * F.col("b")[i]).alias(f"b{i}") for i in range(k)], F.sum(F.col("_m") * F.col("n")).alias("n"))
    return total.select("rep", F.array(*[f"g{i}" for i in range(k * k)]).alias("g"), F.array(*[f"b{i}" for i in range(k)]).alias("b"), "n")


def level_at(solution: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, x): the curve of increments() at its start and after each segment, from the solution's coefficients."""
    return solution.select(*keys, "i", F.sum("x").over(Window.partitionBy(*keys).orderBy("i")).alias("x"))


def predicted(basis: Sequence[Column]) -> Column:
    """The fit at a row, with the coefficients in a column `coefficients`."""
    out = F.lit(0.0)
    for i, x in enumerate(basis):
        out = out + F.col("coefficients")[i] * x
    return out


def solved(sums: DataFrame, keys: str = "") -> DataFrame:
    """(keys, i, x): the non-negative solution of each row of gram()."""

    def run(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                b = np.asarray(r["b"], float)
                x = nnls(np.asarray(r["g"], float).reshape(len(b), len(b)), b)
                rows += [(*[r[k] for k in names], i, float(v)) for i, v in enumerate(x)]
            yield pd.DataFrame(rows, columns=[*names, "i", "x"])

    names = [k.split()[0] for k in keys.split(", ")] if keys else []
    return sums.mapInPandas(run, (f"{keys}, " if keys else "") + "i long, x double")
