"""Bootstraps of an hourly panel at full size: a replicate is an array program over the panel, not rows by draw and hour.

A panel has a value for each unit (cluster) and hour of the calendar, so it is bounded by those, whatever the number of
rows behind it; more than CELLS cells are refused (chain.levels() has the same results from rows). Replicates are dealt
over tasks in runs; each run gets the panel once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.resample import PRIME, drawn_numbers

#: Cells of a panel at most: 512 MB of numbers.
CELLS = 1 << 26


def panel(series: DataFrame, unit: str, values: Sequence[str] = ("v",), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, lo, cells): a row (for each key) with the first hour and, for each value, the units' values by hour, units
    in order of name; series is on a complete calendar."""
    row, field = F.struct("t", *values), lambda c: lambda r: r[c]
    own = series.groupBy(*keys, unit).agg(F.sort_array(F.collect_list(row)).alias("x"))
    own = own.select(*keys, unit, F.col("x")[0].t.alias("lo"), *[F.transform("x", field(c)).alias(c) for c in values])
    whole = own.groupBy(*keys).agg(F.min("lo").alias("lo"), F.sort_array(F.collect_list(F.struct(unit, *values))).alias("u"))
    return whole.where("lo is not null").select(*keys, "lo", F.array(*[F.transform("u", field(c)) for c in values]).alias("cells"))


KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def table_of(columns: dict[str, np.ndarray], schema: str) -> pa.RecordBatch:
    """Columns by name as a batch; NaN is NULL."""
    pairs = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], KINDS[k], from_pandas=True) for c, k in pairs], [c for c, _ in pairs])


def cells_of(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    """The matrices of a row, units by hours."""
    out = []
    for m in (x.values for x in batch.column("cells")[i].values):
        wide = len(m[0])
        if len(m) * wide > CELLS:
            raise ValueError("the panel has too many cells; use chain.levels()")
        out.append(m.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(m), wide))
    return out


def replicated(series: DataFrame, unit: str, reps: int, kernel: Callable[[list[np.ndarray], np.ndarray], dict[str, np.ndarray]], schema: str, values: Sequence[str] = ("v",), runs: int | None = None) -> DataFrame:
    """What kernel(matrices, replicates) gives: columns of equal length by name; the matrices are units by hours, NaN for NULL."""
    spark = series.sparkSession
    n = runs or 4 * spark.sparkContext.defaultParallelism
    size = -(-reps // n)
    first = spark.range(0, reps, size, min(n, -(-reps // size))).withColumnRenamed("id", "first")
    rows = first.join(F.broadcast(panel(series, unit, values)))  # one row, of CELLS cells at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column("first")[i].as_py()
                out = kernel(cells_of(batch, i), np.arange(at, min(at + size, reps)))
                yield table_of(out, schema)

    return rows.mapInArrow(run, schema)


def by_member(series: DataFrame, unit: str, member: str, kernel: Callable[[list[np.ndarray], np.ndarray], dict[str, np.ndarray]], schema: str, values: Sequence[str] = ("v",)) -> DataFrame:
    """What the kernel gives for the panel of each member (a whole number), a member in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = kernel(cells_of(batch, i), np.array([batch.column(member)[i].as_py()]))
                yield table_of(out, schema)

    return panel(series, unit, values, [member]).select(member, "cells").mapInArrow(run, schema)


def block_places(rep: int, n: int, block: int, seed: int) -> np.ndarray:
    """The hours that a replicate of moving blocks takes, as block_index() of resample.py."""
    j = np.arange(-(-n // block))
    starts = np.array([int(drawn_numbers(np.array([rep]), int(b), seed)[0]) for b in j]) % (n - block + 1)
    return (starts[:, None] + np.arange(block)).ravel()[:n]


def rolling_mean(x: np.ndarray, before: int, after: int, least: int) -> np.ndarray:
    """Means over columns t-before..t+after with at least so many values; gaps take the next mean, then the one before."""
    n = x.shape[1]
    have = ~np.isnan(x)
    zero = np.zeros((len(x), 1))
    s, c = np.hstack([zero, np.cumsum(np.where(have, x, 0.0), 1)]), np.hstack([zero, np.cumsum(have, 1)])
    lo, hi = np.maximum(np.arange(n) - before, 0), np.minimum(np.arange(n) + after + 1, n)
    count = c[:, hi] - c[:, lo]
    out = np.where(count >= least, (s[:, hi] - s[:, lo]) / np.maximum(count, 1), np.nan)
    place = np.arange(n)
    for row in out:
        known = np.flatnonzero(~np.isnan(row))
        if len(known):
            row[:] = row[known[np.minimum(np.searchsorted(known, place), len(known) - 1)]]
    return out


def running_minimum(x: np.ndarray, h: int) -> np.ndarray:
    """The least of h columns from each on, by doubling; NaN where one is."""
    done, out = 1, x
    while done < h:
        step = min(done, h - done)
        out = np.minimum(out[..., : out.shape[-1] - step], out[..., step:])
        done += step
    return out


def low_quantile(x: np.ndarray, p: float) -> float:
    x = x[~np.isnan(x)]
    return float(np.quantile(x, p)) if len(x) else np.nan


def chain_levels(block: int | None, hours: Sequence[int], lows: Sequence[float], draws: int, seed: int, own: bool = False) -> Callable:
    """A kernel: p1, p2, p3 of chain.levels() by replicate, duration and share; blocks of so many hours are drawn again,
    with a gap at the end of each (without a block the panel is taken as it is). own: shifts of its own for each replicate."""

    def run(parts: list[np.ndarray], reps: np.ndarray) -> dict[str, np.ndarray]:
        (c,) = parts
        units, n = c.shape
        out: dict[str, list] = {k: [] for k in ("rep", "h", "low", "p1", "p2", "p3")}
        for rep in reps.tolist() if block is None or n >= block else []:
            x = c
            if block is not None:
                x = c[:, block_places(rep, n, block, seed)]
                x[:, block - 1 :: block] = np.nan
            mid = rolling_mean(x, 84, 83, 24)
            r = x - mid
            have = ~np.isnan(x)
            a = np.where(have.any(0), np.where(have, x, 0.0).sum(0), np.nan)
            p1 = np.nanmean(a) if have.any() else np.nan
            base = mid.sum(0)
            sums = np.empty((draws, n))
            for d in range(draws):
                shift = [int(drawn_numbers(np.array([rep * draws + d if own else d]), u, seed)[0]) % n for u in range(units)]
                sums[d] = np.maximum(base + sum(np.roll(r[u], s) for u, s in enumerate(shift)), 0.0)
            for h in hours:
                if h > n:
                    continue
                m, actual = running_minimum(sums, h), running_minimum(a, h)
                for low in lows:
                    p2 = np.mean([low_quantile(row, low) for row in m])
                    for k, v in zip(out, (rep, h, low, p1, p2, low_quantile(actual, low)), strict=True):
                        out[k].append(v)
        return {k: np.array(v, np.int64 if k in ("rep", "h") else float) for k, v in out.items()}

    return run


LEVELS = "rep long, h long, low double, p1 double, p2 double, p3 double"


def chain_replicates(series: DataFrame, unit: str, hours: Sequence[int], lows: Sequence[float], draws: int, reps: int, block: int, seed: int, own: bool = True) -> DataFrame:
    """(rep, h, low, p1, p2, p3) of `reps` replicates of blocks."""
    return replicated(series, unit, reps, chain_levels(block, hours, lows, draws, seed, own), LEVELS)


def surrogate(r: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """A series with the amplitudes of r's spectrum and other phases; gaps count as the mean, and stay gaps."""
    gap = np.isnan(r)
    if gap.all():
        return r
    spectrum = np.fft.rfft(np.where(gap, np.nanmean(r), r))
    phase = phase.copy()
    phase[0] = 0.0
    if len(r) % 2 == 0:
        phase[-1] = 0.0
    return np.where(gap, np.nan, np.fft.irfft(np.abs(spectrum) * np.exp(1j * phase), len(r)))


def surrogate_levels(hours: Sequence[int], low: float, draws: int, seed: int) -> Callable:
    """A kernel: p2 and p3 of the panel whose residuals are replaced by surrogates of their own, by replicate."""

    def run(parts: list[np.ndarray], reps: np.ndarray) -> dict[str, np.ndarray]:
        (c,) = parts
        units, n = c.shape
        mid = rolling_mean(c, 84, 83, 24)
        out: dict[str, list] = {k: [] for k in ("rep", "h", "p2", "p3")}
        for rep in reps.tolist():
            x = np.stack([mid[u] + surrogate(c[u] - mid[u], 2 * np.pi * drawn_numbers(np.arange(n // 2 + 1), rep * units + u, seed) / PRIME) for u in range(units)])
            got = chain_levels(None, hours, [low], draws, seed, own=True)([x], np.array([rep]))
            for k in out:
                out[k] += got[k].tolist()
        return {k: np.array(v, np.int64 if k in ("rep", "h") else float) for k, v in out.items()}

    return run


def block_moments(x: np.ndarray, rep: np.ndarray, block: int, seed: int) -> np.ndarray:
    """Sums of the rows of x over each replicate's hours, by differences of running sums; the last block is shortened to
    the calendar and drawn from as many places as it then has."""
    n = len(x)
    run = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, 0)])
    total = np.zeros((len(rep), x.shape[1]))
    for j, size in enumerate([block] * (n // block) + ([n % block] if n % block else [])):
        start = drawn_numbers(rep, j, seed) % (n - size + 1)
        total += run[start + size] - run[start]
    return total


def sets_of(units: int, size: int) -> np.ndarray:
    """The sets of `size` of the units, and that of all, as bits."""
    if units > 62:
        raise ValueError("sets are bits of a whole number: 62 units at most")
    own = [sum(1 << u for u in x) for x in combinations(range(units), size)] if units > size else []
    return np.array([(1 << units) - 1, *own], np.int64)


def covariance_replicates(kinds: Sequence[str], masks: Sequence[str], blocks: Sequence[tuple[int, int]], size: int = 4, least: int = 24) -> Callable:
    """A kernel over matrices of values (one for each kind) and of whether an hour counts (one for each mask, alike for all
    units): ratio and weighted correlation of every set of `size` units, and of all, by replicate and (block, seed)."""

    def run(parts: list[np.ndarray], reps: np.ndarray) -> dict[str, np.ndarray]:
        out: list[dict[str, np.ndarray]] = []
        sets = sets_of(len(parts[0]), size)
        for k, kind in enumerate(kinds):
            for m, mask in enumerate(masks):
                for block, seed in blocks:
                    one = covariance_bands(sets, block, seed, least)([parts[k], parts[len(kinds) + m]], reps)
                    n = len(one["rep"])
                    out.append(one | {"kind": np.array([kind] * n, object), "mask": np.array([mask] * n, object), "block": np.full(n, block)})
        return {k: np.concatenate([x[k] for x in out]) for k in out[0]}

    return run


COVARIANCES = "kind string, mask string, block long, rep long, p long, hours long, ratio double, rho_w double"


def covariance_bands(sets: np.ndarray, block: int, seed: int, least: int = 24) -> Callable:
    """A kernel over matrices of values and of whether an hour counts: ratio and weighted correlation of each set of units
    (rows of bits) by replicate. Moments of all units come from one pass; a set is quadratic forms of its bits."""

    def run(parts: list[np.ndarray], reps: np.ndarray) -> dict[str, np.ndarray]:
        x, inside = parts[0].T, parts[1][0] > 0
        n, units = x.shape
        empty = {k: np.zeros(0, t) for k, t in (("rep", np.int64), ("p", np.int64), ("hours", np.int64), ("ratio", float), ("rho_w", float))}
        if n < block:
            return empty
        valid = inside & ~np.isnan(x).any(1)
        z = np.where(valid[:, None], x, 0.0)
        z = np.where(valid[:, None], z - z.sum(0) / max(valid.sum(), 1), 0.0)  # a shift changes no covariance
        moments = np.hstack([valid[:, None].astype(float), z, (z[:, :, None] * z[:, None, :]).reshape(n, -1)])
        total = block_moments(moments, reps, block, seed)
        good = total[:, 0] >= least
        if not good.any():
            return empty
        count = total[good, 0]
        mean = total[good, 1 : 1 + units] / count[:, None]
        cov = total[good, 1 + units :].reshape(-1, units, units) / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
        var = np.clip(np.diagonal(cov, axis1=1, axis2=2), 0, None)
        w = ((sets[:, None] >> np.arange(units)) & 1).astype(float)
        v = np.einsum("su,rut,st->rs", w, cov, w, optimize=True)
        s2, s1 = var @ w.T, np.sqrt(var) @ w.T
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio, rho = np.sqrt(np.maximum(v / s2, 0)), (v - s2) / (s1 * s1 - s2)
        k = len(sets)
        flat = lambda a: np.where(np.isfinite(a), a, np.nan).ravel()
        return {"rep": np.repeat(reps[good], k), "p": np.tile(sets, good.sum()), "hours": np.repeat(count.astype(np.int64), k), "ratio": flat(ratio), "rho_w": flat(rho)}

    return run
