"""The last known value over gaps, and the capacity of all orders."""

import bisect
import datetime
from collections import Counter

import pytest

from gridloom.operators import lookups
from gridloom.plans import registry


def test_daily_over_gaps(spark):
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i)
    rows = spark.createDataFrame([(i, day(i)) for i in range(12)], "k long, d date")
    known = spark.createDataFrame([(day(2), 5.0), (day(3), 7.0), (day(8), 1.0)], "d date, v double")
    got = {r.k: r.v for r in lookups.daily(rows, known, "d", "v").collect()}
    assert [got[i] for i in range(12)] == [5.0] * 3 + [7.0] * 5 + [1.0] * 4


def test_capacity_of_all_orders(spark, sf_dir):
    cap = Counter()
    for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect():
        cap[r.o_orderdate.date()] += r.o_totalprice
    days = sorted(cap)
    got = sorted(tuple(r) for r in registry.queries()["asof_capacity"](spark, sf_dir).collect())
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect()
    want = sorted((r.l_orderkey, r.l_linenumber, cap[days[max(0, bisect.bisect_right(days, r.l_shipdate.date()) - 1)]]) for r in lines)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=0.02)
