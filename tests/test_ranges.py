"""Quantiles and neighbours by ranges, correlations by blocks, densities by bins: against plain NumPy."""

import datetime as dt
import random

import numpy as np
import pytest
from helpers import START, business_days, panel
from pyspark.sql import functions as F

from marketloom.operators import blocks, clean, explore, features, kendall, ranges


def test_places_and_quantiles(spark):
    rng = random.Random(1)
    values = {"A": [rng.choice([1.0, 2.0, 5.0, None]) for _ in range(900)], "B": [rng.random() for _ in range(501)], "C": [7.0], "D": [None, None], None: [3.0, 1.0]}
    rows = spark.createDataFrame([(t, v) for t, x in values.items() for v in x], "ticker string, v double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        at = ranges.placed(rows, ["v"])
        for t, x in values.items():
            got = sorted((r["__pos"], r.v) for r in at.where(at.ticker.eqNullSafe(t)).collect())
            assert [p for p, _ in got] == list(range(len(x))) and [v for _, v in got] == sorted(x, key=lambda v: (v is not None, v or 0))
        assert {(r.ticker, r["__total"]) for r in at.collect()} == {(t, len(x)) for t, x in values.items()}
        found = {r.ticker: r.quantiles for r in ranges.exact_quantiles(rows, "v", [0.0, 0.01, 0.3, 0.5, 1.0]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    for t, x in values.items():
        known = [v for v in x if v is not None]
        assert (t in found) == bool(known)
        if known:
            assert np.allclose(found[t], np.quantile(known, [0.0, 0.01, 0.3, 0.5, 1.0]))
    plan = explore.describe(panel(spark, {"A": [1, 2]}), "price")._jdf.queryExecution().analyzed().toString()
    assert "percentile" not in plan.lower()


def test_order_report_over_stretches(spark, monkeypatch):
    """Steps back inside stretches and over their ends; ticker None, repeated dates, ties of the order by any neighbour."""
    monkeypatch.setattr(ranges, "STRETCH", 4)
    rng = random.Random(2)
    rows = [(START + dt.timedelta(days=rng.randrange(30)), t, k) for t in ("A", "B", None) for k in range(101)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    found = clean.validation_report(spark.createDataFrame(shuffled, "date date, ticker string, at int").repartition(4), "at").first()
    back = sum(rows[k][1] == rows[k - 1][1] and rows[k][0] < rows[k - 1][0] for k in range(1, len(rows)))
    assert tuple(found) == (303, 303 - len({r[:2] for r in rows}), back)
    none = clean.validation_report(spark.createDataFrame([], "date date, ticker string, at int"), "at").first()
    assert tuple(none) == (0, 0, 0)


@pytest.mark.parametrize("date_block, ticker_block", [(256, 64), (7, 2), (30, 3)])
def test_blocked_correlations(spark, date_block, ticker_block):
    rng = random.Random(3)
    n = 60
    prices = {t: [None if rng.random() < 0.2 else 1e6 + rng.gauss(0, 1) for _ in range(n)] for t in "ABCDEFG"}
    prices |= {"same": [5.5] * n, "few": [1.0] + [None] * (n - 1), "none": [None] * n, "twin": prices["A"]}
    rows = panel(spark, prices, business_days(n))
    want = {(r.i, r.j): r["corr"] for r in explore.correlation_pairs(rows, "price").collect()}
    found = {(r.i, r.j): r["corr"] for r in blocks.blocked_correlations(rows, "price", date_block, ticker_block).collect()}
    assert found.keys() == want.keys()
    for key, corr in want.items():
        assert (corr is None) == (found[key] is None) and (corr is None or abs(corr - found[key]) < 1e-6), key
    assert abs(found["A", "twin"] - 1) < 1e-9


def test_binned_density(spark):
    rng = random.Random(4)
    rows = panel(spark, {"A": [rng.gauss(0, 1) for _ in range(800)], "B": [rng.expovariate(1) for _ in range(800)], "C": [2.0] * 800}, business_days(800))
    exact = {(r.ticker, r.point): (r.x, r.density) for r in explore.density(rows, "price").collect()}
    found = {(r.ticker, r.point): (r.x, r.density) for r in blocks.binned_density(rows, "price").collect()}
    assert found.keys() == exact.keys() and {t for t, _ in found} == {"A", "B"}
    assert all(abs(found[k][0] - exact[k][0]) < 1e-9 and abs(found[k][1] - exact[k][1]) < 1e-4 for k in exact)
    coarse = blocks.binned_density(rows, "price", bins=256).collect()
    assert max(abs(r.density - exact[r.ticker, r.point][1]) for r in coarse) < 1e-3


@pytest.mark.parametrize("buckets", [2, 16])
def test_kendall_by_buckets(spark, buckets):
    """tau-b with ties, gaps, constants and tickers of few dates, against all pairs of dates."""
    rng = random.Random(5)
    n = 70
    prices = {t: [None if rng.random() < 0.1 else rng.gauss(0, 1) for _ in range(n)] for t in "AB"}
    prices |= {"ties": [float(rng.randrange(4)) for _ in range(n)], "same": [5.5] * n, "few": [1.0, 2.0] + [None] * (n - 2), "one": [3.0] + [None] * (n - 1), "up": [float(k) for k in range(n)]}
    found = {(r.i, r.j): r["corr"] for r in kendall.kendall_pairs(panel(spark, prices, business_days(n)), "price", buckets).collect()}
    for i in prices:
        for j in prices:
            both = [(a, b) for a, b in zip(prices[i], prices[j]) if a is not None and b is not None]
            if i < j and both:
                steps = [(np.sign(a[0] - b[0]), np.sign(a[1] - b[1])) for k, a in enumerate(both) for b in both[:k]]
                spread = np.sqrt(float(sum(s != 0 for s, _ in steps))) * np.sqrt(float(sum(t != 0 for _, t in steps)))
                want = sum(s * t for s, t in steps) / spread if spread else None
                got = found.pop((i, j))
                assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-9), (i, j)
    assert not found


def test_rolling_windows_by_stretches(spark):
    """RSI and features of gapped tickers are those of windows over whole tickers, at stretches as short as their reach."""
    rng = random.Random(6)
    prices = {t: [None if rng.random() < 0.1 else 100 * rng.lognormvariate(0, 0.1) for _ in range(n)] + [None] * (100 - n) for t, n in (("A", 100), ("B", 60), ("C", 3))}
    rows = features.with_returns(panel(spark, prices, business_days(100))).withColumn("close", F.col("price"))
    rows = rows.where("ticker <> 'C' or date < '2023-01-05'").repartition(4)
    cases = [(14, lambda r, w=None: features.rsi(r, 14, w)), (20, lambda r, w=None: features.technical_features(r, (5, 20), w))]
    for reach, compute in cases:
        want = sorted(map(repr, compute(rows).collect()))
        for stretch in (20, 33, 4096):
            found = ranges.in_stretches(rows, reach, compute, stretch)
            assert sorted(map(repr, found.select(compute(rows).columns).collect())) == want
    with pytest.raises(ValueError):
        ranges.in_stretches(rows, 21, cases[0][1], 20)
