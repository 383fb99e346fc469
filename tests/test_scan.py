"""Scans over time blocks against plain loops, with a ticker forced over many blocks."""

import math
import random

import pytest
from helpers import business_days, close, column, panel
from pyspark.sql import functions as F

from marketloom.functions.expressions import last_known
from marketloom.operators import features, scan

RNG = random.Random(11)
N = 420
GAPPED = [None if RNG.random() < 0.3 else 100 * math.exp(RNG.gauss(0, 0.2)) for _ in range(N)]
SERIES = {"A": GAPPED, "B": [50.0 + k for k in range(N)], "C": [None] * 90 + [10.0] * (N - 90), "D": [None] * N, "E": [200.0 - 0.4 * k for k in range(N)]}


def plain_ema(values, span):
    a, now, out = 2 / (span + 1), None, []
    for v in values:
        now = now if v is None else v if now is None else a * v + (1 - a) * now
        out.append(now)
    return out


@pytest.mark.parametrize("block_days", [1, 5, 64])
def test_ema_and_macd(spark, block_days):
    found = scan.macd(scan.ema(panel(spark, SERIES), "price", [3, 12], block_days=block_days), "price", block_days=block_days).cache()
    for t, values in SERIES.items():
        fast, slow = plain_ema(values, 12), plain_ema(values, 26)
        macd = [None if a is None else a - b for a, b in zip(fast, slow)]
        signal = plain_ema(macd, 9)
        assert close(column(found, "EMA_3", t), plain_ema(values, 3)) and close(column(found, "EMA_12", t), fast)
        assert close(column(found, "macd", t), macd, 1e-8) and close(column(found, "macd_signal", t), signal, 1e-8)
        assert close(column(found, "macd_hist", t), [None if m is None else m - s for m, s in zip(macd, signal)], 1e-8)
    found.unpersist()


@pytest.mark.parametrize("limit", [None, 0, 1, 5])
def test_carry_is_the_window(spark, limit):
    rows = panel(spark, SERIES).repartition(7)
    want = rows.withColumn("price", last_known("price", limit))
    found = scan.fill_forward(rows, "price", limit, block_days=8)
    assert found.exceptAll(want.select(found.columns)).count() == 0 and found.count() == want.count()


def test_simple_returns_are_the_window(spark):
    rows = panel(spark, SERIES)
    want = features.returns(rows, "simple")
    found = scan.simple_returns(rows, block_days=8).select("date", "ticker", "ret")
    for t in SERIES:
        assert close(column(found, "ret", t), column(want, "ret", t))


def test_drawdowns_and_risk(spark):
    found = scan.drawdowns(panel(spark, SERIES), block_days=8).cache()
    risk = {r.ticker: r for r in scan.risk_stats(panel(spark, SERIES), block_days=8).collect()}
    for t, values in SERIES.items():
        peak = worst = None
        peaks, falls, worsts = [], [], []
        for v in values:
            if v is not None:
                peak = v if peak is None else max(peak, v)
                worst = min(0.0 if worst is None else worst, v / peak - 1)
            peaks.append(peak)
            falls.append(None if v is None else v / peak - 1)
            worsts.append(worst)
        assert close(column(found, "peak", t), peaks) and close(column(found, "drawdown", t), falls) and close(column(found, "max_drawdown", t), worsts)
        known = [math.log(v) for v in values if v is not None]
        if known:
            rets = [b - a for a, b in zip(known, known[1:])]
            mean = sum(rets) / len(rets)
            sd = math.sqrt(sum((r - mean) ** 2 for r in rets) / (len(rets) - 1))
            assert close([risk[t].max_drawdown, risk[t].sharpe], [worsts[-1], mean / sd * math.sqrt(252) if sd > 1e-15 else None])
        else:
            assert t not in risk
    found.unpersist()


def test_a_ticker_is_over_many_tasks(spark):
    """One ticker, 3,000 days: its rows are dealt by block, and nothing but summaries comes together by ticker."""
    values = [float(k % 97) + 1 for k in range(3000)]
    rows = panel(spark, {"A": values}, business_days(3000))
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        found = scan.ema(rows, "price", [12])
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        dealt = rows.withColumn("b", F.floor(F.datediff("date", F.lit("1970-01-01")) / 64)).select("ticker", "b").distinct().count()
        assert dealt > 50 and "collect_list" not in plan
        assert close(column(found, "EMA_12"), plain_ema(values, 12))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_extra_columns_and_empty(spark):
    rows = panel(spark, SERIES).withColumn("a.b", F.lit(1)).withColumn("n", F.lit("x"))
    assert scan.ema(rows, "price", [5]).columns == ["date", "ticker", "price", "a.b", "n", "EMA_5"]
    assert scan.drawdowns(rows.limit(0)).count() == 0 and scan.risk_stats(rows.limit(0)).count() == 0
