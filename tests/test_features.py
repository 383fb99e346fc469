import numpy as np
import pandas as pd
from helpers import close, column, panel
from pyspark.sql import functions as F

from marketloom.functions.expressions import average_rank, canonical, corrected_skew, correlation, quantise
from marketloom.operators import features


def ohlcv(spark, closes, volume=None):
    n = len(closes)
    rows = panel(spark, {"A": closes}, None, volume={"A": volume or [1.0] * n})
    return rows.select("date", "ticker", F.col("price").alias("close"), F.col("price").alias("open"), (F.col("price") + 1).alias("high"), (F.col("price") - 1).alias("low"), "volume")


def as_list(s: pd.Series) -> list:
    return [None if np.isnan(x) else float(x) for x in s]


def test_returns(spark):
    rows = panel(spark, {"A": [100 + 10 * k / 6 for k in range(7)]})
    assert abs(column(features.returns(rows, "simple"), "ret")[-1] - 0.01538461538461533) < 1e-12
    assert abs(column(features.returns(rows), "ret")[-1] - 0.015267472130788384) < 1e-12
    gaps = panel(spark, {"A": [1, None, None, 4]})
    assert column(features.returns(gaps, "simple"), "ret") == [None, 0.0, 0.0, 3.0]
    assert column(features.returns(gaps, "simple", pad=False), "ret") == [None] * 4
    assert column(features.returns(panel(spark, {"A": [0, 1, -1, 2]})), "ret") == [None] * 4
    assert column(features.returns(panel(spark, {"A": [0, 1]}), "simple"), "ret") == [None, None]


def test_features_match_pandas(spark):
    rng = np.random.default_rng(1)
    prices = list(100 + rng.normal(0, 1, 80).cumsum())
    prices[10] = None
    rows = panel(spark, {"A": prices})
    both = rows.join(features.returns(rows), ["date", "ticker"])
    found = features.technical_features(both, (5, 20))
    s = pd.Series(prices, dtype=float)
    ret = np.log(s).diff()
    for w in (5, 20):
        assert close(column(found, f"sma_{w}"), as_list(s.rolling(w, min_periods=w // 2).mean()))
        assert close(column(found, f"volatility_{w}"), as_list(ret.rolling(w, min_periods=w // 2).std()), 1e-7)
        assert close(column(found, f"momentum_{w}"), as_list(s / s.shift(w) - 1))
    stats = features.rolling_stats(rows, "price", (20,))
    assert close(column(stats, "std_20"), as_list(s.rolling(20, min_periods=10).std()), 1e-7)


def test_forward_returns(spark):
    found = features.forward_returns(panel(spark, {"A": [1, 2, 4, 8]}), [1, 2])
    assert column(found.where("horizon = 1"), "fwd") == [1, 1, 1, None]
    assert column(found.where("horizon = 2"), "fwd") == [3, 3, None, None]


def test_rsi_edges(spark):
    rising = column(features.rsi(ohlcv(spark, list(range(100, 150)))), "rsi")
    assert rising[:13] == [None] * 13 and rising[13] == rising[-1] == 100
    assert column(features.rsi(ohlcv(spark, [5.0] * 20)), "rsi") == [None] * 20
    rng = np.random.default_rng(2)
    closes = list(100 + rng.normal(0, 1, 60).cumsum())
    d = pd.Series(closes).diff()
    gain, loss = d.where(d > 0, 0).rolling(14).mean(), (-d.where(d < 0, 0)).rolling(14).mean()
    assert close(column(features.rsi(ohlcv(spark, closes)), "rsi"), as_list(100 - 100 / (1 + gain / loss)))


def test_bollinger_and_averages(spark):
    closes = list(np.random.default_rng(3).uniform(90, 110, 60))
    s = pd.Series(closes)
    found = features.bollinger(features.moving_averages(ohlcv(spark, closes)))
    assert close(column(found, "upper"), as_list(s.rolling(20).mean() + 2 * s.rolling(20).std()))
    assert close(column(found, "SMA_50"), as_list(s.rolling(50).mean()))
    assert all(x is None or x <= y for x, y in zip(column(found, "lower"), column(found, "middle")))


def test_summary_colours_and_normalised(spark):
    found = features.summary_stats(ohlcv(spark, [10.0, 12.0, 9.0], [1.0, 2.0, 3.0])).first()
    assert (found.current_price, found.price_change, found.high, found.low, found.avg_volume) == (9.0, -1.0, 13.0, 8.0, 2.0)
    assert (found.price_change_text, found.price_change_pct_text, found.avg_volume_text) == ("$-1.00", "-10.00%", "2")
    rows = ohlcv(spark, [10.0, 12.0]).withColumn("open", F.lit(11.0))
    assert column(features.volume_colours(rows), "colour") == ["red", "green"]
    assert column(features.normalised(panel(spark, {"A": [None, 2, 4]})), "normalised") == [None, 1, 2]


def test_expressions(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double")
    assert [r.r for r in rows.select(average_rank("x").alias("r")).orderBy("r").collect()] == [1, 2.5, 2.5, 4]
    skew = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double").agg(corrected_skew("x")).first()[0]
    assert abs(skew - 1.763632614803888) < 1e-12
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert sorted(str(r.c) for r in odd.select(canonical("x").alias("c")).collect()) == ["1.0", "None", "None"]
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "x double, y double")
    assert flat.agg(correlation(F.col("x"), F.col("y"))).first()[0] is None
    assert flat.agg(quantise(F.max("y"))).first()[0] == 3.0
