import datetime as dt

import pytest
from helpers import START, business_days, close, column, panel
from pyspark.sql import functions as F

from marketloom.operators import clean
from marketloom.operators.prepare import prepare_price_data
from marketloom.sources import panels


def test_fill_gaps_limits_forward_and_looks_one_row_ahead(spark):
    values = [None, None, 1, *[None] * 8, 2, None, None, None]
    found = column(clean.fill_gaps(panel(spark, {"A": values}), "price"), "price")
    assert found == [None, 1, 1, 1, 1, 1, 1, 1, None, None, 2, 2, 2, 2, 2]


def test_align_drops_weekends_and_poor_tickers(spark):
    days = [START + dt.timedelta(days=k) for k in range(28)]
    rows = panel(spark, {"A": list(range(1, 29)), "B": [1.0] + [None] * 27}, days)
    found = clean.align_and_fill(rows)
    assert {r.ticker for r in found.collect()} == {"A"}
    assert all(d.weekday() < 5 for d in column(found, "date")) and found.count() == 20
    assert [r.ticker for r in clean.dropped_tickers(rows, "price").collect()] == ["B"]
    assert clean.align_and_fill(rows, freq="D").count() == 28


def test_calendar_rolls_a_weekend_start_forward(spark):
    days = spark.createDataFrame([(dt.date(2020, 1, 4),), (dt.date(2020, 1, 8),)], "date date")
    assert [r.date.day for r in panels.calendar(days).orderBy("date").collect()] == [6, 7, 8]
    long = spark.createDataFrame([(dt.date(2020, 1, 2),), (dt.date(2024, 12, 30),)], "date date")
    assert panels.calendar(long).count() == 1303
    with pytest.raises(ValueError):
        panels.calendar(days, "W")


def test_winsorise(spark):
    rows = panel(spark, {"A": [100 + 10 * k / 6 for k in range(6)] + [10000]})
    assert column(clean.winsorise(rows, z=2.5), "price")[-1] == 10000
    assert abs(column(clean.winsorise(rows, z=2.0), "price")[-1] - 8998.40617060997) < 1e-6
    holes = panel(spark, {"A": [1, None, 3]})
    assert column(clean.winsorise(holes), "price") == [1, None, 3]
    assert column(clean.winsorise(panel(spark, {"A": [5, None]})), "price") == [5, None]


def test_validation_messages_in_order(spark):
    good = panel(spark, {"A": [1, 2, 3]})
    clean.validate_prices(good)
    with pytest.raises(ValueError, match="empty"):
        clean.validate_prices(good.limit(0))
    with pytest.raises(TypeError, match="date"):
        clean.validate_prices(good.withColumn("date", F.lit("x")))
    with pytest.raises(ValueError, match="duplicate"):
        clean.validate_prices(good.union(good.limit(1)))
    with pytest.raises(TypeError, match="numeric"):
        clean.validate_prices(good.withColumn("note", F.lit("x")))
    back = good.withColumn("seq", -F.unix_date("date"))
    with pytest.raises(ValueError, match="ascending"):
        clean.validate_prices(back, "seq")


def test_keep_first_and_positivity(spark):
    rows = spark.createDataFrame([(START, "A", 2, 5.0), (START, "A", 1, 4.0), (START, "B", 3, None)], "date date, ticker string, seq int, price double")
    assert {(r.ticker, r.price) for r in clean.keep_first(rows, "seq").collect()} == {("A", 4.0), ("B", None)}
    assert clean.positivity(rows, ["price", "seq"]).first() == (False, True)
    assert clean.positivity(rows.limit(0), ["price"]).first() == (True,)


def test_prepare_price_data(spark):
    days = business_days(70)
    rows = panel(spark, {t: [base + k for k in range(70)] for t, base in (("A", 100), ("B", 50))}, days, volume={"A": [1e6] * 70, "B": [2e6] * 70})
    found = prepare_price_data(rows, return_kind="simple", winsorize_z=None, feature_windows=(3, 5))
    assert found.prices.count() == found.returns.count() == found.features.count() == found.volumes.count() == 140
    assert found.features.columns == ["date", "ticker", "momentum_3", "momentum_5", "sma_3", "sma_5", "volatility_3", "volatility_5"]
    assert close(column(found.returns, "ret", "A")[:3], [None, 1 / 100, 1 / 101])
    assert column(found.panel, "volume", "B")[0] == 2e6
    with pytest.raises(ValueError):
        prepare_price_data(rows, return_kind="daily")
