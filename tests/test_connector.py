"""The data source of bars: what it reads, what it leaves unopened, what it refuses."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marketloom.sources.connector import PUSHDOWN, Bars, Wanted, listed, read_store, write_store

DAYS = [dt.date(2021, 12, 28) + dt.timedelta(days=k) for k in range(400)]
TICKERS = ["A", "B/C d,e", "ä"]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('bars')}/store"
    rows = [(d, t, float(k), float(k) + 0.5, 10.0 * k) for t in TICKERS for k, d in enumerate(DAYS)]
    write_store(spark.createDataFrame(rows, "date date, ticker string, open double, close double, volume double"), folder)
    return folder


@pytest.fixture
def pushing(spark):
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "true")
    yield spark
    spark.conf.set(PUSHDOWN, before)


def test_all_rows(spark, store):
    found = read_store(spark, store)
    assert found.columns == ["date", "ticker", "open", "close", "volume"]
    want = sorted((t, d, float(k), 10.0 * k) for t in TICKERS for k, d in enumerate(DAYS))
    assert sorted((r.ticker, r.date, r.open, r.volume) for r in found.collect()) == want
    assert found.select("volume", "ticker").where("volume = 30").count() == 3


@pytest.mark.parametrize("condition", [
    "ticker = 'A'", "ticker in ('A', 'ä') and date >= '2022-12-30'", "date > '2022-05-01' and date <= '2022-05-03'", "date = '2022-01-01' and close > 3",
    "ticker <> 'A' and date < '2022-01-02'", "ticker = 'B/C d,e' or close < 2", "ticker in ('A') and open is not null",
])
def test_filters(spark, store, condition):
    rows = [tuple(r) for r in read_store(spark, store).where(condition).collect()]
    plain = spark.read.parquet(store).withColumn("ticker", F.col("ticker").cast("string")).where(condition).select("date", "ticker", "open", "close", "volume")
    assert sorted(rows) == sorted(tuple(r) for r in plain.collect()) and rows
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "true")
    try:
        assert sorted(tuple(r) for r in read_store(spark, store).where(condition).collect()) == sorted(rows)
    finally:
        spark.conf.set(PUSHDOWN, before)


def test_unwanted_files_stay_closed(pushing, store, tmp_path):
    """Files that a filter rules out may be broken: they aren't opened."""
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(store.removeprefix("file://"), copy)
    for bars in listed(str(copy)):
        if bars.ticker != "A" or bars.year != 2022:
            Path(bars.path).write_bytes(b"broken")
    read_store(pushing, store)  # registers the format
    scan = pushing.read.format("ohlcv").schema("date date, ticker string, close double").option("pushdown", "true").load(f"file://{copy}")
    found = scan.where("ticker = 'A' and date >= '2022-01-01' and date < '2023-01-01'")
    assert found.count() == 365 and found.agg(F.min("date")).first()[0] == dt.date(2022, 1, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" not in plan and not any("ticker = A" in line or "date >=" in line for line in plan.splitlines() if "Filter (" in line), plan
    with pytest.raises(Exception, match="(?i)parquet|invalid"):
        scan.where("ticker = 'A'").count()


def test_empty_results_are_refused(spark, store):
    for given in ({"tickers": ["nowhere"]}, {"start": "2030-01-01"}, {"end": "2000-01-01"}):
        with pytest.raises(Exception, match="No data returned"):
            read_store(spark, store, **given).count()
    some = read_store(spark, store, ["B/C d,e", "ä"], "2022-01-01", "2022-01-03")
    assert sorted((r.ticker, str(r.date)) for r in some.collect()) == [(t, d) for t in TICKERS[1:] for d in ("2022-01-01", "2022-01-02")]


def test_wanted_dates():
    wanted = Wanted()
    wanted.since(dt.date(2022, 12, 31), 1)
    assert wanted.first == dt.date(2023, 1, 1) and not wanted.may_hold(Bars("", "A", 2022, 0)) and wanted.may_hold(Bars("", "A", 2023, 0))
    wanted.until(dt.date(2023, 1, 1), 1)
    assert wanted.last < wanted.first
