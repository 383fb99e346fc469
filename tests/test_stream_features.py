"""Features of a stream, restarted and with late rows, against the same features in batch."""

import datetime as dt
import math
import random

import pytest
from helpers import business_days, close, panel
from pyspark.sql import functions as F

from marketloom.operators import features, scan
from marketloom.streaming.features import STATE_STORE, feature_columns, replay, run_to_table

WINDOWS, SPANS = (3, 10), (5,)


@pytest.fixture
def rocks(spark):
    session = spark.newSession()
    session.conf.set(*STATE_STORE)
    return session


def series(n=120):
    rng = random.Random(2)
    return {t: [None if rng.random() < 0.1 else 100 * math.exp(rng.gauss(0, 0.1)) for _ in range(n)] for t in "ABC"}


def batch(spark, prices, days):
    rows = features.with_returns(panel(spark, prices, days))
    wide = features.technical_features(rows, WINDOWS).join(rows.select("date", "ticker", "price", "ret"), ["date", "ticker"])
    return scan.ema(wide, "price", list(SPANS))


def same(found, want):
    names = ["price", *feature_columns(WINDOWS, SPANS)]
    key = lambda r: (r["ticker"], r["date"])
    a, b = sorted(found.collect(), key=key), sorted(want.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b]
    for c in names:
        assert close([r[c] for r in a], [r[c] for r in b], 1e-9), c


def test_restarts_and_late_rows(spark, rocks, tmp_path):
    """Rows come out of order by up to 4 days, in 6 files, the query starts anew for every two; one row is 60 days late and left out."""
    prices, days = series(), business_days(120)
    rng = random.Random(3)
    rows = [(dt.datetime.combine(days[k], dt.time()), t, prices[t][k]) for k in range(120) for t in prices]
    rows.sort(key=lambda r: r[0] + dt.timedelta(days=4 * rng.random()))
    source, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    for k in range(6):
        part = rows[k * len(rows) // 6 : (k + 1) * len(rows) // 6]
        if k == 5:
            part += [(dt.datetime.combine(days[20], dt.time(12)), "A", 5.0), (dt.datetime(2030, 1, 1), "end", None)]
        spark.createDataFrame(part, "ts timestamp, ticker string, price double").coalesce(1).write.mode("append").parquet(source)
        if k % 2:
            run_to_table(rocks, source, target, state, "5 days", WINDOWS, SPANS)
    found = spark.read.parquet(target).where("ticker <> 'end'").withColumn("date", F.to_date("ts"))
    same(found, batch(spark, prices, days))


def test_replay(spark):
    prices, days = series(60), business_days(60)
    rows = panel(spark, prices, days)
    found = replay(rows.select(F.col("date").cast("timestamp").alias("ts"), "ticker", "price"), 2, windows=WINDOWS, spans=SPANS)
    same(found.withColumn("date", F.to_date("ts")), batch(spark, prices, days))
    assert replay(rows.limit(0).select(F.col("date").cast("timestamp").alias("ts"), "ticker", "price")).count() == 0
