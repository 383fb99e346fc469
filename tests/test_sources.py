import json

import pytest
from helpers import column, panel

from marketloom.operators import dashboard
from marketloom.sources import panels, sinks
from marketloom.streaming.bars import daily_bars


def test_two_header_csv(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("Date,Close,High,Low,Open,Volume\n,AAPL,AAPL,AAPL,AAPL,AAPL\n2024-01-02,10.5,11,10,10.2,100\n2024-01-03,10.7,11,10,10.4,200\n")
    found = panels.read_two_header_csv(spark, str(path)).orderBy("date").collect()
    assert [(str(r.date), r.ticker, r.close, r.volume) for r in found] == [("2024-01-02", "AAPL", 10.5, 100.0), ("2024-01-03", "AAPL", 10.7, 200.0)]


def test_fetch_prefers_adjusted(spark):
    rows = panel(spark, {"A": [1, 2, 3], "B": [4, 5, 6]}).selectExpr("date", "ticker", "price close", "price * 2 adj_close")
    found = panels.fetch_prices(rows, ["A"], "2023-01-03", "2023-01-04")
    assert [(r.price, r.volume) for r in found.collect()] == [(4.0, None)]
    assert panels.price_column(["close"]) == "close"
    with pytest.raises(KeyError):
        panels.price_column(["open"])


def test_save_and_read(spark, tmp_path):
    rows = panel(spark, {"A": [1, None, float("nan")]}).withColumnRenamed("price", "close")
    written = sinks.save_processed(rows, str(tmp_path / "deep" / "out.parquet"), single_file=True)
    assert [w.rsplit(".", 1)[1] for w in written] == ["parquet", "csv"]
    assert column(panels.read_ohlcv(spark, written[0]), "close") == [1, None, None]
    assert column(panels.read_ohlcv(spark, written[1], "csv"), "close") == [1, None, None]
    assert panels.canonical_frame(rows).where("close is null").count() == 2
    with pytest.raises(ValueError):
        panels.read_ohlcv(spark, "x", "orc")


def test_column_store(spark):
    rows = panel(spark, {"A": [1, None], "B": [3, 4]})
    stores = sinks.encode_column_store(rows, ["price"])
    text = json.loads(stores.where("ticker = 'A'").first().store)
    assert text == {"index": ["2023-01-02", "2023-01-03"], "data": {"price": [1.0, None]}}
    assert sinks.decode_column_store(stores, ["price"]).exceptAll(rows.select("date", "ticker", "price")).count() == 0


def test_generator_is_repeatable(spark):
    first = panels.generate_ohlcv(spark, ["A", "B"], "2024-01-01", 30)
    assert first.count() == 60 and first.exceptAll(panels.generate_ohlcv(spark, ["A", "B"], "2024-01-01", 30)).count() == 0
    assert first.where("high <= open or low >= close or volume < 1e6").count() == 0


def test_dashboard(spark):
    rows = panels.generate_ohlcv(spark, ["A", "B"], "2024-01-01", 60)
    found = {r.chart: json.loads(r.spec) for r in dashboard.chart_specs(rows, "a", "1mo", "2024-02-20").collect()}
    assert set(found) == {"candlestick", "technical", "rsi", "volume"} and found["rsi"]["levels"] == [70, 30]
    assert len(found["technical"]["x"]) == 31 and found["technical"]["SMA_50"] == [None] * 31
    card = dashboard.summary_cards(rows, "a", "1mo", "2024-02-20").first()
    assert card.ticker == "A" and card.change_colour in ("red", "green")
    assert panels.period_filter(rows, "unknown", "2024-12-31").count() == 120


def test_daily_bars_on_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-02 10:00:00' + make_interval(0,0,0,0,id) ts, 'A' ticker, cast(id + 1 as double) price, 2.0D size from range(30)")
    batch = daily_bars(rows).orderBy("date").collect()
    assert [(r.open, r.close, r.volume) for r in batch] == [(1, 14, 28), (15, 30, 32)]
    rows.write.parquet(str(tmp_path / "in"))
    spark.range(1).selectExpr("timestamp'2024-01-09' ts", "'A' ticker", "1.0D price", "1.0D size").write.mode("append").parquet(str(tmp_path / "in"))
    stream = daily_bars(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in")))
    job = stream.writeStream.outputMode("append").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        job.processAllAvailable()
        assert {(r.open, r.close) for r in spark.table("bars").collect()} == {(1, 14), (15, 30)}
    finally:
        job.stop()
