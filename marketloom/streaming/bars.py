"""Daily bars from a stream of trades. Row windows need whole history, so features are computed from the bars in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(trades: DataFrame, late: str = "1 day") -> DataFrame:
    """(date, ticker, open, high, low, close, volume) of trades (ts, ticker, price, size), batch or stream.

    On a stream in append mode a day is emitted once the watermark has passed its end; trades later than that are left out.
    """
    days = trades.withWatermark("ts", late) if trades.isStreaming else trades
    bars = days.groupBy(F.window("ts", "1 day").alias("w"), "ticker").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume")
    )
    return bars.select(F.to_date("w.start").alias("date"), "ticker", "open", "high", "low", "close", "volume")
