"""What a chart page needs of one ticker, as rows and as JSON specifications; rendering is left to the page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.features import bollinger, moving_averages, rsi, summary_stats, volume_colours
from marketloom.sources.panels import period_filter

CHART_COLUMNS = {
    "candlestick": ["open", "high", "low", "close"],
    "technical": ["close", "SMA_5", "SMA_10", "SMA_20", "SMA_50", "middle", "upper", "lower"],
    "rsi": ["rsi"],
    "volume": ["volume", "colour"],
}
CHART_TITLES = {"candlestick": "Stock Price", "technical": "Technical Indicators", "rsi": "RSI", "volume": "Trading Volume"}
RSI_LEVELS = [70, 30]


def chart_rows(ohlcv: DataFrame, ticker: str, period: str, as_of: str) -> DataFrame:
    """The ticker's rows of the period with all indicators. The period is cut first, so indicators start anew in it."""
    rows = period_filter(ohlcv.where(F.col("ticker") == ticker.upper()), period, as_of)
    rows = bollinger(rsi(moving_averages(rows)))
    return rows.join(volume_colours(rows).select("date", "ticker", "colour"), ["date", "ticker"])


def chart_specs(ohlcv: DataFrame, ticker: str, period: str = "1y", as_of: str = "2024-12-31") -> DataFrame:
    """(chart, title, spec) rows: each spec is JSON with x and a list for each trace, in date order; rsi has its levels too."""
    rows = chart_rows(ohlcv, ticker, period, as_of)
    columns = list(dict.fromkeys(c for names in CHART_COLUMNS.values() for c in names))
    # One ticker and period: some thousand rows at most.
    one = rows.agg(F.array_sort(F.collect_list(F.struct("date", *columns))).alias("r"))
    specs = []
    for chart, names in CHART_COLUMNS.items():
        traces = [F.col("r")[c].alias(c) for c in names]
        levels = [F.array(*(F.lit(x) for x in RSI_LEVELS)).alias("levels")] if chart == "rsi" else []
        spec = F.to_json(F.struct(F.transform(F.col("r")["date"], lambda d: F.date_format(d, "yyyy-MM-dd")).alias("x"), *traces, *levels), {"ignoreNullFields": "false"})
        specs.append(F.struct(F.lit(chart).alias("chart"), F.lit(f"{ticker.upper()} {CHART_TITLES[chart]}").alias("title"), spec.alias("spec")))
    return one.select(F.explode(F.array(*specs)).alias("s")).select("s.*")


def summary_cards(ohlcv: DataFrame, ticker: str, period: str = "1y", as_of: str = "2024-12-31") -> DataFrame:
    """The ticker's summary over the period, with the colour of its change."""
    stats = summary_stats(period_filter(ohlcv.where(F.col("ticker") == ticker.upper()), period, as_of))
    return stats.withColumn("change_colour", F.when(F.col("price_change") < 0, "red").otherwise("green"))
