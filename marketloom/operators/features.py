"""Returns, technical features and chart indicators: row windows of each ticker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.functions.expressions import by_ticker, canonical, divide, lagged_change, last_known, log_of, rolling

from marketloom.operators.explore import require_rows


def returns(panel: DataFrame, kind: str = "log", column: str = "price", pad: bool = True) -> DataFrame:
    """(date, ticker, ret): change to the row before. Simple returns carry the last price over gaps if pad, log returns never do."""
    return with_returns(panel, kind, column, pad).select("date", "ticker", "ret")


def with_returns(panel: DataFrame, kind: str = "log", column: str = "price", pad: bool = True) -> DataFrame:
    """Adds ret, as `returns` has it."""
    if kind not in ("log", "simple"):
        raise ValueError("kind must be 'log' or 'simple'")
    if kind == "log":
        return panel.withColumn("ret", log_of(column) - F.lag(log_of(column)).over(by_ticker()))
    held = panel.withColumn("__held", last_known(column) if pad else F.col(column))
    return held.withColumn("ret", lagged_change("__held")).drop("__held")


def forward_returns(panel: DataFrame, horizons: Sequence[int], column: str = "price") -> DataFrame:
    """(date, ticker, horizon, fwd): return of the horizon's rows that follow."""
    leads = panel.select("date", "ticker", F.array(*(F.struct(F.lit(k).alias("horizon"), (divide(F.lead(column, k).over(by_ticker()), F.col(column)) - 1).alias("fwd")) for k in horizons)).alias("__all"))
    return leads.select("date", "ticker", F.explode("__all").alias("__one")).select("date", "ticker", "__one.horizon", "__one.fwd")


def technical_features(panel: DataFrame, windows: Sequence[int] = (5, 20, 60), over: WindowSpec | None = None) -> DataFrame:
    """(date, ticker, momentum_w, sma_w, volatility_w ...) of a panel (date, ticker, price, ret), features in the order of their names. over: rows in order, by default a ticker's."""
    columns = {}
    for w in windows:
        least = max(1, w // 2)
        columns[f"sma_{w}"] = rolling(F.avg, "price", w, least, over)
        columns[f"momentum_{w}"] = lagged_change("price", w, over)
        columns[f"volatility_{w}"] = rolling(F.stddev_samp, "ret", w, least, over)
    return panel.select("date", "ticker", *(columns[name].alias(name) for name in sorted(columns)))


def rolling_stats(panel: DataFrame, column: str, windows: Sequence[int] = (20, 60), guard: bool = True) -> DataFrame:
    """(date, ticker, column, mean_w, std_w ...). An empty panel is refused, unless the guard is off."""
    stats = [f(column, w).alias(f"{name}_{w}") for w in windows for name, f in (("mean", lambda c, w: rolling(F.avg, c, w, max(1, w // 2))), ("std", lambda c, w: rolling(F.stddev_samp, c, w, max(1, w // 2))))]
    return require_rows(panel, guard, "series").select("date", "ticker", column, *stats)


def moving_averages(ohlcv: DataFrame, windows: Sequence[int] = (5, 10, 20, 50)) -> DataFrame:
    """Adds SMA_w of close; NULL until w rows are there."""
    return ohlcv.withColumns({f"SMA_{w}": rolling(F.avg, "close", w) for w in windows})


def rsi(ohlcv: DataFrame, period: int = 14, over: WindowSpec | None = None) -> DataFrame:
    """Adds rsi, by simple means of gains and losses. The first row has neither, so the first value is on row `period`; 100 without losses, NULL if flat."""
    delta = F.col("close") - F.lag("close").over(over or by_ticker())
    moved = ohlcv.withColumns({"__gain": F.when(delta > 0, delta).otherwise(0.0), "__loss": F.when(delta < 0, -delta).otherwise(0.0)})
    moved = moved.withColumns({"__up": rolling(F.avg, "__gain", period, window=over), "__down": rolling(F.avg, "__loss", period, window=over)})
    value = F.when(F.col("__down") == 0, F.when(F.col("__up") > 0, F.lit(100.0))).otherwise(100.0 - 100.0 / (1.0 + divide(F.col("__up"), F.col("__down"))))
    return moved.withColumn("rsi", value).drop("__gain", "__loss", "__up", "__down")


def bollinger(ohlcv: DataFrame, window: int = 20, width: float = 2.0) -> DataFrame:
    """Adds middle, upper and lower: the mean of close and so many standard deviations around it."""
    mid, spread = rolling(F.avg, "close", window), rolling(F.stddev_samp, "close", window)
    return ohlcv.withColumns({"middle": mid, "upper": mid + width * spread, "lower": mid - width * spread})


def volume_colours(ohlcv: DataFrame) -> DataFrame:
    """(date, ticker, volume, colour): red where the close is below the open, else green."""
    return ohlcv.select("date", "ticker", "volume", F.when(F.col("close") < F.col("open"), "red").otherwise("green").alias("colour"))


def normalised(panel: DataFrame, column: str = "price", guard: bool = True) -> DataFrame:
    """(date, ticker, normalised): the column by its ticker's first value that isn't NULL. An empty panel is refused, unless the guard is off."""
    start = F.first(F.col(column), ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return require_rows(panel, guard, "prices").select("date", "ticker", divide(F.col(column), start).alias("normalised"))


def summary_stats(ohlcv: DataFrame) -> DataFrame:
    """One row a ticker: last close, change, change in percent, high, low, mean volume, volatility in percent; and the same as display texts."""
    daily = ohlcv.withColumn("__ret", canonical(lagged_change("close")))
    stats = daily.groupBy("ticker").agg(
        F.max_by("close", "date").alias("current_price"),
        F.min_by("close", "date").alias("first_price"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.avg("volume").alias("avg_volume"),
        (F.stddev_samp("__ret") * 100).alias("volatility"),
    )
    change = F.col("current_price") - F.col("first_price")
    stats = stats.withColumns({"price_change": change, "price_change_pct": divide(change, F.col("first_price")) * 100}).drop("first_price")
    texts = {"current_price": "$%.2f", "price_change": "$%.2f", "price_change_pct": "%.2f%%", "high": "$%.2f", "low": "$%.2f", "avg_volume": "%.0f", "volatility": "%.2f%%"}
    return stats.withColumns({f"{c}_text": F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c))) for c, form in texts.items()})
