"""From raw rows to clean prices, returns, features and volumes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.clean import fill_gaps, validate_prices, winsorise
from marketloom.operators.features import technical_features, with_returns
from marketloom.sources.panels import dense_grid


@dataclass
class Prepared:
    """Lazy frames: prices (date, ticker, price), returns (..., ret), features, volumes (..., volume). Tickers of volumes may differ from those of prices.

    panel has price, volume and ret of the tickers of prices, from one chain of windows; volume is NULL where its ticker has too few.
    """

    prices: DataFrame
    returns: DataFrame
    features: DataFrame
    volumes: DataFrame
    panel: DataFrame


def prepare_price_data(
    panel: DataFrame,
    return_kind: str = "log",
    calendar_freq: str = "B",
    ffill_limit: int = 5,
    min_coverage: float = 0.8,
    winsorize_z: float | None = 6.0,
    feature_windows: Sequence[int] = (5, 20, 60),
    validate: bool = True,
) -> Prepared:
    """Validates (date, ticker, price, volume) rows, aligns both measures to the calendar, caps prices and derives returns and features."""
    if validate:
        validate_prices(panel.select("date", "ticker", "price"))
    # Both measures are on the same rows, so they share the calendar, the exchange by ticker and its sort.
    grid = dense_grid(panel.select("date", "ticker", "price", "volume"), calendar_freq)
    filled = fill_gaps(fill_gaps(grid, "price", ffill_limit), "volume", ffill_limit)
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double")).over(Window.partitionBy("ticker"))
    filled = filled.withColumns({"__p": share("price"), "__v": share("volume")})
    volumes = filled.where(F.col("__v") >= min_coverage).select("date", "ticker", "volume")
    clean = filled.where(F.col("__p") >= min_coverage).select("date", "ticker", "price", F.when(F.col("__v") >= min_coverage, F.col("volume")).alias("volume"))
    if winsorize_z is not None:
        clean = winsorise(clean, "price", winsorize_z)
    clean = with_returns(clean, return_kind)
    return Prepared(clean.select("date", "ticker", "price"), clean.select("date", "ticker", "ret"), technical_features(clean, feature_windows), volumes, clean)
