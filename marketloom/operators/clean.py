"""Validation, alignment to a calendar, filling, coverage, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.expressions import by_ticker, clip, last_known
from marketloom.operators.ranges import order_report
from marketloom.sources.panels import dense_grid


def keep_first(panel: DataFrame, order: str) -> DataFrame:
    """Of rows with equal date and ticker, the first by `order`."""
    first = Window.partitionBy("ticker", "date").orderBy(order)
    return panel.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")


def validation_report(panel: DataFrame, order: str | None = None) -> DataFrame:
    """One row: rows, rows that repeat a date of their ticker, rows earlier than the one before them by `order` (0 without one)."""
    if order is None:
        rows = panel.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
        return rows.withColumn("n_backward", F.lit(0).cast("long"))
    return order_report(panel, order)


def validate_prices(panel: DataFrame, order: str | None = None) -> None:
    """Raises for the first that fails: rows there, dates, ascending (by `order`, else not judged), no duplicates, numeric measures."""
    kinds = {f.name: f.dataType for f in panel.schema.fields}
    found = validation_report(panel, order).first() if isinstance(kinds.get("date"), (T.DateType, T.TimestampType, T.TimestampNTZType)) else None
    if found is None and panel.isEmpty() or found is not None and not found["n_rows"]:
        raise ValueError("Price panel is empty.")
    if found is None:
        raise TypeError("date must be a date or timestamp column.")
    if found["n_backward"]:
        raise ValueError("Dates must be sorted ascending (monotonic increasing).")
    if found["n_duplicates"]:
        raise ValueError("Panel contains duplicate timestamps.")
    if not all(isinstance(kind, T.NumericType) for name, kind in kinds.items() if name not in ("date", "ticker", order)):
        raise TypeError("All measures must be numeric types.")


def positivity(panel: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether all values of each column are above 0; missing ones are not."""
    return panel.agg(*(F.coalesce(F.bool_and(F.coalesce(F.col(c) > 0, F.lit(False))), F.lit(True)).alias(f"{c}_positive") for c in columns))


def fill_gaps(grid: DataFrame, column: str, ffill_limit: int = 5, bfill_limit: int = 1) -> DataFrame:
    """Forward fill of at most ffill_limit rows, then back fill of at most bfill_limit (which looks ahead), per ticker on a dense grid."""
    out = grid.withColumn("__filled", last_known(column, ffill_limit))
    ahead = F.first("__filled", ignorenulls=True).over(by_ticker().rowsBetween(0, bfill_limit))
    return out.withColumn(column, ahead if bfill_limit else F.col("__filled")).drop("__filled")


def coverage(grid: DataFrame, column: str) -> DataFrame:
    """(ticker, coverage): share of rows that aren't NULL."""
    return grid.groupBy("ticker").agg(F.avg(F.col(column).isNotNull().cast("double")).alias("coverage"))


def keep_covered(grid: DataFrame, column: str, least: float = 0.8) -> DataFrame:
    """Rows of tickers whose coverage is at least so much."""
    share = F.avg(F.col(column).isNotNull().cast("double")).over(Window.partitionBy("ticker"))
    return grid.withColumn("__share", share).where(F.col("__share") >= least).drop("__share")


def dropped_tickers(grid: DataFrame, column: str, least: float = 0.8) -> DataFrame:
    """(ticker) of those that keep_covered leaves out."""
    return coverage(grid, column).where(F.col("coverage") < least).select("ticker")


def align_and_fill(panel: DataFrame, column: str = "price", freq: str = "B", ffill_limit: int = 5, min_coverage: float = 0.8) -> DataFrame:
    """(date, ticker, column) on the whole calendar, with short gaps filled, of tickers with enough coverage after filling."""
    return keep_covered(fill_gaps(dense_grid(panel.select("date", "ticker", column), freq), column, ffill_limit), column, min_coverage)


def winsorise(panel: DataFrame, column: str = "price", z: float = 6.0) -> DataFrame:
    """The column within z standard deviations of its ticker's mean, over all dates."""
    over = Window.partitionBy("ticker")
    mean, spread = F.avg(column).over(over), F.stddev_samp(column).over(over)
    return panel.withColumns({"__mean": mean, "__spread": spread}).withColumn(column, clip(F.col(column), F.col("__mean") - z * F.col("__spread"), F.col("__mean") + z * F.col("__spread"))).drop("__mean", "__spread")
