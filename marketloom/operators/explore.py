"""Exploratory tables: description, missingness, correlations, histogram, density, box statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.expressions import average_rank, correlation, corrected_skew, divide
from marketloom.operators.kendall import kendall_pairs
from marketloom.operators.ranges import exact_quantiles

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Above so many distinct values, their number is NULL.
MAX_DISTINCT = 5000


def require_rows(df: DataFrame, guard: bool = True, name: str = "DataFrame") -> DataFrame:
    """The frame, if it has a row; a caller that knows it turns the guard off, as that reads the frame."""
    if guard and df.isEmpty():
        raise ValueError(f"{name} is empty.")
    return df


def of_ticker(panel: DataFrame, ticker: str | None, name: str = "returns") -> DataFrame:
    """The rows of one ticker, which has to be there; all if none is named."""
    if ticker is None:
        return panel
    some = panel.where(F.col("ticker") == ticker)
    if some.isEmpty():
        raise KeyError(f"{ticker} not found in {name}.")
    return some


def describe(panel: DataFrame, column: str, percentiles: Sequence[float] = PERCENTILES, guard: bool = True) -> DataFrame:
    """One row a ticker, in order: count, mean, std, min, p01 ... (exact, interpolated, the median always among them), max, non_null, n_unique."""
    wanted = sorted({*percentiles, 0.5})
    stats = require_rows(panel, guard).groupBy("ticker").agg(
        F.count(column).cast("double").alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        F.count(column).alias("non_null"),
        F.count_distinct(column).alias("__unique"),
    )
    ranks = exact_quantiles(panel, column, wanted).select(F.col("ticker").alias("__of"), F.col("quantiles").alias("__p"))
    found = stats.join(ranks, F.col("ticker").eqNullSafe(F.col("__of")), "left")
    points = [F.col("__p")[k].alias(f"p{round(100 * p):02d}") for k, p in enumerate(wanted)]
    unique = F.when(F.col("__unique") <= MAX_DISTINCT, F.col("__unique")).alias("n_unique")
    return found.select("ticker", "count", "mean", "std", "min", *points, "max", "non_null", unique).orderBy("ticker")


def missingness(grid: DataFrame, column: str, guard: bool = True) -> DataFrame:
    """One row a ticker of a dense grid, the largest na_pct first: na_count, na_pct, first_na, last_na."""
    none = F.col(column).isNull()
    found = require_rows(grid, guard).groupBy("ticker").agg(F.count_if(none).alias("na_count"), (F.count_if(none) * 100.0 / F.count(F.lit(1))).alias("na_pct"), F.min(F.when(none, F.col("date"))).alias("first_na"), F.max(F.when(none, F.col("date"))).alias("last_na"))
    return found.orderBy(F.desc("na_pct"), "ticker")


def null_counts(panel: DataFrame) -> DataFrame:
    """One row: the number of NULLs of each column."""
    return panel.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}_nulls") for c in panel.columns))


def ticker_pairs(panel: DataFrame, column: str) -> DataFrame:
    """(date, i, j, x, y) of every two tickers i < j of a date: N * (N - 1) / 2 rows a date, the size of a correlation matrix."""
    left = panel.select("date", F.col("ticker").alias("i"), F.col(column).alias("x"))
    right = panel.select("date", F.col("ticker").alias("j"), F.col(column).alias("y"))
    return left.join(right, "date").where("i < j")


def correlation_pairs(panel: DataFrame, column: str, method: str = "pearson", guard: bool = True) -> DataFrame:
    """(i, j, corr) for i < j over dates that both have; NULL for constants."""
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError("method must be 'pearson', 'spearman' or 'kendall'")
    require_rows(panel, guard)
    if method == "kendall":
        return kendall_pairs(panel, column)
    pairs = ticker_pairs(panel, column).where("x is not null and y is not null")
    if method == "spearman":
        pairs = pairs.withColumns({"x": average_rank("x", "i", "j"), "y": average_rank("y", "i", "j")})
    return pairs.groupBy("i", "j").agg(correlation(F.col("x"), F.col("y")).alias("corr"))


def correlation_matrix(panel: DataFrame, column: str, tickers: Sequence[str], method: str = "pearson", guard: bool = True) -> DataFrame:
    """The matrix for display: a row and a column for each of the named tickers. Its diagonal is 1, NULL for a constant ticker."""
    some = panel.where(F.col("ticker").isin(list(tickers)))
    pairs = correlation_pairs(some, column, method, guard)
    own = some.groupBy("ticker").agg(F.when(F.stddev_samp(column) > 0, 1.0).alias("corr")).select(F.col("ticker").alias("i"), F.col("ticker").alias("j"), "corr")
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "corr")).unionByName(own)
    return both.groupBy(F.col("i").alias("ticker")).pivot("j", list(tickers)).agg(F.first("corr"))


def histogram(panel: DataFrame, column: str, bins: int = 50, guard: bool = True, ticker: str | None = None) -> DataFrame:
    """(ticker, bin, low, high, n) of equal bins from each ticker's least to greatest value; the last bin holds the greatest. Empty bins have no row. A named ticker alone, which has to be there."""
    values = of_ticker(require_rows(panel, guard), ticker).where(F.col(column).isNotNull()).select("ticker", column)
    known = values.join(values.groupBy("ticker").agg(F.min(column).alias("__a"), F.max(column).alias("__z")), "ticker")  # a row a ticker
    width = (F.col("__z") - F.col("__a")) / F.lit(float(bins))
    place = F.least(F.lit(bins - 1), F.coalesce(F.floor(divide(F.col(column) - F.col("__a"), width)), F.lit(0)).cast("int"))
    counts = known.select("ticker", "__a", width.alias("__w"), place.alias("bin")).groupBy("ticker", "bin").agg(F.first("__a").alias("__a"), F.first("__w").alias("__w"), F.count(F.lit(1)).alias("n"))
    return counts.select("ticker", "bin", (F.col("__a") + F.col("bin") * F.col("__w")).alias("low"), (F.col("__a") + (F.col("bin") + 1) * F.col("__w")).alias("high"), "n")


def density(panel: DataFrame, column: str, points: int = 100, guard: bool = True, ticker: str | None = None) -> DataFrame:
    """(ticker, point, x, density): Gaussian kernel density by Scott's rule at so many points, three bandwidths beyond the values; no rows without spread.

    Each value adds to each point, so rows grow by the factor `points`; sums are combined before the shuffle.
    """
    known = of_ticker(require_rows(panel, guard), ticker).where(F.col(column).isNotNull())
    stats = known.groupBy("ticker").agg(F.count(F.lit(1)).cast("double").alias("n"), F.stddev_samp(column).alias("sd"), F.min(column).alias("a"), F.max(column).alias("z")).where("sd > 0")
    stats = stats.withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2)))
    grid = stats.select("ticker", "n", "h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), "a", "z")
    grid = grid.withColumn("x", F.col("a") - 3 * F.col("h") + (F.col("z") - F.col("a") + 6 * F.col("h")) * F.col("point") / F.lit(float(points - 1)))
    kernel = F.exp(-F.pow((F.col("x") - F.col(column)) / F.col("h"), F.lit(2.0)) / 2.0)
    sums = known.select("ticker", column).join(grid, "ticker").groupBy("ticker", "point", "x", "n", "h").agg(F.sum(kernel).alias("s"))
    return sums.select("ticker", "point", "x", (F.col("s") / (F.col("n") * F.col("h") * F.sqrt(F.lit(2 * np.pi)))).alias("density"))


def box_stats(panel: DataFrame, column: str, reach: float = 1.5, guard: bool = True, ticker: str | None = None) -> DataFrame:
    """One row a ticker: quartiles, whiskers (the outermost values within so many interquartile ranges) and the number of outliers."""
    known = of_ticker(require_rows(panel, guard), ticker).where(F.col(column).isNotNull()).select("ticker", F.col(column).alias("v"))
    quartiles = exact_quantiles(known, "v", [0.25, 0.5, 0.75]).withColumnRenamed("quantiles", "q")
    bounds = quartiles.select("ticker", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    low, high = F.col("q1") - reach * (F.col("q3") - F.col("q1")), F.col("q3") + reach * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= low) & (F.col("v") <= high)
    whiskers = known.join(bounds, "ticker").groupBy("ticker", "q1", "median", "q3")
    return whiskers.agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))


def panel_stats(panel: DataFrame, column: str) -> DataFrame:
    """One row: mean of the tickers' means and of their standard deviations, least and greatest value, mean of their skewnesses."""
    each = panel.groupBy("ticker").agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.min(column).alias("a"), F.max(column).alias("z"), corrected_skew(column).alias("k"))
    return each.agg(F.avg("m").alias("mean"), F.avg("s").alias("std"), F.min("a").alias("min"), F.max("z").alias("max"), F.avg("k").alias("skewness"))


def first_tickers(panel: DataFrame, max_cols: int = 15) -> DataFrame:
    """Rows of the first tickers by name."""
    names = panel.select("ticker").distinct().orderBy("ticker").limit(max_cols)
    return panel.join(F.broadcast(names), "ticker", "left_semi")  # max_cols rows


def quick_summary(prices: DataFrame | None = None, returns: DataFrame | None = None, max_cols: int = 15, guard: bool = True) -> dict[str, DataFrame]:
    """Lazy tables describe and missingness of returns (ret) if given, else of prices (price), of the first tickers; corr if returns are given."""
    if prices is None and returns is None:
        raise ValueError("Provide at least one of `prices` or `returns`.")
    base, column = (returns, "ret") if returns is not None else (prices, "price")
    use = first_tickers(base, max_cols)
    require_rows(base, guard)
    out = {"describe": describe(use, column, guard=False), "missingness": missingness(use, column, False)}
    if returns is not None:
        out["corr"] = correlation_pairs(use, column, guard=False)
    return out
