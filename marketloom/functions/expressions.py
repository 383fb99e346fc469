"""Column expressions shared by the operators: null-safe arithmetic, row windows of a ticker, statistics of a cross-section.

Missing is NULL. Divisions and correlations are guarded, as Spark raises on zero divisors when ANSI mode is on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(c: Column | str) -> Column:
    """NaN and infinities as NULL."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def divide(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def log_of(p: Column | str) -> Column:
    """Natural logarithm, NULL unless positive."""
    return F.when(col(p) > 0, F.log(col(p)))


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within bounds; NULL stays NULL, a NULL bound doesn't bind."""
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def quantise(c: Column | str, places: int = 6) -> Column:
    """Rounded to so many places by a floor, which has no ties that engines treat differently."""
    return F.floor(col(c) * F.lit(float(10**places)) + 0.5) / F.lit(float(10**places))


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def trailing(n: int, window: WindowSpec | None = None) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return (window or by_ticker()).rowsBetween(-(n - 1), 0)


def rolling(aggregate: Callable[[Column], Column], c: Column | str, n: int, least: int | None = None, window: WindowSpec | None = None) -> Column:
    """An aggregate of the last n rows that skips NULLs; NULL where fewer than `least` (default n) are there."""
    frame, x = trailing(n, window), col(c)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), aggregate(x).over(frame))


def lagged_change(c: Column | str, n: int = 1, window: WindowSpec | None = None) -> Column:
    """c / (c, n rows before) - 1."""
    return divide(col(c), F.lag(col(c), n).over(window or by_ticker())) - 1


def last_known(c: Column | str, limit: int | None = None) -> Column:
    """The last value that isn't NULL, at most `limit` rows back."""
    start = Window.unboundedPreceding if limit is None else -limit
    return F.last(col(c), ignorenulls=True).over(by_ticker().rowsBetween(start, 0))


def correlation(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of the pairs that are complete; NULL for constants and fewer than two pairs."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    put = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return divide(put(F.covar_samp(a, b)), F.nullif(put(F.stddev_samp(a)) * put(F.stddev_samp(b)), F.lit(0.0)))


def average_rank(x: Column | str, *partition: str) -> Column:
    """1-based rank of x within the partition, ties getting their mean."""
    ordered = Window.partitionBy(*partition).orderBy(col(x))
    return F.rank().over(ordered).cast("double") + (F.count(F.lit(1)).over(Window.partitionBy(*partition, col(x))).cast("double") - 1.0) / 2.0


def zscore(x: Column | str, null_spread: bool = True) -> Column:
    """(x - mean) / standard deviation of the date. A spread of 0 gives NULL, or 0 if null_spread is False."""
    over = by_date()
    spread = F.stddev_samp(col(x)).over(over)
    return (col(x) - F.avg(col(x)).over(over)) / ((F.nullif(spread, F.lit(0.0)) if null_spread else spread) + EPS)


def corrected_skew(x: Column | str) -> Column:
    """Bias-corrected sample skewness, as an aggregate; NULL below three values or without spread."""
    n, sd = F.count(col(x)).cast("double"), F.stddev_samp(col(x))
    return F.when((n > 2) & (sd > 0), F.skewness(col(x)) * F.sqrt(n * (n - 1)) / (n - 2))
