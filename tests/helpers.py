"""Small long panels for tests."""

import datetime as dt

import pandas as pd

START = dt.date(2023, 1, 2)


def business_days(n: int, start: dt.date = START) -> list[dt.date]:
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def panel(spark, prices: dict[str, list], days: list | None = None, **more: dict[str, list]):
    """(date, ticker, price, ...) from lists by ticker."""
    n = len(next(iter(prices.values())))
    days = days or business_days(n)
    names = ["price", *more]
    rows = [(days[k], t, *(None if table[t][k] is None else float(table[t][k]) for table in (prices, *more.values()))) for t in prices for k in range(n)]
    return spark.createDataFrame(rows, "date date, ticker string, " + ", ".join(f"{c} double" for c in names))


def column(df, name: str, ticker: str | None = None) -> list:
    """A ticker's values in date order."""
    rows = df.where(df["ticker"] == ticker) if ticker else df
    return [r[name] for r in rows.orderBy("date").collect()]


def close(a: list, b: list, tolerance: float = 1e-9) -> bool:
    return len(a) == len(b) and all((x is None) == (y is None) and (x is None or abs(x - y) <= tolerance * max(1, abs(y))) for x, y in zip(a, b))
