"""Sinks: Parquet and CSV folders, and the JSON column store {"index": [...], "data": {column: [...]}}."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_processed(df: DataFrame, path: str, save_parquet: bool = True, save_csv: bool = True, single_file: bool = False) -> list[str]:
    """Writes path.parquet and path.csv (folders, as Spark writes them) and returns what was written. single_file is for small results."""
    stem, written = path.removesuffix(".parquet").removesuffix(".csv"), []
    out = df.coalesce(1) if single_file else df
    if save_parquet:
        out.write.mode("overwrite").parquet(f"{stem}.parquet")
        written.append(f"{stem}.parquet")
    if save_csv:
        out.write.mode("overwrite").option("header", True).csv(f"{stem}.csv")
        written.append(f"{stem}.csv")
    return written


def encode_column_store(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(ticker, store): the ticker's columns as JSON lists in date order. A row a ticker: a day adds a few dozen bytes to it."""
    rows = F.array_sort(F.collect_list(F.struct("date", *columns)))
    sorted_rows = panel.groupBy("ticker").agg(rows.alias("rows"))
    lists = F.struct(*(F.col("rows")[c].alias(c) for c in columns))
    index = F.transform(F.col("rows")["date"], lambda d: F.date_format(d, "yyyy-MM-dd"))
    return sorted_rows.select("ticker", F.to_json(F.struct(index.alias("index"), lists.alias("data")), {"ignoreNullFields": "false"}).alias("store"))


def decode_column_store(stores: DataFrame, columns: list[str]) -> DataFrame:
    """The long panel of (ticker, store) rows."""
    kind = f"index array<string>, data struct<{', '.join(f'{c}: array<double>' for c in columns)}>"
    read = stores.select("ticker", F.from_json("store", kind).alias("s"))
    zipped = F.arrays_zip(F.col("s.index").alias("index"), *(F.col(f"s.data.{c}").alias(c) for c in columns))
    rows = read.select("ticker", F.explode(zipped).alias("r"))
    return rows.select(F.to_date("r.index").alias("date"), "ticker", *(F.col(f"r.{c}").alias(c) for c in columns))
