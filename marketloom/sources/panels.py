"""Sources: price panels in long form (date, ticker, measures), calendars, CSV artefacts, a seeded generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.expressions import canonical

MEASURES = ["open", "high", "low", "close", "adj_close", "volume"]
#: Days back by name; any other name means a year.
PERIOD_DAYS = {"1mo": 30, "3mo": 90, "6mo": 180, "1y": 365, "2y": 730, "5y": 1825}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def canonical_frame(df: DataFrame) -> DataFrame:
    """NaN and infinities of all double and float columns as NULL."""
    return df.withColumns({name: canonical(f"`{name}`") for name, kind in df.dtypes if kind in ("double", "float")})


def read_ohlcv(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A long panel from Parquet, or CSV with a header, with columns in any case and blanks or underscores in their names."""
    if form not in ("parquet", "csv"):
        raise ValueError("form must be 'parquet' or 'csv'")
    raw = spark.read.parquet(path) if form == "parquet" else spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.strip().lower().replace(" ", "_") for c in raw.columns))
    kept = [c for c in MEASURES if c in raw.columns]
    date = F.to_date("date") if form == "csv" else F.col("date").cast("date")
    return raw.select(date.alias("date"), "ticker", *(canonical(F.col(c)).alias(c) for c in kept))


def price_column(columns: list[str]) -> str:
    """The adjusted close where there is one, else the close."""
    for name in ("adj_close", "close"):
        if name in columns:
            return name
    raise KeyError("neither adj_close nor close is there")


NO_DATA = "No data returned. Check tickers, dates, or interval."


def fetch_prices(ohlcv: DataFrame, tickers: list[str] | None = None, start: str | None = None, end: str | None = None, guard: bool = True) -> DataFrame:
    """(date, ticker, price, volume): adjusted closes are preferred, end is not included. An empty result is refused; a caller that knows better turns the guard off, as that reads a row."""
    out = ohlcv if tickers is None else ohlcv.where(F.col("ticker").isin(list(tickers)))
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("date") < F.lit(end).cast("date"))
    price = price_column(out.columns)
    if guard and out.isEmpty():
        raise ValueError(NO_DATA)
    volume = F.col("volume").cast("double") if "volume" in out.columns else F.lit(None).cast("double")
    return out.select("date", "ticker", canonical(price).alias("price"), volume.alias("volume"))


def read_two_header_csv(spark: SparkSession, path: str) -> DataFrame:
    """OHLCV of one ticker from a CSV whose second row holds the ticker's name under each measure."""
    raw = spark.read.option("header", True).csv(path)
    names = {c: c.strip().lower().replace(" ", "_") for c in raw.columns}
    measures = [c for c in raw.columns if names[c] in MEASURES]
    dated = F.to_date(F.col(f"`{raw.columns[0]}`"))
    ticker = raw.where(F.col(f"`{raw.columns[0]}`").isNull()).select(F.col(f"`{measures[0]}`").alias("ticker")).limit(1)
    rows = raw.where(F.col(f"`{raw.columns[0]}`").isNotNull()).select(dated.alias("date"), *(canonical(F.col(f"`{c}`").cast("double")).alias(names[c]) for c in measures))
    return rows.crossJoin(F.broadcast(ticker))  # one row


def region_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel R (date, ticker, price, volume): a region is a ticker, its price the mean unit price of what it ships that day."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    # nation and region have fixed sizes; supplier grows with the data, so its join is left to Catalyst.
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    sellers = table(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")  # noqa: E731  decimal sums don't depend on order
    sums = lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("r_name").alias("ticker")).agg(exact("l_extendedprice").alias("paid"), exact("l_quantity").alias("volume"))
    return sums.select("date", "ticker", F.try_divide("paid", "volume").alias("price"), "volume")


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel O (date, ticker, open, high, low, close, volume): an order priority is a ticker, its orders of a day are its trades."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("ticker"))
    return orders.groupBy("date", "ticker").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def calendar(panel: DataFrame, freq: str = "B") -> DataFrame:
    """Dates from the first to the last of the panel: 'B' Monday to Friday (no holidays), 'D' all."""
    if freq not in ("B", "D"):
        raise ValueError("freq must be 'B' or 'D'")
    days = panel.agg(F.min("date").alias("a"), F.max("date").alias("z")).where("a is not null").select(F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("date"))
    return days.where(F.weekday("date") < 5) if freq == "B" else days


def dense_grid(panel: DataFrame, freq: str = "B") -> DataFrame:
    """Every ticker on every date of the calendar; rows off the calendar are left out, missing measures are NULL."""
    # One pass for the tickers and their first and last dates, from which the calendar follows.
    spans = panel.groupBy("ticker").agg(F.min("date").alias("date"), F.max("date").alias("__last"))
    days = calendar(spans.select(F.explode(F.array("date", "__last")).alias("date")), freq)
    # The calendar has a row a day, so this is tickers * days, the size of the result.
    return spans.select("ticker").crossJoin(F.broadcast(days)).join(panel, ["date", "ticker"], "left")


def period_filter(panel: DataFrame, period: str, as_of: str) -> DataFrame:
    """Rows of the last days before as_of (both ends included) that the period names."""
    end = F.lit(as_of).cast("date")
    return panel.where((F.col("date") >= F.date_sub(end, PERIOD_DAYS.get(period, 365))) & (F.col("date") <= end))


def generate_ohlcv(spark: SparkSession, tickers: list[str], start: str, days: int, seed: int = 42) -> DataFrame:
    """Seeded uniform draws for fixtures: open and close in [100, 110), high in [110, 120), low in [90, 100), volume in [1e6, 1e7)."""
    names = F.array(*(F.lit(t) for t in tickers))
    rows = spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date"), F.explode(names).alias("ticker"))
    draw = lambda k, low, width: F.lit(low) + F.pmod(F.xxhash64("date", "ticker", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003.0 * width
    return rows.select("date", "ticker", draw(0, 100.0, 10.0).alias("open"), draw(1, 110.0, 10.0).alias("high"), draw(2, 90.0, 10.0).alias("low"), draw(3, 100.0, 10.0).alias("close"), F.floor(draw(4, 1e6, 9e6)).cast("double").alias("volume"))
