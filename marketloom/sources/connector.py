"""A Spark data source for a store of daily bars: files by ticker and year, of which only those are opened that a query's tickers and dates can be in.

The store is what `write_store` makes: <folder>/ticker=<name>/year=<year>/*.parquet, in any file system that pyarrow knows. Filters on ticker and date are
pushed into the reader, which drops files by their folders and rows by the files' statistics, with the option pushdown; Spark allows that only where the
session has spark.sql.python.filterPushdown.enabled. The options tickers (names with commas between, quoted as in a URL), start and end (excluded) do the
same without it. A scan that is left without any file is refused. Files are dealt to tasks by their bytes.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read_store(spark, folder).where("ticker in ('A', 'B') and date >= '2024-01-01'")
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from marketloom.sources.panels import MEASURES, NO_DATA

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes of files that a task reads, where there are more.
TASK_BYTES = 64 << 20


def write_store(panel: DataFrame, folder: str) -> None:
    """Writes (date, ticker, measures) as a store, each ticker's year by one task in order of date."""
    rows = panel.withColumn("year", F.year("date"))
    rows.repartition("ticker", "year").sortWithinPartitions("ticker", "year", "date").write.partitionBy("ticker", "year").parquet(folder)


def file_system(folder: str):
    """pyarrow's file system for an address or a local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


@dataclass(frozen=True)
class Bars:
    """A file of one ticker's bars in one year."""

    path: str
    ticker: str
    year: int
    size: int


@dataclass
class Files(InputPartition):
    """What a task reads."""

    bars: list[Bars] = field(default_factory=list)


def listed(folder: str) -> list[Bars]:
    from pyarrow import fs

    system, root = file_system(folder)
    out = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
        found = re.search(r"/ticker=([^/]*)/year=(\d+)/[^/._][^/]*\.parquet$", info.path)
        if found and info.is_file:
            out.append(Bars(info.path, unquote(found[1]), int(found[2]), info.size))
    return sorted(out, key=lambda b: b.path)


@dataclass
class Wanted:
    """Tickers (None: all) and dates, from first to last, both included."""

    tickers: set[str] | None = None
    first: dt.date = dt.date.min
    last: dt.date = dt.date.max

    def only(self, tickers: Sequence[str]) -> None:
        self.tickers = set(tickers) if self.tickers is None else self.tickers & set(tickers)

    def since(self, day: dt.date, days: int = 0) -> None:
        self.first = max(self.first, day + dt.timedelta(days=days) if day < dt.date.max else dt.date.max)

    def until(self, day: dt.date, days: int = 0) -> None:
        self.last = min(self.last, day - dt.timedelta(days=days) if day > dt.date.min else dt.date.min)

    def take(self, rule: Filter) -> bool:
        """Narrows by a filter on ticker or date; False for any other, which Spark then applies itself."""
        column = getattr(rule, "attribute", None)
        if column == ("ticker",) and isinstance(rule, EqualTo):
            self.only([rule.value])
        elif column == ("ticker",) and isinstance(rule, In):
            self.only(rule.value)
        elif column == ("date",) and isinstance(getattr(rule, "value", None), dt.date):
            if isinstance(rule, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                self.since(rule.value, int(isinstance(rule, GreaterThan)))
            if isinstance(rule, (EqualTo, LessThanOrEqual, LessThan)):
                self.until(rule.value, int(isinstance(rule, LessThan)))
            return isinstance(rule, (EqualTo, GreaterThanOrEqual, GreaterThan, LessThanOrEqual, LessThan))
        else:
            return False
        return True

    def may_hold(self, bars: Bars) -> bool:
        return (self.tickers is None or bars.ticker in self.tickers) and self.first.year <= bars.year <= self.last.year


class OhlcvReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, wanted: Wanted) -> None:
        self.folder, self.columns, self.wanted = folder, schema.fieldNames(), wanted

    def partitions(self) -> list[Files]:
        out, size = [Files()], 0
        for bars in filter(self.wanted.may_hold, listed(self.folder)):
            if out[-1].bars and size + bars.size > TASK_BYTES:
                out.append(Files())
                size = 0
            out[-1].bars.append(bars)
            size += bars.size
        if not out[-1].bars:
            raise ValueError(NO_DATA)
        return out

    def read(self, partition: Files) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds

        system, _ = file_system(self.folder)
        span = (ds.field("date") >= pa.scalar(self.wanted.first, pa.date32())) & (ds.field("date") <= pa.scalar(self.wanted.last, pa.date32()))
        stored = [c for c in self.columns if c != "ticker"]
        for bars in partition.bars:
            for batch in ds.dataset(bars.path, filesystem=system, format="parquet").to_batches(columns=stored, filter=span):
                if len(batch):
                    tickers = pa.array([bars.ticker] * len(batch), pa.string())
                    yield pa.RecordBatch.from_arrays([tickers if c == "ticker" else batch.column(c) for c in self.columns], self.columns)


class PushingReader(OhlcvReader):
    """A reader that Spark hands the filters above it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for rule in filters:
            if not self.wanted.take(rule):
                yield rule


class OhlcvSource(DataSource):
    """Format "ohlcv": (date, ticker, measures) of a store."""

    @classmethod
    def name(cls) -> str:
        return "ohlcv"

    def schema(self) -> str:
        import pyarrow.parquet as pq

        found = listed(self.options["path"])
        if not found:
            raise ValueError(NO_DATA)
        system, _ = file_system(self.options["path"])
        with system.open_input_file(found[0].path) as file:
            there = pq.read_schema(file).names
        return "date date, ticker string, " + ", ".join(f"{c} double" for c in MEASURES if c in there)

    def reader(self, schema: StructType) -> OhlcvReader:
        wanted, get = Wanted(), self.options.get
        if get("tickers") is not None:
            wanted.only([unquote(t) for t in get("tickers").split(",")])
        if get("start") is not None:
            wanted.since(dt.date.fromisoformat(get("start")))
        if get("end") is not None:
            wanted.until(dt.date.fromisoformat(get("end")), 1)
        kind = PushingReader if get("pushdown") == "true" else OhlcvReader
        return kind(self.options["path"], schema, wanted)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, once."""
    try:
        spark.dataSource.register(OhlcvSource)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def read_store(spark: SparkSession, folder: str, tickers: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a store, of the tickers from start up to end (excluded). The scan is refused where no file can hold any. Filters are pushed down where the session allows that."""
    register(spark)
    given = {"pushdown": spark.conf.get(PUSHDOWN), "tickers": None if tickers is None else ",".join(quote(t, safe="") for t in tickers), "start": start, "end": end}
    return spark.read.format("ohlcv").options(**{k: v for k, v in given.items() if v is not None}).load(folder)
