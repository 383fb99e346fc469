"""Technical features of a stream of bars, one ticker's state at a time.

A ticker's state is a ring of its last rows, as many as the widest window needs, its exponential means, and the rows that wait for the watermark.
Rows are worked off in order of time once the watermark has passed them, so those that come late, but within the allowed delay, are in their place;
later ones are left out, as by every watermark. State is in the query's checkpoint: a restart goes on where it stopped.

The session's state store has to be RocksDB's (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketloom.sources.scratch import scratch_path

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def feature_columns(windows: Sequence[int], spans: Sequence[int]) -> list[str]:
    return ["ret", *sorted(f"{kind}_{w}" for w in windows for kind in ("sma", "momentum", "volatility")), *(f"EMA_{s}" for s in spans)]


def none_of(x: float) -> float | None:
    return None if math.isnan(x) else float(x)


class FeatureState(StatefulProcessor):
    """Works off a ticker's bars in order of time. Missing prices are rows of the windows, and values of none of them."""

    def __init__(self, windows: Sequence[int], spans: Sequence[int]) -> None:
        self.windows, self.spans, self.keep = list(windows), list(spans), max(windows)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "prices array<double>, rets array<double>")
        self.means = handle.getValueState("means", "ema array<double>")
        self.waiting = handle.getListState("waiting", "ms long, price double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            ms = frame["ts"].astype("datetime64[ms]").astype("int64")
            self.waiting.appendList([(int(t), none_of(float("nan") if p is None else p)) for t, p in zip(ms, frame["price"].astype(float), strict=True)])
        yield from self.work_off(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.work_off(key, timerValues)

    def work_off(self, key: tuple, timers) -> Iterator[pd.DataFrame]:
        """Rows that the watermark has passed; a timer is set for the first of the others."""
        mark = timers.getCurrentWatermarkInMs()
        rows = sorted(((int(r[0]), r[1]) for r in self.waiting.get()), key=lambda r: r[0])
        ready, rest = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            yield self.features(key, ready)
        if rest:
            self.handle.registerTimer(rest[0][0])

    def features(self, key: tuple, rows: list[tuple[int, float | None]]) -> pd.DataFrame:
        ring = self.ring.get() if self.ring.exists() else ([], [])
        prices, rets = ([float("nan") if x is None else x for x in side] for side in ring)
        means = list(self.means.get()[0]) if self.means.exists() else [None] * len(self.spans)
        out = []
        for ms, price in rows:
            p = float("nan") if price is None else price
            before = prices[-1] if prices else float("nan")
            prices.append(p)
            rets.append(math.log(p) - math.log(before) if p > 0 and before > 0 else float("nan"))
            found = {"ret": rets[-1]}
            for w in self.windows:
                least = max(1, w // 2)
                held, moved = np.array(prices[-w:]), np.array(rets[-w:])
                held, moved = held[~np.isnan(held)], moved[~np.isnan(moved)]
                found[f"sma_{w}"] = held.mean() if len(held) >= least else float("nan")
                found[f"volatility_{w}"] = moved.std(ddof=1) if len(moved) >= max(2, least) else float("nan")
                found[f"momentum_{w}"] = p / prices[-1 - w] - 1 if len(prices) > w and prices[-1 - w] != 0 else float("nan")
            for k, span in enumerate(self.spans):
                if price is not None:
                    a = 2.0 / (span + 1)
                    means[k] = p if means[k] is None else a * p + (1 - a) * means[k]
                found[f"EMA_{span}"] = float("nan") if means[k] is None else means[k]
            out.append((pd.Timestamp(ms, unit="ms"), key[0], price, *(none_of(found[c]) for c in feature_columns(self.windows, self.spans))))
            del prices[: -self.keep - 1], rets[: -self.keep - 1]
        self.ring.update(([none_of(x) for x in prices], [none_of(x) for x in rets]))
        self.means.update((means,))
        names = ["ts", "ticker", "price", *feature_columns(self.windows, self.spans)]
        return pd.DataFrame({name: pd.Series([r[k] for r in out], dtype=None if k < 2 else "float64") for k, name in enumerate(names)})

    def close(self) -> None:
        pass


def stream_features(bars: DataFrame, windows: Sequence[int] = (5, 20, 60), spans: Sequence[int] = (12, 26), late: str = "1 day") -> DataFrame:
    """(ts, ticker, price, ret, momentum_w, sma_w, volatility_w ..., EMA_s ...) of a stream (ts, ticker, price), a row a bar, once the watermark is past it.

    Values are those of features.technical_features on log returns, and of scan.ema, over all bars that weren't too late.
    """
    schema = "ts timestamp, ticker string, price double, " + ", ".join(f"`{c}` double" for c in feature_columns(windows, spans))
    given = bars.select("ts", "ticker", F.col("price").cast("double").alias("price")).withWatermark("ts", late)
    return given.groupBy("ticker").transformWithStateInPandas(FeatureState(windows, spans), schema, "Append", "EventTime")


def run_to_table(spark: SparkSession, source: str, target: str, checkpoint: str, late: str = "1 day", windows: Sequence[int] = (5, 20, 60), spans: Sequence[int] = (12, 26)) -> None:
    """Works off what is new in a folder of Parquet bars since the last run with this checkpoint, and appends the features to the target."""
    bars = spark.readStream.schema("ts timestamp, ticker string, price double").option("maxFilesPerTrigger", 8).parquet(source)
    run = stream_features(bars, windows, spans, late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    run.trigger(availableNow=True).start().awaitTermination()


def replay(bars: DataFrame, parts: int = 3, late: str = "1 day", windows: Sequence[int] = (5, 20, 60), spans: Sequence[int] = (12, 26)) -> DataFrame:
    """Features of bars (ts, ticker, price) by the streaming query: they arrive in so many parts by time, and the query starts anew, from its checkpoint, for each."""
    spark = bars.sparkSession.newSession()  # with a state store of its own choice
    spark.conf.set(*STATE_STORE)
    source, target, checkpoint = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    span = bars.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    if span["a"] is not None:
        step = (span["z"] - span["a"]) / parts
        for k in range(parts):
            part = bars.where((F.col("ts") >= F.lit(span["a"] + k * step)) & (F.col("ts") < F.lit(span["a"] + (k + 1) * step) if k < parts - 1 else F.lit(True)))
            part = part.select("ts", "ticker", F.col("price").cast("double").alias("price"))
            if k == parts - 1:  # a last bar, of no ticker, lets the watermark pass all others
                end = part.limit(0).unionByName(bars.sparkSession.range(1).select((F.lit(span["z"]) + F.expr("interval 3650 days")).alias("ts"), F.lit("").alias("ticker"), F.lit(None).cast("double").alias("price")))
                part = part.unionByName(end)
            part.write.mode("append").parquet(source)
            run_to_table(spark, source, target, checkpoint, late, windows, spans)
    schema = "ts timestamp, ticker string, price double, " + ", ".join(f"`{c}` double" for c in feature_columns(windows, spans))
    out = bars.sparkSession.read.schema(schema)
    return (out.parquet(target) if span["a"] is not None else bars.sparkSession.createDataFrame([], schema)).where("ticker <> ''")
