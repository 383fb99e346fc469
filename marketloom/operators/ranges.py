"""Order statistics of tickers of any size: rows are sorted by range partitions, and only the ranges' counts are summed up to place them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.sources.scratch import materialise

#: Rows of a stretch whose neighbours are compared by one task.
STRETCH = 4096


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows, written in order, with __pos, the 0-based place within the ticker by `order`, and __total, the ticker's rows; equal rows in any order.

    Ranges are cut by ticker and order, so a ticker's rows are in as many tasks as they fill.
    """
    sides = [F.col(c).asc_nulls_first() for c in ("ticker", *order, "__tie")]
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*sides).sortWithinPartitions(*sides).drop("__tie")
    held = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "placed")
    held = held.withColumns({"__part": F.shiftrightunsigned("__at", 33), "__at": F.col("__at").bitwiseAND(2**33 - 1)})
    counts = held.groupBy("ticker", "__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))  # a row for each range and ticker that meet
    earlier = Window.partitionBy("ticker").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("ticker").alias("__of"), F.col("__part").alias("__in"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("__start"), F.sum("n").over(Window.partitionBy("ticker")).alias("__total"))
    both = held.join(starts, F.col("ticker").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__in")))
    return both.withColumn("__pos", F.col("__start") + F.col("__at")).drop("__start", "__at", "__part", "__of", "__in")


def exact_quantiles(rows: DataFrame, column: str, percentiles: Sequence[float]) -> DataFrame:
    """(ticker, quantiles): the percentiles of the known values, interpolated between neighbours, as an array. Of each ticker only the values at the wanted places are gathered."""
    at = placed(rows.where(F.col(column).isNotNull()).select("ticker", F.col(column).alias("__v")), ["__v"])
    place = [(F.col("__total") - 1) * float(p) for p in percentiles]
    ends = [(F.floor(x), F.ceil(x)) for x in place]
    wanted = at.where(F.array_contains(F.array(*(e for pair in ends for e in pair)), F.col("__pos")))
    value = lambda rank: F.max(F.when(F.col("__pos") == rank, F.col("__v")))
    found = wanted.groupBy("ticker", "__total").agg(*(value(rank).alias(f"__{side}{k}") for k, pair in enumerate(ends) for side, rank in zip("lh", pair, strict=True)))
    between = [F.col(f"__l{k}") + (F.col(f"__h{k}") - F.col(f"__l{k}")) * (x - F.floor(x)) for k, x in enumerate(place)]
    return found.select("ticker", F.array(*between).alias("quantiles"))


def in_stretches(panel: DataFrame, reach: int, compute: Callable[[DataFrame, WindowSpec], DataFrame], stretch: int = STRETCH) -> DataFrame:
    """What compute(rows, window) gives for a panel (date, ticker, ...), where it looks at most `reach` rows back in the window's order.

    A ticker's rows are cut into stretches; each has a copy of the last `reach` rows before it, which are left out of the result. So rolling windows of a ticker are as many
    tasks as it has stretches, and equal those over all of its rows. compute keeps the columns date and ticker.
    """
    if not 0 < reach <= stretch:
        raise ValueError("reach must be positive and no longer than a stretch")
    at = placed(panel, ["date"])
    own = F.floor(F.col("__pos") / stretch)
    copies = F.when(F.col("__pos") % stretch >= stretch - reach, F.array(F.struct(own.alias("__stretch"), F.lit(False).alias("__copy")), F.struct((own + 1).alias("__stretch"), F.lit(True).alias("__copy"))))
    dealt = at.select(*panel.columns, "__pos", F.inline(F.coalesce(copies, F.array(F.struct(own.alias("__stretch"), F.lit(False).alias("__copy"))))))
    # The computed rows know their stretch and whether they are copies by columns that travel as the ticker's and date's.
    keyed = dealt.withColumn("ticker", F.struct("ticker", "__stretch", "__copy", "__pos"))
    found = compute(keyed.drop("__stretch", "__copy", "__pos"), Window.partitionBy("ticker.ticker", "ticker.__stretch").orderBy("ticker.__pos"))
    return found.where(~F.col("ticker.__copy")).withColumn("ticker", F.col("ticker.ticker"))


def order_report(panel: DataFrame, order: str) -> DataFrame:
    """One row: n_rows, n_duplicates (rows that repeat a date of their ticker), n_backward (rows earlier than the one before them by `order`).

    Neighbours are compared in stretches of STRETCH rows, and stretches by their ends, so no task has a ticker.
    """
    at = placed(panel.select("ticker", "date", order), [order])
    stretches = at.withColumn("__stretch", F.floor(F.col("__pos") / STRETCH))
    inside = stretches.withColumn("__back", F.col("date") < F.lag("date").over(Window.partitionBy("ticker", "__stretch").orderBy("__pos")))
    ends = inside.groupBy("ticker", "__stretch").agg(F.count_if("__back").alias("back"), F.min_by("date", "__pos").alias("first"), F.max_by("date", "__pos").alias("last"))
    before = ends.select(F.col("ticker").alias("__of"), (F.col("__stretch") + 1).alias("__next"), F.col("last").alias("__last"))
    met = ends.join(before, F.col("ticker").eqNullSafe(F.col("__of")) & (F.col("__stretch") == F.col("__next")), "left")
    back = met.agg((F.coalesce(F.sum("back"), F.lit(0)) + F.count_if(F.col("first") < F.col("__last"))).alias("n_backward"))
    twice = at.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
    return twice.crossJoin(F.broadcast(back))  # a row each
