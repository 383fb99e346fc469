"""Scans along a ticker's dates in which no task has a whole ticker.

Dates are cut into blocks. A block is scanned by itself, its last state is its summary; summaries are scanned in the same way, in blocks of
blocks, and the state before a block is carried into its rows. A ticker's rows so spread over as many tasks as it has
blocks; what comes together by ticker is a row for each BLOCK_DAYS ** 2 days. Any associative way of
combining states will do: linear recurrences (exponential means), the last known value, running peaks and falls.

Rows need a ticker and a date; a date of a ticker is there once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expressions import canonical, divide, log_of

#: Days of a block, and blocks of a block of blocks.
BLOCK_DAYS = 64
#: Doublings that reach over all blocks of blocks that dates have room for.
LAST_STEPS = 10

State = dict[str, Column]
Combine = Callable[[State, State], State]


def _scanned(rows: DataFrame, names: Sequence[str], keys: Sequence[str], order: str, combine: Combine, identity: dict[str, object], steps: int) -> DataFrame:
    """Each row's state combined with all before it in its group, by doubling: after k steps it reaches 2 ** k rows back."""
    window = Window.partitionBy(*keys).orderBy(order)
    for k in range(steps):
        rows = rows.withColumns({f"__e_{n}": F.lag(n, 1 << k, identity[n]).over(window) for n in names})
        rows = rows.withColumns(combine({n: F.col(f"__e_{n}") for n in names}, {n: F.col(n) for n in names})).drop(*(f"__e_{n}" for n in names))
    return rows


def block_scan(panel: DataFrame, state: State, combine: Combine, identity: dict[str, object], block_days: int = BLOCK_DAYS, before: bool = False) -> DataFrame:
    """The panel with a column for each name of `state`: the states of all rows of the ticker up to this one, combined in order of date.

    combine(earlier, later) is associative, `identity` (plain values) its neutral state. With `before`, columns before_<name> have the state without the row itself.
    """
    names, steps = list(state), max(1, (block_days - 1).bit_length())
    days = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))
    rows = panel.withColumns({**state, "__block": F.floor(days / block_days).cast("long"), "__above": F.floor(days / block_days**2).cast("long")})
    cols = lambda prefix="": {n: F.col(f"{prefix}{n}") for n in names}
    summary = lambda order: F.max_by(F.struct(*names), order).alias("__s")
    earlier = lambda keys, order: {f"__c_{n}": F.lag(n, 1, identity[n]).over(Window.partitionBy(*keys).orderBy(order)) for n in names}

    local = _scanned(rows, names, ["ticker", "__block"], "date", combine, identity, steps)
    blocks = local.groupBy("ticker", "__above", "__block").agg(summary("date")).select("ticker", "__above", "__block", "__s.*")
    blocks = _scanned(blocks, names, ["ticker", "__above"], "__block", combine, identity, steps)
    above = blocks.groupBy("ticker", "__above").agg(summary("__block")).select("ticker", "__above", "__s.*")
    above = _scanned(above, names, ["ticker"], "__above", combine, identity, LAST_STEPS)
    carried = above.withColumns(earlier(["ticker"], "__above")).select("ticker", "__above", *(F.col(f"__c_{n}").alias(f"__a_{n}") for n in names))
    blocks = blocks.withColumns(earlier(["ticker", "__above"], "__block")).join(carried, ["ticker", "__above"])
    starts = combine(cols("__a_"), cols("__c_"))
    starts = blocks.select("ticker", "__block", *(starts[n].alias(f"__b_{n}") for n in names))
    if before:
        local = local.withColumns(earlier(["ticker", "__block"], "date"))
    out = local.join(starts, ["ticker", "__block"])
    found = combine(cols("__b_"), cols())
    found |= {f"before_{n}": c for n, c in combine(cols("__b_"), cols("__c_")).items()} if before else {}
    kept = [c for c in panel.columns if c not in found]
    return out.select(*(F.col(f"`{c}`") for c in kept), *(c.alias(n) for n, c in found.items()))


def ema(panel: DataFrame, column: str, spans: Sequence[int], prefix: str = "EMA", block_days: int = BLOCK_DAYS) -> DataFrame:
    """Adds <prefix>_<span>: the exponential mean with factor 2 / (span + 1) that starts at the first known value. Rows without a value keep the mean as it is; before the first it is NULL."""
    value = canonical(column)
    state: State = {"__first": value}
    identity: dict[str, object] = {"__first": None}
    for span in spans:
        a = 2.0 / (span + 1)
        state |= {f"__f{span}": F.when(value.isNotNull(), F.lit(1.0 - a)).otherwise(F.lit(1.0)), f"__s{span}": F.coalesce(a * value, F.lit(0.0))}
        identity |= {f"__f{span}": 1.0, f"__s{span}": 0.0}

    def combine(e: State, x: State) -> State:
        out = {"__first": F.coalesce(e["__first"], x["__first"])}
        for span in spans:
            f, s = f"__f{span}", f"__s{span}"
            out |= {f: e[f] * x[f], s: x[s] + x[f] * e[s]}
        return out

    found = block_scan(panel, state, combine, identity, block_days)
    return found.withColumns({f"{prefix}_{span}": F.col(f"__f{span}") * F.col("__first") + F.col(f"__s{span}") for span in spans}).drop(*state)


def macd(panel: DataFrame, column: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Adds macd (fast less slow exponential mean), macd_signal (its own exponential mean) and macd_hist (their difference)."""
    both = ema(panel, column, [fast, slow], "__ema", block_days)
    both = both.withColumn("macd", F.col(f"__ema_{fast}") - F.col(f"__ema_{slow}")).drop(f"__ema_{fast}", f"__ema_{slow}")
    both = ema(both, "macd", [signal], "__signal", block_days).withColumnRenamed(f"__signal_{signal}", "macd_signal")
    return both.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def carry(grid: DataFrame, column: str, limit: int | None = None, block_days: int = BLOCK_DAYS, before: bool = False) -> DataFrame:
    """Adds __held: the last known value of the column, from at most `limit` rows back; with `before`, __held_before, the same for the row before."""
    value = F.col(column)
    state: State = {"__n": F.lit(1).cast("long"), "__v": value, "__since": F.lit(0).cast("long")}

    def combine(e: State, x: State) -> State:
        return {"__n": e["__n"] + x["__n"], "__v": F.coalesce(x["__v"], e["__v"]), "__since": F.when(x["__v"].isNotNull(), x["__since"]).otherwise(e["__since"] + x["__n"])}

    found = block_scan(grid, state, combine, {"__n": 0, "__v": None, "__since": 0}, block_days, before)
    near = lambda p: F.col(f"{p}__v") if limit is None else F.when(F.col(f"{p}__since") <= limit, F.col(f"{p}__v"))
    names = {"__held": near(""), **({"__held_before": near("before_")} if before else {})}
    return found.withColumns(names).drop(*state, *(f"before_{n}" for n in state))


def fill_forward(grid: DataFrame, column: str, limit: int | None = None, block_days: int = BLOCK_DAYS) -> DataFrame:
    """The column with gaps of at most `limit` rows (all, if None) filled by the last value before."""
    return carry(grid, column, limit, block_days).withColumn(column, F.col("__held")).drop("__held")


def simple_returns(grid: DataFrame, column: str = "price", block_days: int = BLOCK_DAYS) -> DataFrame:
    """Adds ret: change of the last known value to the one that was known a row before."""
    held = carry(grid, column, None, block_days, before=True)
    return held.withColumn("ret", divide(F.col("__held"), F.col("__held_before")) - 1).drop("__held", "__held_before")


FALLS: dict[str, object] = {"__peak": None, "__low": None, "__fall": None}


def _fall(e: State, x: State) -> State:
    """Peak, low and worst fall (least low / earlier peak - 1) of two stretches that follow each other. NULLs don't count."""
    across = divide(x["__low"], e["__peak"]) - 1
    return {"__peak": F.greatest(e["__peak"], x["__peak"]), "__low": F.least(e["__low"], x["__low"]), "__fall": F.least(e["__fall"], x["__fall"], across)}


def drawdowns(panel: DataFrame, column: str = "price", block_days: int = BLOCK_DAYS) -> DataFrame:
    """Adds peak (the highest value so far), drawdown (value / peak - 1) and max_drawdown (the worst so far). Values must be positive; rows without one keep peak and worst."""
    value = F.when(canonical(column) > 0, canonical(column))
    state: State = {"__peak": value, "__low": value, "__fall": F.when(value.isNotNull(), F.lit(0.0))}
    found = block_scan(panel, state, _fall, FALLS, block_days)
    return found.withColumns({"peak": F.col("__peak"), "drawdown": divide(F.when(F.col(column) > 0, F.col(column)), F.col("__peak")) - 1, "max_drawdown": F.col("__fall")}).drop(*state)


def risk_stats(panel: DataFrame, column: str = "price", periods: int = 252, block_days: int = BLOCK_DAYS) -> DataFrame:
    """One row a ticker: max_drawdown, and sharpe: mean by standard deviation of log returns between known values, a year of `periods` rows; NULL without spread.

    Falls and sums of returns are merged from blocks, so a ticker's rows meet in no task.
    """
    known = panel.where(canonical(column) > 0).select("date", "ticker", canonical(column).alias("v"))
    state: State = {"__peak": F.col("v"), "__low": F.col("v"), "__fall": F.lit(0.0), "__log": log_of("v")}

    def combine(e: State, x: State) -> State:
        return _fall(e, x) | {"__log": F.coalesce(x["__log"], e["__log"])}

    found = block_scan(known, state, combine, FALLS | {"__log": None}, block_days, before=True)
    ret = F.col("__log") - F.col("before___log")
    sums = found.groupBy("ticker").agg(F.min("__fall").alias("max_drawdown"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("s"))
    return sums.select("ticker", "max_drawdown", (divide(F.col("m"), F.nullif(F.col("s"), F.lit(0.0))) * F.sqrt(F.lit(float(periods)))).alias("sharpe"))
