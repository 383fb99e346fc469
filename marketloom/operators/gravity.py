"""The gravity signal: masses, rolling correlation distances, forces between tickers, net force by momentum; its information coefficient.

A date's matrices are edges (date, i, j) with i < j; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expressions import EPS, average_rank, by_date, by_ticker, clip, correlation, divide, lagged_change, log_of, quantise, rolling, zscore
from marketloom.operators.explore import ticker_pairs
from marketloom.operators.features import returns, with_returns

MIN_MASS = 1e-8


@dataclass(frozen=True)
class GravityParams:
    mass_method: str = "dollar_volume"
    mass_window: int = 20
    dist_window: int = 60
    dist_min_periods: int = 30
    momentum_lookback: int = 20
    momentum_kind: str = "log"
    g: float = 1.0
    eps: float = 1e-6
    force_cap: float | None = None
    zscore_signals: bool = True


def masses(panel: DataFrame, method: str = "dollar_volume", window: int = 20, least: float = MIN_MASS) -> DataFrame:
    """(date, ticker, mass): the column market_cap, or the rolling mean of price * volume; missing and small ones are `least`."""
    return panel.select("date", "ticker", mass_column(panel.columns, method, window, least).alias("mass"))


def mass_column(columns: Sequence[str], method: str, window: int, least: float = MIN_MASS) -> Column:
    """The mass of `masses`, of a panel with these columns."""
    if method not in ("market_cap", "dollar_volume"):
        raise ValueError("method must be 'market_cap' or 'dollar_volume'")
    if method == "market_cap" and "market_cap" not in columns:
        raise ValueError("market_caps must be provided when method='market_cap'")
    if method == "dollar_volume" and "volume" not in columns:
        raise ValueError("volume must be provided when method='dollar_volume'")
    raw = F.col("market_cap") if method == "market_cap" else rolling(F.avg, F.col("price") * F.col("volume"), window, max(2, window // 3))
    return F.greatest(F.coalesce(raw, F.lit(least)), F.lit(least))


def mass_as_of(mass: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, ticker, mass) for every one of the dates and each ticker: its last mass at or before, 0 before its first."""
    wanted = dates.select("date").distinct().crossJoin(mass.select("ticker").distinct()).withColumn("__asked", F.lit(True))  # the size of the result
    both = wanted.join(mass, ["date", "ticker"], "full")
    held = F.last("mass", ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("mass", F.coalesce(held, F.lit(0.0))).where("__asked").select("date", "ticker", "mass")


def momentum(panel: DataFrame, lookback: int = 20, kind: str = "log") -> DataFrame:
    """(date, ticker, mom): return over the lookback as z-score among the date's tickers."""
    return panel.withColumn("__raw", momentum_change(kind, lookback)).select("date", "ticker", zscore("__raw").alias("mom"))


def momentum_change(kind: str, lookback: int) -> Column:
    """Log or simple return over the lookback's rows."""
    if kind not in ("log", "simple"):
        raise ValueError("kind must be 'log' or 'simple'")
    return lagged_change("price", lookback) if kind == "simple" else log_of("price") - F.lag(log_of("price"), lookback).over(by_ticker())


def rolling_correlations(rets: DataFrame, window: int = 60, min_periods: int = 30) -> DataFrame:
    """(date, i, j, corr) over the trailing rows of a dense grid (date, ticker, ret), from the min_periods-th row on; NULL where unknown."""
    ordered = Window.partitionBy("i", "j").orderBy("date")
    pairs = ticker_pairs(rets, "ret").withColumns({"corr": correlation(F.col("x"), F.col("y"), ordered.rowsBetween(-(window - 1), 0)), "__row": F.row_number().over(ordered)})
    return pairs.where(F.col("__row") >= min_periods).select("date", "i", "j", "corr")


def distances(corrs: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Adds dist, sqrt(2 * (1 - corr)); an unknown correlation is distance 0."""
    return corrs.withColumn("dist", distance_of(F.col("corr"), eps))


def distance_of(corr: Column, eps: float = 1e-6) -> Column:
    dist = F.sqrt(2.0 * (1.0 - clip(corr, F.lit(-1 + eps), F.lit(1 - eps))))
    return F.greatest(F.coalesce(dist, F.lit(0.0)), F.lit(0.0))


def force_between(one: Column, other: Column, dist: Column, params: GravityParams) -> Column:
    """g * one * other / (dist^2 + eps), at most force_cap."""
    force = params.g * (one * other) / (F.pow(dist, F.lit(2.0)) + params.eps)
    return force if params.force_cap is None else F.least(F.greatest(force, F.lit(0.0)), F.lit(float(params.force_cap)))


def forces(dists: DataFrame, mass: DataFrame, g: float = 1.0, eps: float = 1e-6, cap: float | None = None) -> DataFrame:
    """(date, i, j, dist, force): g * m_i * m_j / (dist^2 + eps), at most cap. A ticker without a mass has the median of its date."""
    filled = mass.select("date", "ticker", F.coalesce("mass", F.median("mass").over(by_date())).alias("mass"))
    side = lambda k: filled.select("date", F.col("ticker").alias(k), F.col("mass").alias(f"m{k}"))
    joined = dists.join(side("i"), ["date", "i"]).join(side("j"), ["date", "j"])
    force = force_between(F.col("mi"), F.col("mj"), F.col("dist"), GravityParams(g=g, eps=eps, force_cap=cap))
    return joined.select("date", "i", "j", "dist", force.alias("force"))


def net_forces(force: DataFrame, mom: DataFrame, normalise: bool = False) -> DataFrame:
    """(date, ticker, net): sum over the others of force * sign(their momentum), missing momentum being 0; as z-score of the date if asked."""
    sign = F.signum(F.coalesce("mom", F.lit(0.0)))
    both = force.select("date", F.col("i").alias("ticker"), F.col("j").alias("other"), "force").unionByName(force.select("date", F.col("j").alias("ticker"), F.col("i").alias("other"), "force"))
    pulled = both.join(mom.select("date", F.col("ticker").alias("other"), "mom"), ["date", "other"], "left")
    net = pulled.groupBy("date", "ticker").agg(F.sum(F.col("force") * sign).alias("net"))
    return net.withColumn("net", zscore("net", null_spread=False)) if normalise else net


def gravity_signals(panel: DataFrame, params: GravityParams = GravityParams(), rets: DataFrame | None = None) -> DataFrame:
    """(date, ticker, signal) of a dense panel (date, ticker, price, volume); NULL before the distances are known."""
    rets = returns(panel, "log") if rets is None else rets
    dist = distances(rolling_correlations(rets, params.dist_window, params.dist_min_periods), params.eps)
    force = forces(dist, masses(panel, params.mass_method, params.mass_window), params.g, params.eps, params.force_cap)
    net = net_forces(force, momentum(panel, params.momentum_lookback, params.momentum_kind))
    whole = panel.select("date", "ticker").join(net, ["date", "ticker"], "left")
    return whole.select("date", "ticker", (zscore("net") if params.zscore_signals else F.col("net")).alias("signal"))


def information_coefficient(signals: DataFrame, fwd: DataFrame, method: str = "spearman") -> DataFrame:
    """(date, ic), or (date, horizon, ic) if fwd has horizons: correlation of signal and forward return over a date's tickers.

    Only tickers with both count, three at least; dates without a correlation are left out.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError("method must be 'spearman' or 'pearson'")
    keys = ["date", "horizon"] if "horizon" in fwd.columns else ["date"]
    pairs = signals.join(fwd, ["date", "ticker"]).where("signal is not null and fwd is not null")
    if method == "spearman":
        pairs = pairs.withColumns({"signal": average_rank("signal", *keys), "fwd": average_rank("fwd", *keys)})
    found = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), correlation(F.col("signal"), F.col("fwd")).alias("ic"))
    return found.where("__n >= 3 and ic is not null").drop("__n")


def mean_ic(ic: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(horizon, pos, mean_ic) of every horizon in its place; NULL where no date has an IC."""
    spark = ic.sparkSession
    places = spark.createDataFrame([(k, pos) for pos, k in enumerate(horizons)], "horizon int, pos int")
    return places.join(ic.groupBy("horizon").agg(F.avg("ic").alias("mean_ic")), "horizon", "left")


def best_of(table: DataFrame, value: str, *place: str) -> DataFrame:
    """The row with the largest absolute value, the first by place among equals; unknown values come last."""
    return table.orderBy(F.abs(F.col(value)).desc_nulls_last(), *place).limit(1)


def _sweep_sides(panel: DataFrame, configs: Sequence[GravityParams]) -> tuple[DataFrame, list[str], list[str]]:
    """(date, ticker, ret, mass_k, mom_k ...): every distinct mass and momentum of the configurations once, and the column of each configuration."""
    sides, mass_of, mom_of = panel, {}, {}
    for p in configs:
        key = (p.mass_method, p.mass_window)
        if key not in mass_of:
            mass_of[key] = f"mass_{len(mass_of)}"
            sides = sides.withColumn(mass_of[key], mass_column(panel.columns, *key))
    for p in configs:
        key = (p.momentum_kind, p.momentum_lookback)
        if key not in mom_of:
            mom_of[key] = f"mom_{len(mom_of)}"
            sides = sides.withColumn(mom_of[key], momentum_change(*key))
    sides = sides.withColumns({name: zscore(name) for name in mom_of.values()}).select("date", "ticker", "ret", *mass_of.values(), *mom_of.values())
    return sides, [mass_of[p.mass_method, p.mass_window] for p in configs], [mom_of[p.momentum_kind, p.momentum_lookback] for p in configs]


def sweep_signals(panel: DataFrame, configs: Sequence[GravityParams]) -> DataFrame:
    """(config, date, ticker, signal) of every configuration, in one chain: pairs are built once with all masses and momenta, correlated over all windows
    by one sort, and unfolded to configurations when forces are summed up. panel (date, ticker, price, volume, ret) is dense. Dates without distances have no rows."""
    sides, mass, mom = _sweep_sides(panel, configs)
    named = lambda k: sides.select("date", *(F.col(c).alias(f"{c}_{k}") for c in sides.columns if c != "date"))
    pairs = named("i").join(named("j"), "date").where("ticker_i < ticker_j")
    ordered = Window.partitionBy("ticker_i", "ticker_j").orderBy("date")
    corr = {w: correlation(F.col("ret_i"), F.col("ret_j"), ordered.rowsBetween(-(w - 1), 0)) for w in {p.dist_window for p in configs}}
    pairs = pairs.withColumns({"row": F.row_number().over(ordered), **{f"corr_{w}": c for w, c in corr.items()}})
    pulls = []
    for k, p in enumerate(configs):
        force = force_between(F.col(f"{mass[k]}_i"), F.col(f"{mass[k]}_j"), distance_of(F.col(f"corr_{p.dist_window}"), p.eps), p)
        force = F.when(F.col("row") >= p.dist_min_periods, force)
        sign = lambda side, k=k: F.signum(F.coalesce(F.col(f"{mom[k]}_{side}"), F.lit(0.0)))
        pulls += [F.struct(F.lit(k).alias("config"), F.col(f"ticker_{own}").alias("ticker"), (force * sign(other)).alias("pull")) for own, other in ("ij", "ji")]
    each = pairs.select("date", F.explode(F.array(*pulls)).alias("p")).where("p.pull is not null")
    net = each.groupBy("p.config", "date", "p.ticker").agg(F.sum("p.pull").alias("net"))
    over = Window.partitionBy("config", "date")
    scaled = (F.col("net") - F.avg("net").over(over)) / (F.nullif(F.stddev_samp("net").over(over), F.lit(0.0)) + EPS)
    plain = [k for k, p in enumerate(configs) if not p.zscore_signals]
    return net.select("config", "date", "ticker", (F.when(F.col("config").isin(plain), F.col("net")).otherwise(scaled) if plain else scaled).alias("signal"))


def config_sweep(panel: DataFrame, configs: Sequence[GravityParams], horizons: Sequence[int], rets: DataFrame | None = None, places: int | None = None) -> DataFrame:
    """(config, horizon, pos, mean_ic) of every configuration and horizon; with `places`, signals and returns are ranked as rounded to so many.

    Returns are the panel's ret, or those of `rets` (date, ticker, ret) if it has none. All configurations and horizons are ranked by one exchange.
    """
    exact = (lambda x: x) if places is None else (lambda x: quantise(x, places))
    if rets is not None:
        panel = panel.drop("ret").join(rets, ["date", "ticker"], "left")
    elif "ret" not in panel.columns:
        panel = with_returns(panel, "log")
    found = sweep_signals(panel, configs).select("config", "date", "ticker", exact(F.col("signal")).alias("signal")).where("signal is not null")
    ahead = [F.struct(F.lit(k).alias("horizon"), exact(divide(F.lead("price", k).over(by_ticker()), F.col("price")) - 1).alias("fwd")) for k in horizons]
    fwd = panel.select("date", "ticker", F.array(*ahead).alias("ahead"))
    rows = found.join(fwd, ["date", "ticker"]).select("config", "date", "signal", F.inline("ahead")).where("fwd is not null")
    keys = ["config", "horizon", "date"]
    ranked = rows.withColumns({"signal": average_rank("signal", *keys), "fwd": average_rank("fwd", *keys)})
    ic = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("signal"), F.col("fwd")).alias("ic")).where("n >= 3 and ic is not null")
    means = ic.groupBy("config", "horizon").agg(F.avg("ic").alias("mean_ic"))
    places_of = panel.sparkSession.createDataFrame([(c, k, pos) for c in range(len(configs)) for pos, k in enumerate(horizons)], "config int, horizon int, pos int")
    return places_of.join(means, ["config", "horizon"], "left").select("config", "horizon", "pos", "mean_ic")


def rolling_ic(ic: DataFrame, window: int = 30) -> DataFrame:
    """(date, ic, ic_rolling) over the last so many dates that have an IC. A row a date goes through one task."""
    return ic.withColumn("ic_rolling", rolling(F.avg, "ic", window, window, Window.orderBy("date")))
