"""The gravity chain against a NumPy loop over dates, written from the formulas."""

import numpy as np
import pandas as pd
import pytest
from helpers import close, column, panel

from marketloom.operators import features, gravity

N, T = 5, 90


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(7)
    prices = np.exp(rng.normal(0, 0.02, (T, N)).cumsum(axis=0)) * 100
    return prices, rng.uniform(1e5, 1e6, (T, N))


@pytest.fixture(scope="module")
def rows(spark, walk):
    names = list("ABCDE")
    prices, volume = walk
    return panel(spark, {t: list(prices[:, k]) for k, t in enumerate(names)}, None, volume={t: list(volume[:, k]) for k, t in enumerate(names)}).cache()


def expected_signals(prices, volume, window=60, least=30, mass_window=20, lookback=20, cap=None):
    ret = np.vstack([np.full(N, np.nan), np.diff(np.log(prices), axis=0)])
    mass = pd.DataFrame(prices * volume).rolling(mass_window, min_periods=max(2, mass_window // 3)).mean().fillna(1e-8).clip(lower=1e-8).to_numpy()
    out = np.full((T, N), np.nan)
    for t in range(least - 1, T):
        part = ret[max(0, t - window + 1) : t + 1]
        corr = np.corrcoef(part[~np.isnan(part).any(axis=1)].T)
        dist = np.sqrt(2 * (1 - np.clip(corr, -1 + 1e-6, 1 - 1e-6)))
        force = np.outer(mass[t], mass[t]) / (dist**2 + 1e-6)
        np.fill_diagonal(force, 0)
        if cap is not None:
            force = np.clip(force, 0, cap)
        mom = np.zeros(N)
        if t >= lookback:
            mom = np.log(prices[t] / prices[t - lookback])
            mom = (mom - mom.mean()) / (mom.std(ddof=1) + 1e-12)
        net = force @ np.sign(mom)
        spread = net.std(ddof=1)
        out[t] = (net - net.mean()) / (spread + 1e-12) if spread > 0 else np.nan
    return out


@pytest.mark.parametrize("cap", [None, 1e12])
def test_signals(rows, walk, cap):
    found = gravity.gravity_signals(rows, gravity.GravityParams(force_cap=cap))
    want = expected_signals(*walk, cap=cap)
    for k, t in enumerate("ABCDE"):
        assert close(column(found, "signal", t), [None if np.isnan(x) else x for x in want[:, k]], 1e-6)


def test_first_correlation_and_unknown_distance(spark, rows):
    corrs = gravity.rolling_correlations(features.returns(rows))
    assert corrs.select("date").distinct().count() == T - 29
    flat = panel(spark, {"A": [5.0] * 40, "B": list(np.linspace(1, 2, 40))})
    dist = gravity.distances(gravity.rolling_correlations(features.returns(flat)))
    assert dist.where("corr is null and dist = 0").count() == dist.count() == 11


def test_masses(spark, rows):
    floor = gravity.masses(panel(spark, {"A": [1, None, 3]}, None, volume={"A": [1, 1, 1]}), window=2)
    assert column(floor, "mass") == [1e-8, 1e-8, 1e-8]
    caps = panel(spark, {"A": [1, 2]}, None, market_cap={"A": [7, None]})
    assert column(gravity.masses(caps, "market_cap"), "mass") == [7, 1e-8]
    for method, words in (("market_cap", "market_caps"), ("equal", "method"), ("dollar_volume", "volume")):
        with pytest.raises(ValueError, match=words):
            gravity.masses(rows.drop("volume"), method)


def test_mass_as_of(spark):
    days = [r.date for r in panel(spark, {"A": [1] * 5}).orderBy("date").collect()]
    mass = spark.createDataFrame([(days[1], "A", 3.0), (days[3], "A", 4.0)], "date date, ticker string, mass double")
    found = gravity.mass_as_of(mass, spark.createDataFrame([(d,) for d in days], "date date"))
    assert column(found, "mass") == [0, 3, 3, 4, 4]


def test_missing_mass_is_the_median(spark):
    day = panel(spark, {"A": [1]}).first().date
    dist = spark.createDataFrame([(day, "A", "B", 1.0)], "date date, i string, j string, dist double")
    mass = spark.createDataFrame([(day, "A", 2.0), (day, "B", None), (day, "C", 4.0)], "date date, ticker string, mass double")
    assert gravity.forces(dist, mass).first().force == pytest.approx(2 * 3 / (1 + 1e-6))


def test_information_coefficient(spark):
    signal = panel(spark, {"A": [1, 1], "B": [2, 2], "C": [2, 3], "D": [4, None]}).withColumnRenamed("price", "signal")
    fwd = panel(spark, {"A": [1, 5], "B": [3, None], "C": [2, 1], "D": [4, 1]}).withColumnRenamed("price", "fwd")
    found = gravity.information_coefficient(signal, fwd).collect()
    want = np.corrcoef([1, 2.5, 2.5, 4], [1, 3, 2, 4])[0, 1]
    assert len(found) == 1 and found[0].ic == pytest.approx(want)  # the second date has two names only
    assert gravity.information_coefficient(signal, fwd, "pearson").first().ic == pytest.approx(np.corrcoef([1, 2, 2, 4], [1, 3, 2, 4])[0, 1])
    with pytest.raises(ValueError):
        gravity.information_coefficient(signal, fwd, "kendall")


def test_best_of_and_rolling(spark):
    table = spark.createDataFrame([(0, None), (1, -0.5), (2, 0.5), (3, 0.1)], "pos int, mean_ic double")
    assert gravity.best_of(table, "mean_ic", "pos").first().pos == 1
    ics = panel(spark, {"A": list(range(40))}).select("date", "ticker").withColumnRenamed("ticker", "t").selectExpr("date", "1.0D ic")
    assert sum(r.ic_rolling is not None for r in gravity.rolling_ic(ics).collect()) == 11


def test_random_walk_has_no_skill(spark):
    rng = np.random.default_rng(11)
    prices = np.exp(rng.normal(0, 0.01, (700, 5)).cumsum(axis=0)) * 100
    rows = panel(spark, {t: list(prices[:, k]) for k, t in enumerate("ABCDE")}, None, volume={t: [1e6] * 700 for t in "ABCDE"})
    found = gravity.information_coefficient(gravity.gravity_signals(rows), features.forward_returns(rows, [5]))
    assert abs(gravity.mean_ic(found, [5]).first().mean_ic) < 0.1


def test_sweep(rows):
    found = gravity.config_sweep(rows, [gravity.GravityParams(dist_window=30), gravity.GravityParams()], [1, 5])
    assert {(r.config, r.horizon) for r in found.collect()} == {(0, 1), (0, 5), (1, 1), (1, 5)}


def test_sweep_is_each_configuration_by_itself(spark):
    """One chain for all configurations gives what signals and coefficients of each give alone, whatever their parameters."""
    import random

    rng = random.Random(4)
    n = 90
    prices = {t: [None if rng.random() < 0.05 else 100 * rng.lognormvariate(0, 0.2) for _ in range(n)] for t in "ABCDE"}
    volumes = {t: [None if rng.random() < 0.05 else 1e4 * rng.random() for _ in range(n)] for t in prices}
    caps = {t: [rng.random() * 1e6 for _ in range(n)] for t in prices}
    rows = features.with_returns(panel(spark, prices, volume=volumes, market_cap=caps)).cache()
    P = gravity.GravityParams
    configs = [P(mass_window=5, dist_window=20, dist_min_periods=10, momentum_lookback=5), P(mass_window=9, dist_window=20, dist_min_periods=15, momentum_lookback=5, momentum_kind="simple", g=2.0, zscore_signals=False)]
    configs += [P(mass_method="market_cap", dist_window=30, dist_min_periods=20, momentum_lookback=9, eps=1e-3), P(mass_window=5, dist_window=30, dist_min_periods=20, momentum_lookback=9, force_cap=1e9)]
    horizons = [1, 4, 200]
    found = {(r.config, r.horizon): r for r in gravity.config_sweep(rows, configs, horizons).collect()}
    assert len(found) == len(configs) * len(horizons)
    fwd = features.forward_returns(rows, horizons)
    for k, params in enumerate(configs):
        signals = gravity.gravity_signals(rows, params, rows.select("date", "ticker", "ret"))
        for r in gravity.mean_ic(gravity.information_coefficient(signals, fwd), horizons).collect():
            got = found[k, r.horizon]
            assert got.pos == r.pos and (got.mean_ic is None) == (r.mean_ic is None) and (r.mean_ic is None or abs(got.mean_ic - r.mean_ic) < 1e-9)
    again = gravity.config_sweep(rows.drop("ret"), configs[:1], horizons, rows.select("date", "ticker", "ret"))
    assert all(abs((found[0, r.horizon].mean_ic or 0) - (r.mean_ic or 0)) < 1e-9 for r in again.collect())
    whole = gravity.config_sweep(spark.createDataFrame(rows.collect(), rows.schema), configs, horizons)
    whole.collect()
    final = whole._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert final.count("- Exchange hashpartitioning") <= 12, final
    rows.unpersist()
