import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import close, panel

from marketloom.operators import explore, features
from marketloom.sources import panels


def test_describe(spark):
    found = explore.describe(panel(spark, {"B": [1, 2, 3, 10], "A": [5, None, 5, 5]}), "price")
    b = found.where("ticker = 'B'").first()
    assert close([b.p01, b.p25, b.p50, b.p99], [1.03, 1.75, 2.5, 9.79])
    a = found.where("ticker = 'A'").first()
    assert (a["count"], a.non_null, a.n_unique, a.std) == (3.0, 3, 1, 0.0)
    many = spark.range(5001).selectExpr("'A' ticker", "cast(id as double) price")
    assert explore.describe(many, "price").first().n_unique is None
    assert [r.ticker for r in explore.describe(panel(spark, {"B": [1, 2], "C": [1, 2], "A": [5, None]}), "price").collect()] == ["A", "B", "C"]


def test_empty_panels_are_refused(spark):
    none = panel(spark, {"A": [1, 2]}).limit(0)
    for work in (explore.describe, explore.missingness, explore.correlation_pairs, explore.histogram, explore.density, explore.box_stats):
        with pytest.raises(ValueError, match="empty"):
            work(none, "price")
        assert work(none, "price", guard=False).count() == 0
    with pytest.raises(ValueError, match="empty"):
        explore.quick_summary(none)


def test_missingness(spark):
    found = explore.missingness(panel(spark, {"A": [1, None, 3, None], "B": [1, 1, 1, 1]}), "price")
    a = found.where("ticker = 'A'").first()
    assert (a.na_count, a.na_pct, a.first_na, a.last_na) == (2, 50.0, dt.date(2023, 1, 3), dt.date(2023, 1, 5))
    assert found.where("ticker = 'B'").first().first_na is None
    assert [r.ticker for r in explore.missingness(panel(spark, {"A": [1, 1], "C": [1, None], "B": [1, None]}), "price").collect()] == ["B", "C", "A"]
    assert explore.null_counts(panel(spark, {"A": [1, None]})).first().price_nulls == 1


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlations_are_pairwise_complete(spark, method):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.integers(0, 6, (40, 3)).astype(float), columns=list("ABC"))
    frame.loc[3, "A"] = frame.loc[5, "B"] = np.nan
    rows = panel(spark, {c: [None if np.isnan(v) else v for v in frame[c]] for c in frame} | {"Z": [1.0] * 40})
    found = {(r.i, r.j): r["corr"] for r in explore.correlation_pairs(rows, "price", method).collect()}

    def expected(i, j):
        both = frame[[i, j]].dropna()
        x, y = both[i].to_numpy(), both[j].to_numpy()
        if method == "pearson":
            return np.corrcoef(x, y)[0, 1]
        if method == "spearman":
            return np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
        dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
        return (dx * dy).sum() / np.sqrt((dx**2).sum() * (dy**2).sum())

    for i, j in (("A", "B"), ("A", "C"), ("B", "C")):
        assert abs(found[i, j] - expected(i, j)) < 1e-9
    assert found["A", "Z"] is None


def test_matrix_histogram_box_density(spark):
    values = list(np.random.default_rng(5).normal(0, 1, 200))
    rows = panel(spark, {"A": values, "B": [2 * v for v in values]})
    matrix = {r.ticker: (r.A, r.B) for r in explore.correlation_matrix(rows, "price", ["A", "B"]).collect()}
    assert close(list(matrix["A"]), [1, 1]) and close(list(matrix["B"]), [1, 1])
    bins = explore.histogram(rows, "price", 10).where("ticker = 'A'").orderBy("bin").collect()
    counts = np.zeros(10, dtype=int)
    for r in bins:
        counts[r.bin] = r.n
    assert counts.tolist() == np.histogram(values, 10)[0].tolist()
    assert explore.histogram(panel(spark, {"A": [3, 3]}), "price").first().bin == 0
    box = explore.box_stats(rows, "price").where("ticker = 'A'").first()
    q1, q3 = np.percentile(values, [25, 75])
    inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert close([box.q1, box.q3, box.whisker_low, box.whisker_high, box.n_outliers], [q1, q3, min(inside), max(inside), len(values) - len(inside)])
    grid = explore.density(rows, "price").where("ticker = 'A'").orderBy("point").collect()
    assert abs(sum(r.density for r in grid) * (grid[1].x - grid[0].x) - 1) < 0.02


def test_quick_summary(spark):
    rows = panel(spark, {"A": [1, 2], "B": [1, 3], "C": [2, 2]})
    found = explore.quick_summary(prices=rows, max_cols=2)
    assert set(found) == {"describe", "missingness"} and {r.ticker for r in found["describe"].collect()} == {"A", "B"}
    assert "corr" in explore.quick_summary(returns=rows.withColumnRenamed("price", "ret"))
    with pytest.raises(ValueError):
        explore.quick_summary()
    stats = explore.panel_stats(rows, "price").first()
    assert stats.mean == pytest.approx((1.5 + 2 + 2) / 3) and stats.max == 3


def test_unknown_tickers_and_empty_panels_are_refused(spark):
    rows = panel(spark, {"A": [1, 2, 3, 4], "B": [2, 2, 3, 5]})
    for table in (explore.histogram, explore.density, explore.box_stats):
        assert {r.ticker for r in table(rows, "price", ticker="B").collect()} == {"B"}
        with pytest.raises(KeyError, match="X not found in returns"):
            table(rows, "price", ticker="X")
    for table in (lambda df: features.normalised(df), lambda df: features.rolling_stats(df, "price")):
        with pytest.raises(ValueError, match="is empty"):
            table(rows.limit(0))
    assert features.normalised(rows.limit(0), guard=False).count() == 0
    with pytest.raises(ValueError, match="No data returned"):
        panels.fetch_prices(rows.withColumnRenamed("price", "close"), ["X"])
    assert panels.fetch_prices(rows.withColumnRenamed("price", "close"), ["X"], guard=False).count() == 0
