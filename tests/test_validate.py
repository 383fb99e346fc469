"""Walk-forward folds, fits and metrics against plain loops; direction models on what can and what can't be foretold."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from helpers import START, business_days, close, panel
from pyspark.sql import functions as F

from marketloom.operators import features, models, validate
from marketloom.operators.validate import WalkForward

PLAN = WalkForward(train_days=100, test_days=40, purge_days=3)


def table(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        for t in "AB":
            x1, x2 = rng.gauss(0, 1), rng.gauss(2, 3)
            y = 0.3 * x1 - 0.1 * x2 + 0.2 + rng.gauss(0, 0.5)
            rows.append((START + dt.timedelta(days=k), t, None if k % 37 == 0 else x1, x2, None if k == n - 1 else y))
    return spark.createDataFrame(rows, "date date, ticker string, x1 double, x2 double, y double"), rows


def plain_folds(n, plan):
    for k in range((n - plan.train_days) // plan.test_days):
        test = START + dt.timedelta(days=plan.train_days + k * plan.test_days)
        start = START if plan.expanding else START + dt.timedelta(days=k * plan.test_days)
        yield k, start, test - dt.timedelta(days=plan.purge_days), test, test + dt.timedelta(days=plan.test_days)


@pytest.mark.parametrize("expanding", [True, False])
def test_folds(spark, expanding):
    plan = WalkForward(100, 40, 3, expanding)
    df, rows = table(spark)
    found = sorted(tuple(r) for r in validate.fold_counts(df, validate.folds(df, plan)).collect())
    count = lambda a, z: sum(a <= r[0] < z for r in rows)
    assert found == [(*f, count(f[1], f[2]), count(f[3], f[4])) for f in plain_folds(300, plan)]
    assert len(found) == 5 and all((f[3] - f[2]).days == 3 for f in found)
    assert validate.folds(df.where(F.col("date") < START + dt.timedelta(days=120)), plan).count() == 0
    assert validate.folds(df.limit(0), plan).count() == 0


def test_bad_plans():
    for bad in ((3, 10, 3), (100, 0, 1), (100, 10, -1)):
        with pytest.raises(ValueError):
            WalkForward(*bad)


def test_linear_fit_and_metrics(spark):
    df, rows = table(spark)
    parts = validate.folds(df, PLAN)
    fits = {r.fold: r for r in validate.fit_linear(df, ["x1", "x2"], "y", parts).collect()}
    found = {r.fold: r for r in validate.walk_forward(df, ["x1", "x2"], "y", PLAN).collect()}
    for fold, a, b, c, d in plain_folds(300, PLAN):
        train = np.array([r[2:] for r in rows if a <= r[0] < b and None not in r], dtype=float)
        solved = np.linalg.lstsq(np.column_stack([np.ones(len(train)), train[:, :2]]), train[:, 2], rcond=None)[0]
        assert close([fits[fold].intercept, *fits[fold].slopes], solved.tolist(), 1e-8)
        test = np.array([r[2:] for r in rows if c <= r[0] < d and None not in r], dtype=float)
        y, p = test[:, 2], solved[0] + test[:, :2] @ solved[1:]
        tp, said, is_so = ((y > 0) & (p > 0)).sum(), (p > 0).sum(), (y > 0).sum()
        want = [len(y), ((y > 0) == (p > 0)).mean(), tp / said, tp / is_so, 2 * tp / (said + is_so), math.sqrt(((p - y) ** 2).mean()), np.abs(p - y).mean()]
        assert close(list(found[fold])[1:], [float(v) for v in want], 1e-8)
    assert len(found) == 5


def test_features_that_depend_on_each_other(spark):
    df, _ = table(spark)
    df = df.withColumns({"twice": F.col("x2") * 2, "same": F.lit(1.0)})
    one = {r.fold: r for r in validate.walk_forward(df, ["x2"], "y", PLAN).collect()}
    more = {r.fold: r for r in validate.walk_forward(df, ["x2", "twice", "same"], "y", PLAN).collect()}
    assert all(close([one[k].rmse, one[k].mae], [more[k].rmse, more[k].mae], 1e-6) for k in one)


def test_metrics_without_positives_and_auc(spark):
    rows = spark.createDataFrame([(0, True, 0.9), (0, False, 0.9), (0, False, 0.1), (0, None, 0.5), (1, False, 0.2)], "k int, a boolean, s double")
    found = {r.k: r for r in rows.groupBy("k").agg(*validate.classification_metrics(F.col("a"), F.col("s") > 0.5)).collect()}
    assert tuple(found[1])[1:] == (1, 1.0, None, None, None) and tuple(found[0])[1:4] == (3, 2 / 3, 0.5)
    assert {r.k: r.auc for r in validate.auc(rows, F.col("a"), "s", "k").collect()} == {0: 0.75, 1: None}


def test_direction_models(spark):
    """A random walk can't be foretold; a price that turns every ten days can, from momentum."""
    rng = random.Random(5)
    walk = [100.0]
    for _ in range(519):
        walk.append(walk[-1] * math.exp(rng.gauss(0, 0.01)))
    wave = [100 + 10 * math.sin(k / 3) + rng.gauss(0, 0.01) for k in range(520)]
    plan = WalkForward(300, 150, 5)
    names = models.feature_names((5, 20))
    few = {"logistic": models.MODELS["logistic"], "forest": models.MODELS["forest"], "boosted": models.MODELS["boosted"]}
    accuracy = {}
    for name, prices in (("walk", {"A": walk, "B": walk[::-1]}), ("wave", {"A": wave, "B": [2 * p for p in wave]})):
        rows = models.direction_rows(features.with_returns(panel(spark, prices, business_days(520))), (5, 20)).cache()
        found = models.direction_models(rows, names, plan, few).collect()
        assert sorted((r.model, r.fold) for r in found) == sorted((m, k) for m in few for k in range(2)) and all(r.n > 180 for r in found)
        accuracy[name] = [r.accuracy for r in found]
        if name == "wave":
            assert all(r.auc > 0.9 for r in found)
        rows.unpersist()
    assert all(0.35 < a < 0.65 for a in accuracy["walk"]) and all(a > 0.85 for a in accuracy["wave"])


def test_no_fold_to_fit(spark):
    rows = models.direction_rows(features.with_returns(panel(spark, {"A": [1.0 + k for k in range(200)]}, business_days(200))), (5,))
    assert models.direction_models(rows, models.feature_names((5,)), WalkForward(100, 50, 5)).count() == 0  # one class only
