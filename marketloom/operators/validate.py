"""Walk-forward validation: folds in time with a purged gap, a fit for each fold, metrics by one aggregate.

Training parts of all folds come from the same sums a date, so an expanding window repeats no rows: what grows with the folds is dates times folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expressions import divide


@dataclass(frozen=True)
class WalkForward:
    """Days of the first training part, of a test part and of the gap before it, which is at least as long as a target looks ahead."""

    train_days: int = 730
    test_days: int = 365
    purge_days: int = 5
    expanding: bool = True

    def __post_init__(self) -> None:
        if self.train_days <= self.purge_days or self.test_days < 1 or self.purge_days < 0:
            raise ValueError("train_days must exceed purge_days, test_days be positive, purge_days not be negative")


def folds(panel: DataFrame, plan: WalkForward = WalkForward()) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end), ends excluded: as many whole test parts as there are after the first train_days of the panel's dates.

    A training part ends purge_days before its test part and starts with the panel, or train_days less the gap before its end if not expanding.
    """
    span = panel.agg(F.min("date").alias("a"), F.max("date").alias("z"))
    n = F.floor((F.datediff("z", "a") + 1 - plan.train_days) / plan.test_days).cast("int")
    each = span.where(n >= 1).select("a", F.explode(F.sequence(F.lit(0), n - 1)).alias("fold"))
    test = F.date_add("a", plan.train_days + F.col("fold") * plan.test_days)
    start = F.col("a") if plan.expanding else F.date_add("a", F.col("fold") * plan.test_days)
    return each.select("fold", start.alias("train_start"), F.date_sub(test, plan.purge_days).alias("train_end"), test.alias("test_start"), F.date_add(test, plan.test_days).alias("test_end"))


def within(part: str) -> Column:
    """Whether a date is in a fold's part, train or test."""
    return (F.col("date") >= F.col(f"{part}_start")) & (F.col("date") < F.col(f"{part}_end"))


def in_part(rows: DataFrame, parts: DataFrame, part: str) -> DataFrame:
    """Rows with the fold whose part they are in; of a training part, once for each fold."""
    # A fold a test part: no more rows than the panel has days.
    return rows.join(F.broadcast(parts.select("fold", f"{part}_start", f"{part}_end")), within(part)).drop(f"{part}_start", f"{part}_end")


def fold_counts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The folds with n_train and n_test, the rows of their parts."""
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    counts = [in_part(days, parts, p).groupBy("fold").agg(F.sum("n").alias(f"n_{p}")) for p in ("train", "test")]
    out = parts
    for c in counts:
        out = out.join(c, "fold", "left")
    return out.withColumns({f"n_{p}": F.coalesce(f"n_{p}", F.lit(0)).cast("long") for p in ("train", "test")})


def linear_sums(rows: DataFrame, features: Sequence[str], target: str, parts: DataFrame) -> DataFrame:
    """(fold, n, sums): of each fold's training rows that are complete, sums of features and target and of their products."""
    columns = [*features, target]
    known = rows.where(" and ".join(f"`{c}` is not null" for c in columns))
    terms = [F.col(f"`{c}`") for c in columns] + [F.col(f"`{a}`") * F.col(f"`{b}`") for k, a in enumerate(columns) for b in columns[k:]]
    days = known.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *(F.sum(t).alias(f"s{k}") for k, t in enumerate(terms)))
    return in_part(days, parts, "train").groupBy("fold").agg(F.sum("n").alias("n"), F.array(*(F.sum(f"s{k}") for k in range(len(terms)))).alias("sums"))


def fit_linear(rows: DataFrame, features: Sequence[str], target: str, parts: DataFrame) -> DataFrame:
    """(fold, intercept, slopes): least squares of each fold's training part; of features that depend on each other the shortest solution.

    To the driver goes a row a fold, of (k + 1) (k + 4) / 2 numbers for k features. A fold without complete training rows has none.
    """
    k, out = len(features), []
    for row in linear_sums(rows, features, target, parts).collect():
        n, sums = row["n"], np.array(row["sums"])
        mean, cross = sums[: k + 1] / n, np.zeros((k + 1, k + 1))
        cross[np.triu_indices(k + 1)] = sums[k + 1 :]
        cross = cross + np.triu(cross, 1).T
        cov = cross / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
        scale[scale == 0] = 1.0
        slopes = np.linalg.lstsq(cov[:k, :k] / np.outer(scale, scale), cov[:k, k] / scale, rcond=1e-12)[0] / scale
        out.append((row["fold"], float(mean[k] - slopes @ mean[:k]), [float(b) for b in slopes]))
    return rows.sparkSession.createDataFrame(out, "fold int, intercept double, slopes array<double>")


def predict_linear(rows: DataFrame, features: Sequence[str], parts: DataFrame, fitted: DataFrame) -> DataFrame:
    """Test rows of each fold with `predicted`, by the fold's own fit."""
    tested = in_part(rows, parts, "test").join(F.broadcast(fitted), "fold")  # a row a fold
    value = F.col("intercept")
    for k, c in enumerate(features):
        value = value + F.col("slopes")[k] * F.col(f"`{c}`")
    return tested.withColumn("predicted", value).drop("intercept", "slopes")


def classification_metrics(actual: Column, predicted: Column) -> list[Column]:
    """Aggregates of two booleans: n, accuracy, precision, recall, f1; NULL where a divisor is 0. Rows where either is NULL don't count."""
    both = actual.isNotNull() & predicted.isNotNull()
    n, hit = F.count_if(both).cast("double"), F.count_if(both & (actual == predicted)).cast("double")
    tp, said, is_so = (F.count_if(both & c).cast("double") for c in (actual & predicted, predicted, actual))
    return [F.count_if(both).alias("n"), divide(hit, n).alias("accuracy"), divide(tp, said).alias("precision"), divide(tp, is_so).alias("recall"), divide(2 * tp, said + is_so).alias("f1")]


def error_metrics(actual: Column, predicted: Column) -> list[Column]:
    """Aggregates of two numbers: rmse, mae. Rows where either is NULL don't count."""
    error = predicted - actual
    return [F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae")]


def auc(scored: DataFrame, actual: Column, score: str, *keys: str, bins: int = 10_000) -> DataFrame:
    """(keys, auc): the chance that a positive row has a higher score (0 to 1) than a negative one. Scores within 1 / bins count as ties, so a group is `bins` counts at most."""
    place = F.floor(F.col(score) * bins).cast("int")
    known = scored.where(actual.isNotNull() & F.col(score).isNotNull())
    counts = known.groupBy(*keys, place.alias("__bin")).agg(F.count_if(actual).cast("double").alias("__p"), F.count_if(~actual).cast("double").alias("__q"))
    below = F.coalesce(F.sum("__q").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pairs = counts.withColumn("__won", F.col("__p") * (below + F.col("__q") / 2))
    return pairs.groupBy(*keys).agg(divide(F.sum("__won"), F.sum("__p") * F.sum("__q")).alias("auc"))


def walk_forward(rows: DataFrame, features: Sequence[str], target: str, plan: WalkForward = WalkForward()) -> DataFrame:
    """(fold, n, accuracy, precision, recall, f1, rmse, mae) of a linear fit of the target in each fold: its sign as a class, its value as a number. rows: (date, features, target)."""
    parts = folds(rows, plan)
    found = predict_linear(rows, features, parts, fit_linear(rows, features, target, parts))
    actual, predicted = F.col(f"`{target}`"), F.col("predicted")
    known = found.where(actual.isNotNull() & predicted.isNotNull())
    return known.groupBy("fold").agg(*classification_metrics(actual > 0, predicted > 0), *error_metrics(actual, predicted))
