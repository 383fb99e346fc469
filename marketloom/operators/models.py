"""Models of a price's direction on technical features, fitted by Spark ML inside walk-forward folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.expressions import by_ticker, divide
from marketloom.operators.features import technical_features
from marketloom.operators.validate import WalkForward, auc, classification_metrics, folds, in_part, within

SEED = 7
#: A new estimator by name.
MODELS: dict[str, Callable[[], Estimator]] = {
    "logistic": lambda: LogisticRegression(maxIter=30, regParam=1e-3),
    "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=SEED),
    "boosted": lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=SEED),
}


def direction_rows(panel: DataFrame, windows: Sequence[int] = (5, 20, 60), horizon: int = 1) -> DataFrame:
    """(date, ticker, features, fwd, label) of a panel (date, ticker, price, ret): fwd is the return over the horizon's rows that follow, label whether it is above 0.

    Features are free of a price's level: momentum, volatility, price to moving average.
    """
    wide = technical_features(panel, windows).join(panel.select("date", "ticker", "price"), ["date", "ticker"])
    fwd = divide(F.lead("price", horizon).over(by_ticker()), F.col("price")) - 1
    columns = [c for w in windows for c in (f"momentum_{w}", f"volatility_{w}")]
    ratios = {f"to_sma_{w}": divide(F.col("price"), F.col(f"sma_{w}")) - 1 for w in windows}
    out = wide.select("date", "ticker", *columns, *(c.alias(n) for n, c in ratios.items()), fwd.alias("fwd"))
    return out.withColumn("label", (F.col("fwd") > 0).cast("double"))


def feature_names(windows: Sequence[int] = (5, 20, 60)) -> list[str]:
    return [f"{kind}_{w}" for w in windows for kind in ("momentum", "volatility", "to_sma")]


def fold_predictions(rows: DataFrame, features: Sequence[str], parts: DataFrame, models: dict[str, Callable[[], Estimator]] = MODELS) -> DataFrame | None:
    """(model, fold, date, ticker, label, predicted, probability) of all test rows whose features are known; None without a fold that can be fitted.

    Each model is fitted on each fold's training part, by the cluster; the driver holds a row a fold. Folds whose training part has one class only are left out.
    rows (date, ticker, features, label) are read by every fit, so write them first.
    """
    known = rows.where(" and ".join(f"`{c}` is not null" for c in features))
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(known).select("date", "ticker", "label", "features")
    days = vectors.where("label is not null").groupBy("date").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    able = in_part(days, parts, "train").groupBy("fold").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    out = None
    for part in parts.join(able.select("fold"), "fold").orderBy("fold").collect():
        bound = {c: F.lit(part[c]) for c in part.asDict() if c != "fold"}
        inside = {p: vectors.withColumns(bound).where(within(p)).select(*vectors.columns) for p in ("train", "test")}
        train = inside["train"].where("label is not null")
        for name, make in models.items():
            told = make().setFeaturesCol("features").setLabelCol("label").fit(train).transform(inside["test"])
            found = told.select(F.lit(name).alias("model"), F.lit(part["fold"]).alias("fold"), "date", "ticker", "label", F.col("prediction").alias("predicted"), vector_to_array("probability")[1].alias("probability"))
            out = found if out is None else out.unionByName(found)
    return out


def model_metrics(predictions: DataFrame) -> DataFrame:
    """(model, fold, n, accuracy, precision, recall, f1, auc) of labelled predictions."""
    known = predictions.where("label is not null")
    actual = F.col("label") == 1
    counts = known.groupBy("model", "fold").agg(*classification_metrics(actual, F.col("predicted") == 1))
    return counts.join(auc(known, actual, "probability", "model", "fold"), ["model", "fold"])


def direction_models(rows: DataFrame, features: Sequence[str], plan: WalkForward = WalkForward(), models: dict[str, Callable[[], Estimator]] = MODELS) -> DataFrame:
    """(model, fold, n, accuracy, precision, recall, f1, auc) of each model on each fold's test part, for rows of direction_rows."""
    found = fold_predictions(rows, features, folds(rows, plan), models)
    if found is None:
        return rows.sparkSession.createDataFrame([], "model string, fold int, n long, accuracy double, precision double, recall double, f1 double, auc double")
    return model_metrics(found)
