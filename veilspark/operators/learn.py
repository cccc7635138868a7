"""Machine-learning utility: train on real, synthetic or merged rows, test on real ones, with pyspark.ml."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled
from .evaluate import classification, regression

CLASSIFIERS = {
    "tree": lambda: DecisionTreeClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", maxDepth=8, seed=1),
    "forest": lambda: RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", numTrees=20, maxDepth=8, seed=1),
    "logistic": lambda: LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=30),
}
REGRESSORS = {
    "tree": lambda: DecisionTreeRegressor(featuresCol="_x", labelCol="_y", predictionCol="_p", maxDepth=8, seed=1),
    "forest": lambda: RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol="_p", numTrees=20, maxDepth=8, seed=1),
    "ridge": lambda: LinearRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", regParam=0.1),
}


#: Models of which a row of weight n is the same as n equal rows; bootstraps and standardised penalties tell them apart.
BY_COUNTS = {"tree"}
WEIGHT = "_n"


def utility(train: Mapping[str, DataFrame], test: DataFrame, features: Sequence[str], label: str, models: Sequence[str] = ("tree", "logistic"), kind: str = "classification") -> DataFrame:
    """trained_on, model and the metrics on the test rows.

    Equal rows are added up and written first: a tree is fitted on the distinct rows with
    their counts, and each distinct test row is predicted once, so neither the passes of
    a fit nor the predictions run over all rows. Rows with nulls are dropped from what is
    written: a filter above synthetic rows would move below their attributes' draws and
    repeat them, one inside the other.
    """
    makers, score = (CLASSIFIERS, classification) if kind == "classification" else (REGRESSORS, regression)
    held = lambda df, name: settled(df, name).select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y"), *([WEIGHT] if WEIGHT in df.columns else [])).na.drop()
    counted = lambda df: held(df.groupBy(*features, label).agg(F.count("*").cast("double").alias(WEIGHT)), "counted-rows")
    parts, tested = [], counted(test)
    for name, df in train.items():
        distinct = counted(df) if set(models) & BY_COUNTS else None
        rows = held(df.select(*features, label), "training-rows") if set(models) - BY_COUNTS else None
        for model in models:
            maker, table = makers[model](), rows
            if model in BY_COUNTS:
                maker, table = maker.setWeightCol(WEIGHT), distinct
            fitted = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), maker]).fit(table)
            parts.append(score(fitted.transform(tested), "_y", "_p", WEIGHT).select(F.lit(name).alias("trained_on"), F.lit(model).alias("model"), "*"))
    return reduce(DataFrame.unionByName, parts)
