"""Regressors on the feature table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting

# Training parameters of the two tree ensembles.
FOREST_PARAMS = {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 4, "seed": 42}
BOOSTED_PARAMS = {"maxIter": 500, "maxDepth": 7, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": 42}


def _fit(train: DataFrame, features: Sequence[str], regressor) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, regressor.setFeaturesCol("features").setPredictionCol("predicted")]).fit(train)


def train_random_forest(train: DataFrame, features: Sequence[str], target: str, **params) -> PipelineModel:
    """Random forest that considers every feature at every split."""
    settings = {"featureSubsetStrategy": "all", **FOREST_PARAMS, **params}
    return _fit(train, features, RandomForestRegressor(labelCol=target, **settings))


def train_boosted_trees(train: DataFrame, features: Sequence[str], target: str, **params) -> PipelineModel:
    """Gradient-boosted trees; columns are sampled per split, at the given share."""
    settings = {"featureSubsetStrategy": "0.8", **BOOSTED_PARAMS, **params}
    return _fit(train, features, GBTRegressor(labelCol=target, **settings))


@dataclass
class BoostedRegressor:
    """Histogram-boosted trees over named columns; ``transform`` adds ``predicted``."""

    model: boosting.BoostedModel
    features: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        return self.model.predict(df.withColumn("__x", x), "__y", "__x").withColumn("predicted", F.col("__y")[0]).drop("__x", "__y")


def train_histogram_boosting(train: DataFrame, features: Sequence[str], target: str, *, ids: Sequence[str] = ("ts",), **params) -> BoostedRegressor:
    """Boosted trees with Hessian sums and one sample of the columns for each tree. ``train`` is read three times: pass a written table."""
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    rows = train.select(*ids, x, F.array(F.col(target).cast("double")).alias("y"))
    return BoostedRegressor(boosting.train(rows, ids=ids, **{**boosting.BOOSTED, **params}), tuple(features))


def train_linear(train: DataFrame, features: Sequence[str], target: str, **params) -> PipelineModel:
    return _fit(train, features, LinearRegression(labelCol=target, **params))


def score(model: PipelineModel | BoostedRegressor, df: DataFrame, target: str, *, ids: Sequence[str] = ("ts",)) -> DataFrame:
    """Prediction table: identity, actual, predicted."""
    return model.transform(df).select(*ids, F.col(target).alias("actual"), "predicted")
