"""Forecast metrics and model comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metric names and the digits they are reported with.
METRIC_DIGITS = {"MAE": 4, "RMSE": 4, "MAPE": 2, "R2": 4}
LOWER_IS_BETTER = ("MAE", "RMSE", "MAPE")


def metric_columns(actual: str = "actual", predicted: str = "predicted") -> dict[str, Column]:
    """MAE, RMSE, MAPE (rows with a zero actual left out) and R2 as single-pass aggregates."""
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    a = F.when(both, F.col(actual))
    err = a - F.col(predicted)
    spread = F.var_pop(a) * F.count(a)
    return {
        "MAE": F.avg(F.abs(err)),
        "RMSE": F.sqrt(F.avg(err * err)),
        "MAPE": F.avg(F.abs(F.try_divide(err, a))) * 100,
        "R2": 1 - F.try_divide(F.sum(err * err), spread),
    }


def evaluate(
    predictions: DataFrame,
    *,
    by: Sequence[str] = (),
    actual: str = "actual",
    predicted: str = "predicted",
    rounded: bool = True,
) -> DataFrame:
    cols = metric_columns(actual, predicted)
    # Rounding an average of exact halves is the only place the tie rule shows; ties go to even.
    return predictions.groupBy(*by).agg(
        *[(F.bround(c, METRIC_DIGITS[n]) if rounded else c).alias(n) for n, c in cols.items()]
    )


def union_models(tables: Mapping[str, DataFrame], label: str = "Model") -> DataFrame:
    """Stack per-model tables under a label column."""
    tagged = [df.withColumn(label, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)


def compare_models(predictions: DataFrame, label: str = "Model") -> DataFrame:
    """Metrics of every model in a stacked prediction table, best RMSE first."""
    return evaluate(predictions, by=[label]).orderBy("RMSE", label)


def best_flags(comparison: DataFrame, label: str = "Model") -> DataFrame:
    """Long form with ``is_best``: lowest error, highest R2. The input has one row per model."""
    long = comparison.unpivot([label], list(METRIC_DIGITS), "metric", "value")
    w = Window.partitionBy("metric")
    best = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.min("value").over(w)).otherwise(F.max("value").over(w))
    return long.withColumn("is_best", F.col("value") == best)


def normalised(comparison: DataFrame, label: str = "Model") -> DataFrame:
    """Every metric on 0 to 1, higher is better."""
    long = comparison.unpivot([label], list(METRIC_DIGITS), "metric", "value")
    w = Window.partitionBy("metric")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    share = (F.col("value") - lo) / (hi - lo + F.lit(1e-9))
    turned = F.when(F.col("metric").isin(*LOWER_IS_BETTER), 1 - share).otherwise(share)
    scored = long.withColumn("score", turned)
    return scored.groupBy(label).agg(*[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in METRIC_DIGITS])


def horizon_means(df: DataFrame, *, ids: Sequence[str], actual: str = "y", predicted: str = "y_hat") -> DataFrame:
    """Mean over the horizon of actual and predicted arrays, per sample."""

    def mean(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x) / F.size(c)

    return df.select(*ids, mean(actual).alias("actual_mean"), mean(predicted).alias("predicted_mean"))


def residual_table(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    err = F.col(actual) - F.col(predicted)
    return df.withColumns({"residual": err, "abs_error": F.abs(err)})
