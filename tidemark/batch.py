"""The whole analysis as one batch job, from raw readings to result tables.

Each stage reads the table the stage before it wrote, so raw readings are scanned once and a lost
executor repeats only its own stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import model_slug_text
from .operators import alerts, arima, explain, forecast, metrics, models, profile
from .operators.anomaly import combined_anomalies
from .operators.decompose import stl
from .operators.features import add_components, build_features, feature_columns
from .operators.isolation_forest import detect_isolation_forest
from .operators.resample import AVERAGED, SUMMED, monthly_mean, preprocess
from .operators.split import split_chronological
from .plans.positions import Layout
from .sources.readings import read_readings
from .sources.sinks import save_model, write_result

TARGET = "Global_active_power"


@dataclass
class Settings:
    """What a run computes. Defaults are the full-size parameters of the operators."""

    target: str = TARGET
    freq: str = "h"
    mean: Sequence[str] = AVERAGED
    total: Sequence[str] = SUMMED
    period: int = 24
    look_back: int = 48
    horizons: dict[str, int] = field(default_factory=lambda: dict(forecast.HORIZONS))
    with_components: bool = False
    robust_rounds: int | None = None
    forest: dict = field(default_factory=dict)
    boosted: dict = field(default_factory=dict)
    arima_train: int = 1500
    arima_test: int = 500
    explain_rows: int | None = None
    isolation_trees: int = 200
    layout: Layout | None = None
    tie: Sequence[str] = ()  # columns that tell raw readings of one instant apart


def run_batch(spark: SparkSession, source: str | DataFrame, out: str, settings: Settings | None = None) -> dict[str, str]:
    """Run every stage on one series and return the path of each result table."""
    s = settings or Settings()
    paths: dict[str, str] = {}

    def save(name: str, df: DataFrame) -> DataFrame:
        paths[name] = write_result(df, f"{out}/{name}")
        return spark.read.parquet(paths[name])

    raw = save("readings", read_readings(spark, source)) if isinstance(source, str) else source  # text is parsed once
    hourly = save("processed_hourly", preprocess(raw, s.freq, mean=s.mean, total=s.total, tie=s.tie, layout=s.layout))
    measures = [*s.mean, *s.total]

    save("eda_describe", profile.describe(hourly, measures))
    save("eda_monthly", monthly_mean(hourly, s.target, spine=True))
    save("eda_hours", profile.hour_profile(hourly, s.target))
    save("eda_weekdays", profile.weekday_profile(hourly, s.target))
    save("eda_heatmap", profile.hour_weekday_pivot(hourly, s.target))
    save("eda_correlations", profile.correlations(hourly, measures))
    save("eda_distribution", profile.histogram(hourly, s.target, 80))

    components = save("stl_components", stl(hourly, s.target, period=s.period, outer=s.robust_rounds, layout=s.layout))
    features = build_features(hourly, s.target, layout=s.layout)
    if s.with_components:
        features = add_components(features, components)
    features = save("featured_data", features)
    names = feature_columns(features, s.target)
    train, test = split_chronological(features, layout=s.layout)
    train, test = save("train", train), save("test", test)

    predictions: dict[str, DataFrame] = {}

    def predicted(name: str, df: DataFrame) -> None:
        predictions[name] = save(f"predictions_{model_slug_text(name)}", df)

    fitted = {
        "Random Forest": models.train_random_forest(train, names, s.target, **s.forest),
        "Boosted Trees": models.train_boosted_trees(train, names, s.target, **s.boosted),
    }
    for name, model in fitted.items():
        paths[f"model_{model_slug_text(name)}"] = save_model(model, f"{out}/model_{model_slug_text(name)}")
        predicted(name, models.score(model, test, s.target))
    predicted(
        "Seasonal ARIMA",
        arima.sarima_forecast(hourly, s.target, train_size=s.arima_train, test_size=s.arima_test, layout=s.layout),
    )
    predicted("Look-back Linear", forecast.look_back_regression(hourly, s.target, look_back=s.look_back, layout=s.layout))

    for label, steps in s.horizons.items():
        model, scored = forecast.multi_step_forecast(
            hourly, s.target, look_back=s.look_back, horizon=steps, layout=s.layout
        )
        save(f"multistep_{label}", metrics.horizon_means(scored, ids=["ts"]))
        save(f"future_forecast_{label}", forecast.future_forecast(hourly, s.target, model, look_back=s.look_back))

    for name, model in fitted.items():
        importance, _ = explain.explain_model(model, test, names, sample_size=s.explain_rows)
        save(f"shap_importance_{model_slug_text(name)}", importance)
    save("model_comparison", metrics.compare_models(metrics.union_models(predictions)))

    flags = detect_isolation_forest(hourly, [s.target, *s.total], trees=s.isolation_trees)
    severities = save("severity", alerts.assign_severity(hourly, s.target, layout=s.layout))
    save("alert_log", alerts.alert_log(severities))
    save("report_header", alerts.report_header(severities))
    save("report_severities", alerts.severity_counts(severities))
    save("report_top_alerts", alerts.top_alerts(severities))
    save("anomalies", combined_anomalies(hourly, s.target, iforest=flags.select("ts", "iforest"), layout=s.layout))
    return paths


def default_view(spark: SparkSession, out: str) -> DataFrame:
    """Period and size of a finished run."""
    return spark.read.parquet(f"{out}/processed_hourly").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("records")
    )
