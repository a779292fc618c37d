"""Small inputs made by hand."""

import numpy as np
import pandas as pd
import pyarrow as pa


def hours(n, start="2024-01-01"):
    return pd.date_range(start, periods=n, freq="h")


def series(n, seed=0, gaps=0.0, nulls=0.0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"ts": hours(n), "v": rng.normal(10, 3, n).round(3)})
    if nulls:
        pdf.loc[rng.random(n) < nulls, "v"] = np.nan
    if gaps:
        pdf = pdf[rng.random(n) >= gaps].reset_index(drop=True)
    return pdf


def to_spark(spark, pdf):
    """NaN becomes null, time stamps stay without a zone."""
    return spark.createDataFrame(pa.Table.from_pandas(pdf, preserve_index=False))


def seasonal(n, seed=0, noise=0.3):
    """Trend, daily sine and noise."""
    rng = np.random.default_rng(seed)
    i = np.arange(n)
    v = 20 + 0.01 * i + 3 * np.sin(2 * np.pi * i / 24) + rng.normal(0, noise, n)
    return pd.DataFrame({"ts": hours(n), "v": v})
