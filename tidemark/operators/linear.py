"""Least squares from aggregates.

The cross products are summed by Spark, per series or over all rows; what is solved afterwards is a
system as small as the number of regressors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_index(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def gram(df: DataFrame, columns: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """One row per series: ``n`` and ``products``, the upper triangle of the cross products.

    Rows with a null in any column are left out.
    """
    p = len(columns)
    named = df.select(*keys, *[c.cast("double").alias(f"__x{i}") for i, c in enumerate(columns)]).na.drop("any", subset=[f"__x{i}" for i in range(p)])
    sums = [F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")) for i, j in pair_index(p)]
    return named.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("products"))


def unpack(products: Sequence[float], p: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle."""
    m = np.zeros((p, p))
    for (i, j), v in zip(pair_index(p), products):
        m[i, j] = m[j, i] = v
    return m


def solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Least squares solution, minimum norm when regressors are dependent."""
    return np.linalg.lstsq(xx, xy, rcond=1e-12)[0]


def cross_products(df: DataFrame, x: str, y: str, n_x: int, n_y: int) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X and X'Y (with an intercept in front) of array columns.

    Each task reduces its rows to one small matrix; the matrices are added up by position in a
    shuffle, so the driver receives only the total.
    """
    p = n_x + 1

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((p, p + n_y)), 0
        for pdf in parts:
            if len(pdf):
                a = np.column_stack([np.ones(len(pdf)), np.stack(pdf[x].to_numpy())])
                b = np.stack(pdf[y].to_numpy()).reshape(len(pdf), n_y)
                total += a.T @ np.column_stack([a, b])
                rows += len(pdf)
        yield pd.DataFrame({"n": [rows], "cells": [total.ravel()]})

    per_task = df.select(x, y).mapInPandas(partial, "n long, cells array<double>")
    cells = per_task.select("n", F.posexplode("cells").alias("pos", "v"))
    summed = cells.groupBy("pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("pos").toPandas()
    m = summed["v"].to_numpy().reshape(p, p + n_y)
    return m[:, :p], m[:, p:], int(summed["n"].iloc[0])
