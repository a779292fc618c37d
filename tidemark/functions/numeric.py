"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_negative(c: Column) -> Column:
    """Clip below at zero; null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def residual(actual: Column, predicted: Column) -> Column:
    return actual - predicted


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)
