"""Names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def model_slug(name: Column) -> Column:
    """File-friendly model name."""
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def model_slug_text(name: str) -> str:
    return name.lower().replace(" ", "_")
