"""Severity bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands in standard deviations, lower bound included, upper bound excluded.
SEVERITY_BANDS = {
    "LOW": (2.0, 2.5),
    "MEDIUM": (2.5, 3.0),
    "HIGH": (3.0, 4.0),
    "CRITICAL": (4.0, 9999.0),
}
NORMAL = "NORMAL"


def severity(z: Column) -> Column:
    """Band of a deviation. Null and values beyond the last band are NORMAL."""
    banded = F.lit(None).cast("string")
    for level, (lo, hi) in SEVERITY_BANDS.items():
        banded = F.when((z >= lo) & (z < hi), F.lit(level)).otherwise(banded)
    return F.coalesce(banded, F.lit(NORMAL))


def severity_rank(level: Column) -> Column:
    """0 for NORMAL to 4 for CRITICAL, for sorting by urgency rather than by letter."""
    ranked = F.lit(0)
    for i, name in enumerate(SEVERITY_BANDS, 1):
        ranked = F.when(level == name, F.lit(i)).otherwise(ranked)
    return ranked
