"""Join helpers: keys that may be null, and statistics attached to every row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``on`` where null matches null; the columns of ``on`` come from the left."""
    names = {k: f"__right_{k}" for k in on}
    renamed = right.withColumnsRenamed(names)
    cond = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[names[k]]) for k in on))
    return left.join(renamed, cond, how).drop(*names.values())


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Attach aggregates of each row's series to the row.

    One global series reads its statistics through a scalar subquery, so no join is planned. Many
    series aggregate first (partial aggregation absorbs a hot key) and join on the keys, where the
    runtime picks broadcast or a skew-split merge by the real size.
    """
    if not keys:
        bundle = df.agg(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("__stats"))
        tagged = df.withColumn("__stats", bundle.scalar())
        return tagged.select(*df.columns, *[F.col("__stats")[n].alias(n) for n in stats])
    per_key = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return null_safe_join(df, per_key, keys)
