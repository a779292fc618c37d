"""Filters, projections and limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import SUB_METERS


def date_range(df: DataFrame, start, end, *, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` to ``end``, both included.

    An end given as a date is its midnight, so of the last day only that instant remains.
    """
    kind = df.schema[ts].dataType
    return df.where(F.col(ts).between(F.lit(str(start)).cast(kind), F.lit(str(end)).cast(kind)))


def default_range(df: DataFrame, *, ts: str = "ts") -> DataFrame:
    """First and last day, and the number of records."""
    return df.agg(
        F.min(ts).cast("date").alias("first_day"), F.max(ts).cast("date").alias("last_day"), F.count("*").alias("records")
    )


def null_census(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column in one pass: ``column``, ``nulls``, ``null_pct``."""
    counted = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counted.unpivot(["__n"], list(columns), "column", "nulls")
    return long.select("column", "nulls", (F.try_divide("nulls", "__n") * 100).alias("null_pct"))


def null_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All nulls, and their mean share over the columns in percent."""
    return null_census(df, columns).agg(F.sum("nulls").alias("total_nulls"), F.avg("null_pct").alias("mean_null_pct"))


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def split_target(df: DataFrame, target: str, *, keep: Sequence[str] = ("ts",)) -> tuple[DataFrame, DataFrame]:
    """Features (every column but the target) and the target, both with the identifying columns."""
    return df.select(*[c for c in df.columns if c != target]), df.select(*keep, target)


def flagged(df: DataFrame, flag: str) -> DataFrame:
    return df.where(F.col(flag))


def with_members(df: DataFrame, column: str, members: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(members)))


def flagged_with_level(df: DataFrame, flag: str, level: str, column: str = "severity") -> DataFrame:
    return df.where(F.col(flag) & (F.col(column) == level))


def channel_breakdown(df: DataFrame, labels: Mapping[str, str] = SUB_METERS, *, ids: Sequence[str] = ("ts",)) -> DataFrame:
    """Sub-meter channels in long form under their labels; channels the table lacks are skipped."""
    present = [c for c in labels if c in df.columns]
    long = df.unpivot(list(ids), present, "channel", "reading")
    naming = F.create_map(*[F.lit(x) for c in present for x in (c, labels[c])])
    return long.withColumn("channel", naming[F.col("channel")])


# The engine's own limit of rows per group that it applies before a shuffle.
GROUP_LIMIT = 1000
PARTS = 64


def last_rows(df: DataFrame, n: int, *, keys: Sequence[str] = (), ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows, of each series when keys are given.

    One series keeps at most ``n`` rows per task before anything is shuffled; so do many series, or they
    keep at most ``n`` rows in each of ``PARTS`` parts of a series when ``n`` is above ``GROUP_LIMIT``.
    """
    newest = [F.col(c).desc() for c in (ts, *tie)]
    if not keys:
        return df.orderBy(*newest).limit(n)
    if n > GROUP_LIMIT:
        # beyond this the engine doesn't limit groups before the shuffle: each part of a series keeps its last n first
        parts = df.withColumn("__part", F.pmod(F.xxhash64(ts, *tie), F.lit(PARTS)))
        part = Window.partitionBy(*keys, "__part").orderBy(*newest)
        df = parts.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= n).drop("__r", "__part")
    w = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def top_rows(df: DataFrame, n: int, by: Column | str, *, tie: Sequence[str] = ("ts",)) -> DataFrame:
    """The ``n`` largest rows by one column."""
    return df.orderBy((F.col(by) if isinstance(by, str) else by).desc(), *tie).limit(n)


def seeded_sample(df: DataFrame, n: int, *, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their identity: the same rows on any cluster."""
    order = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))
    return df.orderBy(order, *ids).limit(n)
