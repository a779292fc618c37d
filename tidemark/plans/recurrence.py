"""First-order linear recurrences ``s[t] = a[t] * s[t-1] + b[t]`` over series of any length.

A row is the affine map s -> a s + b, and such maps compose to one: a series is cut into chunks of consecutive
positions, each chunk composes its own maps (every row gets the map from the chunk's start to itself), the
chunk's last maps give the state that enters each chunk, and one join brings it back. Tasks hold one chunk.
Moving-average residuals, exponential smoothing and autoregressive filters are such recurrences.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import null_safe_join
from .positions import Layout, add_positions, resolve
from .session import materialize


def compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps from before the first element to behind each one, by doubling: as many passes as the length has bits."""
    a, b = a.astype(float, copy=True), b.astype(float, copy=True)
    step = 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step]  # the right side is complete before it is stored
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def linear_recurrence(
    df: DataFrame,
    a: Column,
    b: Column,
    *,
    start: float = 0.0,
    name: str = "state",
    previous: str | None = None,
    keys: Sequence[str] = (),
    ts: str = "ts",
    tie: Sequence[str] = (),
    layout: Layout | None = None,
    position: str | None = None,
) -> DataFrame:
    """``df`` with the state behind each row in ``name`` and, if asked for, before it in ``previous``.

    A row whose ``a`` or ``b`` is null leaves the state as it is. States are bounded for ``|a| <= 1``; with larger
    ones they grow as the recurrence does. ``position`` names an existing gapless position column. Rows without
    a time stamp are left out. A series of n rows has a table of n / ``chunk_rows`` chunks, ordered in one task.
    """
    columns = df.columns
    layout = resolve(df, keys, ts, layout, tie)
    pos = position or "__rn"
    rows = df if position else add_positions(df, keys, ts, tie=tie, layout=layout, position=pos)
    known = a.isNotNull() & b.isNotNull()
    rows = rows.withColumns({
        "__chunk": F.call_function("div", F.col(pos), F.lit(max(layout.chunk_rows, 1))),
        "__a": F.when(known, a.cast("double")).otherwise(1.0),
        "__b": F.when(known, b.cast("double")).otherwise(0.0),
    })
    slim = rows.select(*keys, "__chunk", F.col(pos).alias("__at"), "__a", "__b")
    schema = T.StructType([*slim.schema.fields, T.StructField("__last", T.BooleanType())])

    def inside(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("__at")
        through, added = compose(chunk["__a"].to_numpy(), chunk["__b"].to_numpy())
        return chunk.assign(__a=through, __b=added, __last=np.arange(len(chunk)) == len(chunk) - 1)

    mapped = materialize(slim.groupBy(*keys, "__chunk").applyInPandas(inside, schema), "maps")
    ends = mapped.where("__last").select(*keys, "__chunk", "__a", "__b")
    into = T.StructType([*ends.drop("__a", "__b").schema.fields, T.StructField("__in", T.DoubleType())])

    def across(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("__chunk")
        through, added = compose(table["__a"].to_numpy(), table["__b"].to_numpy())
        entering = np.r_[start, through[:-1] * start + added[:-1]]
        return table.drop(columns=["__a", "__b"]).assign(__in=entering)

    grouped = ends.groupBy(*keys) if keys else ends.groupBy()
    joined = null_safe_join(mapped, grouped.applyInPandas(across, into), [*keys, "__chunk"])
    state = joined.select(*keys, F.col("__at").alias(pos), (F.col("__a") * F.col("__in") + F.col("__b")).alias(name))
    out = null_safe_join(rows, state, [*keys, pos])
    extra = [name]
    if previous:
        before = state.select(*keys, (F.col(pos) + 1).alias(pos), F.col(name).alias(previous))
        out = null_safe_join(out, before, [*keys, pos]).withColumn(previous, F.coalesce(previous, F.lit(float(start))))
        extra.append(previous)
    return out.select(*[F.col(f"`{c}`") for c in columns], *extra)
