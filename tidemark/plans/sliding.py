"""Sliding statistics whose cost per row doesn't depend on the window's length.

Rows are cut into blocks of consecutive positions, no longer than the window. A window then is the end of one
block, some whole blocks, and the start of the block of its last row, so each row needs two summaries only:
of its block up to the row, and of its block from the row on. The second travels to the row whose window
starts there, as one row of an equi-join on the position. Both are running frames, and a row is neither
copied nor read again for every window that holds it. Whole blocks come from a table with a row per block.

A summary holds the number of values, their mean, the sum of squares around it, and the extremes. Summaries
merge without differences of large sums, so windows far from zero keep their digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .joins import null_safe_join
from .positions import Layout, add_positions, resolve

STATS = ("mean", "std", "max", "min")


def _summary(value: Column, over: WindowSpec | None = None) -> Column:
    """Summary of the values that are not null; without any, ``n`` is 0 and the rest null."""
    n, mean, spread, high, low = (f(value) if over is None else f(value).over(over) for f in (F.count, F.avg, F.var_pop, F.max, F.min))
    return F.struct(n.alias("n"), mean.alias("mean"), (spread * n).alias("m2"), high.alias("max"), low.alias("min"))


def _merged(parts: Sequence[Column]) -> dict[str, Column]:
    """Statistics of the union of summaries, any of which may be null; at least two of them."""
    counts = [F.coalesce(p["n"], F.lit(0)) for p in parts]
    n = reduce(lambda a, b: a + b, counts)
    mean = reduce(lambda a, b: a + b, (F.coalesce(c * p["mean"], F.lit(0.0)) for c, p in zip(counts, parts))) 
    mean = F.try_divide(mean, n)
    inside = (F.coalesce(p["m2"], F.lit(0.0)) for p in parts)
    between = (F.coalesce(c * F.pow(p["mean"] - mean, F.lit(2)), F.lit(0.0)) for c, p in zip(counts, parts))
    m2 = reduce(lambda a, b: a + b, [*inside, *between])
    return {
        "n": n,
        "mean": mean,
        "std": F.when(n > 1, F.sqrt(m2 / (n - 1))),
        "max": F.greatest(*[p["max"] for p in parts]),
        "min": F.least(*[p["min"] for p in parts]),
    }


def sliding(
    df: DataFrame,
    value: str,
    window: int,
    *,
    stats: Sequence[str] = STATS,
    include_current: bool = False,
    min_values: int | None = None,
    keys: Sequence[str] = (),
    ts: str = "ts",
    tie: Sequence[str] = (),
    layout: Layout | None = None,
) -> DataFrame:
    """``sliding_<stat>_<window>`` over the ``window`` rows before (or up to) each row.

    Null until the window holds ``min_values`` values that are not null (``window`` unless given; ``std`` needs
    two). Rows without a time stamp are left out. Rows of equal ``keys`` and ``ts`` keep the order of ``tie``.
    """
    back = window - 1 if include_current else window  # from the window's first row to the row itself
    if back < 1:
        raise ValueError("a sliding window needs a row besides the current one")
    needed = window if min_values is None else max(min_values, 1)
    columns = df.columns
    layout = resolve(df, keys, ts, layout, tie)
    size = min(back, max(layout.chunk_rows, 1))  # so a window never starts and ends in one block
    x = F.col(f"`{value}`").cast("double")
    rows = add_positions(df, keys, ts, tie=tie, layout=layout, position="__rn")
    rows = rows.withColumn("__block", F.call_function("div", F.col("__rn"), F.lit(size)))

    block = Window.partitionBy(*keys, "__block")
    upto = block.orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    onward = block.orderBy(F.col("__rn").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a running frame, read backwards
    ends = rows.withColumns({"__head": _summary(x, upto), "__tail": _summary(x, onward)})
    starts = ends.select(*keys, (F.col("__rn") + back).alias("__rn"), F.col("__tail").alias("__first"))
    joined = null_safe_join(ends.drop("__tail"), starts, [*keys, "__rn"])
    parts = [F.col("__first"), F.col("__head")]

    fewest, ragged = divmod(back, size)  # a window's first row lies so many blocks back, or one more
    if fewest > 1 or ragged:
        order = Window.partitionBy(*keys).orderBy("__block")
        table = rows.groupBy(*keys, "__block").agg(_summary(x).alias("__s"))
        reach = {"__few": fewest - 1, "__many": fewest}
        held = {name: F.collect_list("__s").over(order.rowsBetween(-k, -1)) for name, k in reach.items() if k}
        whole = table.withColumns(held).select(*keys, "__block", *[_pooled(F.col(name)).alias(name) for name in held])
        joined = null_safe_join(joined, whole, [*keys, "__block"])
        nearer = F.col("__few") if fewest > 1 else F.lit(None).cast(whole.schema["__many"].dataType)
        # the first row's place in its block tells which of the two it is
        parts.append(F.when(F.col("__rn") % size >= ragged, nearer).otherwise(F.col("__many")))

    result = _merged(parts)
    out = [F.when(result["n"] >= needed, result[s]).alias(f"sliding_{s}_{window}") for s in stats]
    return joined.select(*[F.col(f"`{c}`") for c in columns], *out)


def _pooled(summaries: Column) -> Column:
    """The summary of a list of them."""

    def total(of) -> Column:
        return F.aggregate(summaries, F.lit(0.0), lambda a, s: a + F.coalesce(of(s), F.lit(0.0)))

    n = total(lambda s: s["n"].cast("double"))
    mean = F.try_divide(total(lambda s: s["n"] * s["mean"]), n)
    m2 = total(lambda s: s["m2"]) + F.aggregate(
        summaries, F.lit(0.0), lambda a, s: a + F.coalesce(s["n"] * F.pow(s["mean"] - mean, F.lit(2)), F.lit(0.0))
    )
    extreme = [f(F.transform(summaries, lambda s: s[c])).alias(c) for f, c in ((F.array_max, "max"), (F.array_min, "min"))]
    return F.struct(n.cast("long").alias("n"), mean.alias("mean"), m2.alias("m2"), *extreme)
