"""Exact quantiles by histogram refinement.

Exact percentile aggregates hold every distinct value of a group in one buffer, and window ranks
sort a whole group in one task. Here each round counts values in equal-width bins of a bracket and
keeps the bin that contains the wanted rank, until the bracket holds one value or few enough rows
to sort. Rounds only scan and partially aggregate; what moves is one row per group, rank and bin.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe_join
from .session import materialize

MAX_ROUNDS = 80
# Brackets of up to this many groups and ranks are steered from the driver; more stay in tables.
DRIVER_ROWS = 5_000
# A bracket with at most this many rows is sorted.
SORT_ROWS = 200_000


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    *,
    bins: int = 4096,
    sort_rows: int = SORT_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles per group: columns ``by``, ``prob``, ``quantile``.

    Null and NaN values are ignored.
    """
    spark = df.sparkSession
    keys = list(by) or ["__all"]
    data = df if by else df.withColumn("__all", F.lit(0))
    v = F.col(value).cast("double")
    data = data.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    spans = data.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    few = spans.limit(DRIVER_ROWS + 1).toArrow()
    if few.num_rows * len(probs) <= DRIVER_ROWS:
        spans = spark.createDataFrame(few, spans.schema)

        def settle(rows: DataFrame) -> tuple[DataFrame, bool]:
            got = rows.toArrow()
            wide = pc.and_(pc.less(got["lo"], got["hi"]), pc.greater(got["c"], sort_rows))
            return spark.createDataFrame(got, rows.schema), pc.any(wide).as_py() or False
    else:
        spans = materialize(spans, "spans")

        def settle(rows: DataFrame) -> tuple[DataFrame, bool]:
            table = materialize(rows, "brackets")
            return table, not table.where((F.col("lo") < F.col("hi")) & (F.col("c") > sort_rows)).isEmpty()

    targets = spans.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    targets = targets.withColumn("h", F.col("prob") * (F.col("n") - 1))
    ranked = targets.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h")))))
    start = ranked.select(*keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("c"))
    active, open_left = settle(start.distinct())
    done: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        if not open_left:
            break
        finished = (F.col("lo") == F.col("hi")) | (F.col("c") <= sort_rows)
        done.append(active.where(finished))
        active, open_left = settle(_narrow(data, _brackets(active.where(~finished), keys), keys, bins))
    else:
        raise RuntimeError("quantile refinement did not converge")
    found = _sorted_pick(data, reduce(DataFrame.unionByName, [*done, active]), keys)
    out = null_safe_join(ranked, found, [*keys, "rank"]).groupBy(*keys, "prob")
    share = F.first(F.col("h") - F.floor("h"))
    return out.agg((F.min("v") + (F.max("v") - F.min("v")) * share).alias("quantile")).select(*by, "prob", "quantile")


def _brackets(active: DataFrame, keys: Sequence[str]) -> DataFrame:
    return active.groupBy(*keys, "lo", "hi", "below").agg(F.collect_set("rank").alias("ranks"))


def _sorted_pick(data: DataFrame, active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values at the wanted ranks: known where the bracket is one value, else from its few sorted rows."""
    known = active.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))
    brackets = _brackets(active.where("lo < hi"), keys)
    hit = null_safe_join(data, brackets, keys, "inner").where("__v BETWEEN lo AND hi")
    order = Window.partitionBy(*keys, "lo", "hi", "below").orderBy("__v")
    placed = hit.withColumn("rank", F.col("below") + F.row_number().over(order) - 1)
    return known.unionByName(placed.where(F.array_contains("ranks", F.col("rank"))).select(*keys, "rank", F.col("__v").alias("v")))


def _narrow(data: DataFrame, brackets: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Count each bracket in equal bins and keep, per rank, the bin that holds it."""
    hit = null_safe_join(data, brackets, keys, "inner").where("__v BETWEEN lo AND hi")
    width = F.col("hi") / bins - F.col("lo") / bins
    at = F.least(F.floor((F.col("__v") - F.col("lo")) / width), F.lit(bins - 1))
    # Neighbouring doubles leave no width: split them into the lowest value and the rest.
    bin_ = F.when(width > 0, at).otherwise((F.col("__v") > F.col("lo")).cast("long"))
    counted = hit.groupBy(*keys, "lo", "hi", "below", "ranks", bin_.alias("bin")).agg(
        F.count("*").alias("c"), F.min("__v").alias("lo2"), F.max("__v").alias("hi2")
    )
    # At most `bins` rows per bracket, so this window stays small.
    w = Window.partitionBy(*keys, "lo", "hi", "below").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("below") + F.coalesce(F.sum("c").over(w), F.lit(0))
    return (
        counted.withColumn("start", first)
        .withColumn("rank", F.explode("ranks"))
        .where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("c")))
        .select(*keys, "rank", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("start").alias("below"), "c")
    )
