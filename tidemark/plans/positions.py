"""Ordered windows that never put a whole series into one task.

A window ordered by time needs its rows together. For one global series, or a series that holds a
large share of all rows, ``partitionBy(keys)`` would send all of them to one task. Three patterns
replace it:

* positions: count rows per time slice, prefix-sum the small slice table, and hand every slice its
  starting position as one marker row that is sorted in front of the slice's rows;
* halo chunks: cut the series into chunks of consecutive positions and copy to each chunk the few
  neighbouring rows its frames reach into;
* carry: hand every slice the running value that enters it, again as a marker row.

Rows are shuffled once for positions or carry, and once more for halo chunks. Slices and chunks
are functions of the data alone, so a task that is run again yields the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
HOUR = 3_600 * SECOND
DAY = 24 * HOUR
WHOLE = 1 << 62


@dataclass(frozen=True)
class Layout:
    """How an ordered operator partitions its rows.

    ``keyed``: every series is short, one window partition per key.
    ``sliced``: series are cut into time slices of ``width`` microseconds (for positions and carry)
    and chunks of ``chunk_rows`` consecutive rows (for frames). ``tie_bits`` splits one instant
    further by the hash that orders equal time stamps.
    """

    mode: str = "sliced"
    width: int = DAY
    chunk_rows: int = 65_536
    tie_bits: int = 0


def every(interval_us: int, rows_per_slice: int = 100_000, chunk_rows: int = 65_536) -> Layout:
    """Layout of a regular series: one row per interval bounds the rows in a slice."""
    return Layout("sliced", interval_us * rows_per_slice, chunk_rows)


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 for either timestamp type, whatever the session's time zone."""
    t = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        seconds = (F.extract(F.lit("SECONDS"), t) * SECOND).cast("long")
        return F.unix_date(F.to_date(t)).cast("long") * DAY + F.hour(t).cast("long") * HOUR + F.minute(t).cast("long") * (60 * SECOND) + seconds
    return F.unix_micros(t.cast("timestamp"))


def _div(micros: Column, width: int) -> Column:
    return F.call_function("div", micros, F.lit(width))


def _with_order(df: DataFrame, ts: str, tie: Sequence[str], layout: Layout) -> tuple[DataFrame, list[str]]:
    """Order columns. ``tie`` tells equal time stamps apart; an overfull instant orders by its hash first, without ``tie`` by the row's."""
    if layout.tie_bits:
        return df.withColumn("__tie", F.xxhash64(*(tie or df.columns))), [ts, "__tie", *tie]
    return df, [ts, *tie]


def _slices(df: DataFrame, ts: str, layout: Layout) -> tuple[DataFrame, list[str]]:
    out = df.withColumn("__slice", _div(epoch_micros(df, ts), layout.width))
    if layout.tie_bits:
        return out.withColumn("__sub", F.shiftright("__tie", 64 - layout.tie_bits)), ["__slice", "__sub"]
    return out, ["__slice"]


def choose_layout(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    *,
    tie: Sequence[str] = (),
    max_rows: int = 1_000_000,
    chunk_rows: int = 65_536,
) -> Layout:
    """Measure the largest series and slice, and pick a layout that keeps groups below ``max_rows``.

    Reads only the keys and the time column; partial aggregation keeps the shuffle to one row per
    key and hour.
    """
    micros = epoch_micros(df, ts)
    hourly = df.where(F.col(ts).isNotNull()).groupBy(*keys, _div(micros, HOUR).alias("__h")).agg(F.count("*").alias("__c"))
    levels = [(WHOLE, None), (30 * DAY, 30 * 24), (DAY, 24), (HOUR, 1)]
    parts = []
    for width, hours in levels:
        group = [*keys] if hours is None else [*keys, _div(F.col("__h"), hours).alias("__g")]
        parts.append(
            hourly.groupBy(*group).agg(F.sum("__c").alias("__c")).agg(F.max("__c").alias("m")).withColumn("w", F.lit(width))
        )
    probe = parts[0]
    for p in parts[1:]:
        probe = probe.unionByName(p)
    largest = {r["w"]: r["m"] or 0 for r in probe.collect()}
    if keys and largest[WHOLE] <= max_rows:
        return Layout("keyed", WHOLE, chunk_rows)
    for width, _ in levels:
        if largest[width] <= max_rows:
            return Layout("sliced", width, chunk_rows)
    for width in (60 * SECOND, SECOND, 1_000, 1):
        top = df.groupBy(*keys, _div(micros, width).alias("__g")).count().agg(F.max("count")).first()[0] or 0
        if top <= max_rows:
            return Layout("sliced", width, chunk_rows)
    return Layout("sliced", 1, chunk_rows, tie_bits=min(20, (top // max_rows).bit_length() + 1))


def resolve(df: DataFrame, keys: Sequence[str], ts: str, layout: Layout | None, tie: Sequence[str] = ()) -> Layout:
    layout = layout or choose_layout(df, keys, ts, tie=tie)
    if layout.mode == "keyed" and not keys:
        raise ValueError("a keyed layout needs keys: one global series must be sliced")
    return layout


def _marked(
    rows: DataFrame, markers: DataFrame, keys: Sequence[str], slices: Sequence[str], order: Sequence[str], payload: Sequence[str]
) -> tuple[DataFrame, WindowSpec]:
    """Union slice markers in front of the rows of their slice; returns rows and the ordered window.

    What a row carries travels in the struct ``__row`` and what a marker carries in ``__in``: a
    union padded with one null per column would make constraint propagation grow with the square of
    the table's width.
    """
    sort = [c for c in order if c not in keys]
    carried = [c for c in markers.columns if c not in keys and c not in slices]
    packed = rows.select(*keys, *slices, *sort, F.struct(F.lit(1).alias("__mark"), *payload).alias("__row"))
    marks = markers.select(*keys, *slices, F.struct(*carried).alias("__in"))
    both = packed.unionByName(marks, allowMissingColumns=True)
    # False sorts first: the marker row has no payload.
    return both, Window.partitionBy(*keys, *slices).orderBy(F.col("__row").isNotNull(), *order)


def _unpacked(columns: Sequence[str], payload: Sequence[str]) -> list[Column]:
    return [F.col("__row")[c].alias(c) if c in payload else F.col(c) for c in columns]


def add_positions(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    *,
    tie: Sequence[str] = (),
    layout: Layout | None = None,
    position: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Zero-based position of every row in its series, ordered by ``ts`` and ``tie``.

    ``keys``, ``ts`` and ``tie`` together should identify a row; without ``tie`` the order of equal
    time stamps is left to Spark.

    ``total`` names an optional column with the number of rows of the series. Rows without a time
    stamp have no position and are left out.
    """
    columns = df.columns
    layout = resolve(df, keys, ts, layout, tie)
    rows, order = _with_order(df.where(F.col(ts).isNotNull()), ts, tie, layout)
    out = [*columns, position] + ([total] if total else [])
    if layout.mode == "keyed":
        rows = rows.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
        if total:
            rows = rows.withColumn(total, F.count("*").over(Window.partitionBy(*keys)))
        return rows.select(*out)
    rows, slices = _slices(rows, ts, layout)
    counts = rows.groupBy(*keys, *slices).agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*keys).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    markers = counts.select(
        *keys,
        *slices,
        F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"),
        F.sum("__c").over(Window.partitionBy(*keys)).alias("__total"),
    )
    payload = [c for c in columns if c not in keys and c not in order]
    both, w = _marked(rows, markers, keys, slices, order, payload)
    entering = F.first("__in").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = both.withColumns({"__first": entering, "__r": F.row_number().over(w)}).where(F.col("__row").isNotNull())
    extra = [(F.col("__first.__start") + F.col("__r") - 2).alias(position)]
    if total:
        extra.append(F.col("__first.__total").alias(total))
    return placed.select(*_unpacked(columns, payload), *extra)


class Frames:
    """Window specifications handed to a builder: it never sees how the rows are partitioned."""

    def __init__(self, spec: WindowSpec):
        self.order = spec

    def rows(self, lo: int, hi: int) -> WindowSpec:
        return self.order.rowsBetween(lo, hi)


def apply_windows(
    df: DataFrame,
    build: Callable[[Frames], Mapping[str, Column]],
    *,
    before: int,
    after: int = 0,
    keys: Sequence[str] = (),
    ts: str = "ts",
    tie: Sequence[str] = (),
    layout: Layout | None = None,
    position: str | None = None,
    keep_position: bool = False,
) -> DataFrame:
    """Add the columns of ``build``, whose frames reach at most ``before`` rows back and ``after`` ahead.

    ``position`` names an existing position column, so several operators can share one pass.
    """
    columns = df.columns
    layout = resolve(df, keys, ts, layout, tie)
    pos = position or "rn"
    if layout.mode == "keyed" and not keep_position:
        rows, order = _with_order(df, ts, tie, layout)
        order = [position] if position else order
        built = build(Frames(Window.partitionBy(*keys).orderBy(*order)))
        return rows.withColumns(dict(built)).select(*columns, *built)
    rows = df if position else add_positions(df, keys, ts, tie=tie, layout=layout, position=pos)
    kept = columns if position or not keep_position else [*columns, pos]
    if layout.mode == "keyed":
        built = build(Frames(Window.partitionBy(*keys).orderBy(pos)))
        return rows.withColumns(dict(built)).select(*kept, *built)
    haloed = halo_chunks(rows, before=before, after=after, chunk_rows=layout.chunk_rows, position=pos)
    built = build(Frames(Window.partitionBy(*keys, "__chunk").orderBy(pos)))
    return haloed.withColumns(dict(built)).where("__own").select(*kept, *built)


def halo_chunks(df: DataFrame, *, before: int, after: int, chunk_rows: int, position: str = "rn") -> DataFrame:
    """Copy each row to every chunk that needs it: adds ``__chunk`` and ``__own``.

    The copy factor is ``1 + (before + after) / chunk_rows``.
    """
    size = max(chunk_rows, before + after, 1)
    pos = F.col(position)
    targets = F.sequence(_div(F.greatest(pos - after, F.lit(0)), size), _div(pos + before, size))
    return df.withColumn("__chunk", F.explode(targets)).withColumn("__own", F.col("__chunk") == _div(pos, size))


def carry_markers(
    rows: DataFrame,
    keys: Sequence[str],
    slices: Sequence[str],
    per_slice: Mapping[str, Column],
    carried: Callable[[WindowSpec, WindowSpec], Mapping[str, Column]],
) -> DataFrame:
    """Slice table of the carry pattern.

    ``per_slice`` aggregates each slice; ``carried`` receives a window over the earlier slices of
    the series and one over all of its slices.
    """
    table = rows.groupBy(*keys, *slices).agg(*[c.alias(n) for n, c in per_slice.items()])
    whole = Window.partitionBy(*keys).orderBy(*slices)
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table.select(*keys, *slices, *[c.alias(n) for n, c in carried(earlier, everything).items()])


def fill_forward_back(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    ts: str = "ts",
    *,
    tie: Sequence[str] = (),
    layout: Layout | None = None,
) -> DataFrame:
    """Replace nulls by the last earlier value, and leading nulls by the first value of the series."""
    layout = resolve(df, keys, ts, layout, tie)
    rows, order = _with_order(df.where(F.col(ts).isNotNull()), ts, tie, layout)
    names = df.columns
    if layout.mode == "keyed":
        w = Window.partitionBy(*keys).orderBy(*order)
        filled = {
            c: F.coalesce(
                F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                F.first(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            )
            for c in columns
        }
        return rows.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in names])
    rows, slices = _slices(rows, ts, layout)
    moment = F.struct(*order)
    per_slice: dict[str, Column] = {}
    for c in columns:
        seen = F.when(F.col(c).isNotNull(), moment)
        per_slice[f"__last_{c}"] = F.max_by(c, seen)
        per_slice[f"__first_{c}"] = F.min_by(c, seen)

    def carried(earlier: WindowSpec, everything: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in columns:
            out[f"__in_{c}"] = F.last(f"__last_{c}", ignorenulls=True).over(earlier)
            out[f"__head_{c}"] = F.first(f"__first_{c}", ignorenulls=True).over(everything)
        return out

    payload = [c for c in names if c not in keys and c not in order]
    both, w = _marked(rows, carry_markers(rows, keys, slices, per_slice, carried), keys, slices, order, payload)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    latest = {f"__seen_{c}": F.last(F.col("__row")[c], ignorenulls=True).over(upto) for c in columns}
    placed = both.withColumns({"__first": F.first("__in").over(upto), **latest}).where(F.col("__row").isNotNull())
    filled = {
        c: F.coalesce(f"__seen_{c}", F.col("__first")[f"__in_{c}"], F.col("__first")[f"__head_{c}"]).alias(c) for c in columns
    }
    return placed.select(*[filled.get(c, old) for c, old in zip(names, _unpacked(names, payload))])


def running_sums(
    df: DataFrame,
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
    ts: str = "ts",
    *,
    tie: Sequence[str] = (),
    layout: Layout | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Running totals from the start of the series; null terms count as nothing."""
    layout = resolve(df, keys, ts, layout, tie)
    columns = df.columns
    rows, order = _with_order(df.where(F.col(ts).isNotNull()), ts, tie, layout)
    rows = rows.withColumns({f"__term_{n}": c for n, c in sums.items()})
    hi = 0 if include_current else -1
    if layout.mode == "keyed":
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
        return rows.select(*columns, *[F.coalesce(F.sum(f"__term_{n}").over(w), F.lit(0)).alias(n) for n in sums])
    rows, slices = _slices(rows, ts, layout)
    per_slice = {f"__part_{n}": F.sum(f"__term_{n}") for n in sums}

    def carried(earlier: WindowSpec, everything: WindowSpec) -> dict[str, Column]:
        return {f"__in_{n}": F.coalesce(F.sum(f"__part_{n}").over(earlier), F.lit(0)) for n in sums}

    payload = [c for c in rows.columns if c not in (*keys, *order, *slices)]
    both, w = _marked(rows, carry_markers(rows, keys, slices, per_slice, carried), keys, slices, order, payload)
    spec = w.rowsBetween(Window.unboundedPreceding, hi)
    inside = {f"__run_{n}": F.sum(F.col("__row")[f"__term_{n}"]).over(spec) for n in sums}
    first = F.first("__in").over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumns({"__first": first, **inside}).where(F.col("__row").isNotNull())
    totals = [(F.col("__first")[f"__in_{n}"] + F.coalesce(f"__run_{n}", F.lit(0))).alias(n) for n in sums]
    return placed.select(*_unpacked(columns, payload), *totals)
