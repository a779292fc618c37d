"""Streaming jobs with state per series: the last rows of each, and thresholds that move with what was seen.

The state lives in the stream's checkpoint, in the RocksDB state store, and goes on from there after a restart. Series are
dealt over the stream's tasks by their keys. Null keys are a series. NaN counts as null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.filters import last_rows
from .jobs import ALERT, LIVE_ROWS, NORMAL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Fixed value: deviations above the mean that raise an alert.
DEVIATIONS = 2.5


def use_state_store(spark: SparkSession) -> None:
    """The state store that jobs of this module need; set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _plain(value, kind: T.DataType):
    """A pandas cell as the state store takes it."""
    if value is None or value is pd.NaT or (isinstance(value, (float, np.floating)) and np.isnan(value)):
        return None
    if isinstance(kind, T.IntegralType):
        return int(value)
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if isinstance(value, np.generic) else value


# -- the last rows of every series --


class LastRows(StatefulProcessor):
    """A ring of ``n`` slots for each series: a row that comes in takes the slot of the row that leaves.

    Only slots that change are written. Each trigger that changes a series emits its whole ring with the number of
    rows seen so far.
    """

    def __init__(self, n: int, order: Sequence[str], schema: T.StructType, ttl_ms: int | None):
        self.n, self.order, self.schema, self.ttl_ms = n, list(order), schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", self.schema, self.ttl_ms)
        self.seen = handle.getValueState("seen", "n long")  # stays, so that views of a series always count up

    def _rank(self, row: tuple) -> tuple:
        """Later rows rank higher; a null ranks lowest, as it does in a batch."""
        cells = [row[self.schema.fieldNames().index(c)] for c in self.order]
        return tuple((c is not None, c if c is not None else 0) for c in cells)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {slot[0]: tuple(row) for slot, row in self.slots.iterator()}
        seen = self.seen.get()[0] if self.seen.exists() else 0
        changed: set[int] = set()
        names, kinds = self.schema.fieldNames(), [f.dataType for f in self.schema]
        for part in rows:
            seen += len(part)
            part = part.sort_values(self.order, na_position="first", kind="stable").tail(self.n)  # no other row of the part can stay
            for cells in part[names].itertuples(index=False, name=None):
                row = tuple(_plain(c, k) for c, k in zip(cells, kinds))
                if len(held) < self.n:
                    slot = next(s for s in range(self.n) if s not in held)  # rows that expired left gaps
                else:
                    slot = min(held, key=lambda s: self._rank(held[s]))
                    if self._rank(row) <= self._rank(held[slot]):
                        continue
                held[slot] = row
                changed.add(slot)
        for slot in changed:
            self.slots.updateValue((slot,), held[slot])
        self.seen.update((seen,))
        if changed:
            tail = sorted(held.values(), key=self._rank)
            yield pd.DataFrame({**dict(zip(self.keys, ([k] for k in key))), "seen": [seen], "tail": [[dict(zip(names, r)) for r in tail]]})

    def close(self) -> None:
        pass


def live_series(
    stream: DataFrame, *, keys: Sequence[str], n: int = LIVE_ROWS, ts: str = "ts", tie: Sequence[str] = (), salts: int = 1, ttl_ms: int | None = None
) -> DataFrame:
    """Stream of views: the series, how many rows it had so far (``seen``), and its last ``n`` rows (``tail``).

    ``salts`` splits each series over that many states by a hash of the row, for series that hold a large share of all rows;
    ``latest_tail`` puts them together. A row is forgotten ``ttl_ms`` after it came in; such a
    stream has to run on a processing-time trigger, as one that stops when all is read would never stop. Feed it from a source with a
    bounded trigger (``stream_files(files_per_batch=...)``).
    """
    taken = stream.columns
    others = [c for c in taken if c not in keys]
    schema = stream.select(*others).schema
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    salted = stream.withColumn("salt", F.pmod(F.xxhash64(*[F.col(c) for c in others]), F.lit(salts)).cast("int"))
    group = [*keys, "salt"]
    processor = LastRows(n, [ts, *tie], schema, ttl_ms)
    processor.keys = group
    out = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in salted.select(*group).schema]
        + [T.StructField("seen", T.LongType()), T.StructField("tail", T.ArrayType(schema))]
    )
    return salted.groupBy(*group).transformWithStateInPandas(processor, out, "Append", "ProcessingTime" if ttl_ms else "None")


def latest_tail(views: DataFrame, *, keys: Sequence[str], n: int = LIVE_ROWS, ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows of every series, from all views a sink has collected."""
    newest = views.groupBy(*keys, "salt").agg(F.max_by("tail", "seen").alias("tail"))
    rows = newest.select(*keys, F.inline("tail"))
    return last_rows(rows, n, keys=keys, ts=ts, tie=tie)


# -- thresholds from what was seen --


class Moments(StatefulProcessor):
    """Count, mean and sum of squared deviations of a series; a trigger's rows are judged by what came before each."""

    def __init__(self, value: str, order: Sequence[str], deviations: float):
        self.value, self.order, self.deviations = value, list(order), deviations

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows), ignore_index=True).sort_values(self.order, na_position="first", kind="stable")
        n0, mean0, m20 = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        v = part[self.value].to_numpy(float)
        there = ~np.isnan(v)
        origin = mean0 if n0 else (float(v[there][0]) if there.any() else 0.0)
        d = np.where(there, v - origin, 0.0)
        n = n0 + np.cumsum(there)
        # the state's own sums about the origin are 0 and m2, as the origin is its mean
        s, s2 = np.cumsum(d), m20 + np.cumsum(d * d)
        before_n, before_s, before_s2 = n - there, s - d, s2 - d * d
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = origin + before_s / before_n
            sd = np.sqrt(np.maximum(before_s2 - before_s**2 / before_n, 0) / (before_n - 1))
        limit = np.where(before_n > 1, mean + self.deviations * sd, np.nan)
        if n[-1]:
            last = int(n[-1])
            self.state.update((last, float(origin + s[-1] / last), float(max(s2[-1] - s[-1] ** 2 / last, 0.0))))
        told = {"predicted": np.where(before_n > 0, mean, np.nan), "threshold": limit, "abs_error": np.abs(v - np.where(before_n > 0, mean, np.nan))}
        status = np.where(v > limit, ALERT, NORMAL)  # without a threshold there is no alert
        yield part.assign(**{c: pd.Series(x, part.index).astype(object).where(~np.isnan(x), None) for c, x in told.items()}, status=status)

    def close(self) -> None:
        pass


def adaptive_monitor(
    stream: DataFrame, *, keys: Sequence[str], value: str = "actual", ts: str = "ts", tie: Sequence[str] = (), deviations: float = DEVIATIONS
) -> DataFrame:
    """Status of every reading against mean plus ``deviations`` standard deviations of the series' readings before it.

    Adds ``predicted`` (the mean so far), ``threshold``, ``abs_error`` and ``status``. Readings of one trigger count in the order
    of ``ts`` and ``tie``; later triggers come after them whatever their time. A series needs two readings for a threshold; null
    readings are not counted. A task holds one series' rows of one trigger, so bound the trigger at its source.
    """
    added = [T.StructField(c, T.DoubleType()) for c in ("predicted", "threshold", "abs_error")] + [T.StructField("status", T.StringType())]
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in stream.schema] + added)
    return stream.groupBy(*keys).transformWithStateInPandas(Moments(value, [ts, *tie], deviations), out, "Append", "None")
