"""Per-key state that lives between batches: counters, and groups that late rows reopen.

State is kept by Spark's state store under the query's checkpoint, so a restarted query goes
on where it stopped.  ``Counter`` and ``GroupKeeper`` serve a bin of keys in one call: keys are
dealt by hash to ``BINS`` bins, so their cost follows the rows and not the number of keys.  A bin's
rows of one batch meet in one task, and ``GroupKeeper`` reads the rows held in the slots that they
fall into; a single key with more rows than a task can hold belongs to the split scans of
``functions.scans``.  Event-time timers free the state of keys that have been idle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from swapledger.sources.keyed import schema_with

#: Bins of keys; each has one state and one call per batch.
BINS = 256
#: Parts of a bin whose rows ``GroupKeeper`` reads and writes on their own.
SLOTS = 256
#: Rows that ``GroupKeeper`` gives out at once.
_ROWS = 100_000
#: Moment of a time that is missing, and of what never falls due.
_NO_TIME, _NEVER = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def row_store(spark: SparkSession):
    """Queries started inside use the state store that typed state needs."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _reschedule(handle: StatefulProcessorHandle, before: int | None, after: int | None) -> None:
    if before == after:
        return
    if before is not None:
        handle.deleteTimer(before)
    if after is not None:
        handle.registerTimer(after)


def _named(frames: Iterator[pd.DataFrame], names: list[str]) -> pd.DataFrame:
    """A key's rows of one batch under their own names; names with a leading underscore do not arrive as such."""
    return pd.concat(list(frames), ignore_index=True).set_axis(names, axis=1)


class Counter(StatefulProcessor):
    """Numbers the rows of each key of a bin from 0 on, in ``order`` inside a batch, batch after batch."""

    def __init__(self, names: Sequence[str], key: T.StructField, order: Sequence[str], at: str, name: str, idle_ms: int):
        self.names, self.key, self.kind = list(names), key.name, key.dataType
        self.order, self.at, self.name, self.idle_ms = list(order), at, name, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        long = T.LongType()
        self.seen = handle.getValueState("seen", T.StructType(
            [T.StructField(n, T.ArrayType(t)) for n, t in (("keys", self.kind), ("n", long), ("due", long))] + [T.StructField("timer", long)]))

    def _state(self) -> tuple[dict, int | None]:
        """Count and last moment of each key, and the timer."""
        if not self.seen.exists():
            return {}, None
        keys, n, due, timer = self.seen.get()
        return dict(zip(keys, zip(n, due))), timer

    def _store(self, seen: dict) -> int:
        timer = min(due for _, due in seen.values())
        self.seen.update((list(seen), [n for n, _ in seen.values()], [due for _, due in seen.values()], timer))
        return timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _named(rows, self.names).sort_values(self.order, kind="stable", ignore_index=True)
        codes, keys = pd.factorize(frame[self.key], use_na_sentinel=False)
        # Rows without a key have a bin of their own.
        keys = [None] if frame[self.key].isna().all() else keys.tolist()
        seen, timer = self._state()
        before = np.array([seen.get(k, (0, 0))[0] for k in keys], dtype=np.int64)
        count, last = np.bincount(codes, minlength=len(keys)), frame[self.at].groupby(codes).max()
        for i, k in enumerate(keys):
            n, due = seen.get(k, (0, 0))
            seen[k] = n + int(count[i]), max(int(last[i]) + self.idle_ms, due)
        _reschedule(self.handle, timer, self._store(seen))
        frame[self.name] = before[codes] + frame.groupby(codes).cumcount().to_numpy(dtype=np.int64)
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Idle keys lose their counter, and a later row would start at 0 again.
        now = timerValues.getCurrentWatermarkInMs()
        seen = {k: (n, due) for k, (n, due) in self._state()[0].items() if due > now}
        if seen:
            self.handle.registerTimer(self._store(seen))
        else:
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


class GroupKeeper(StatefulProcessor):
    """Holds the rows of each key of a bin and gives out all rows of a key whenever new ones arrive, late or not.

    The rows lie in the slots of the bin, each slot one packed table, so a batch reads and writes
    the slots of its own keys only.  A missing key is a key of its own; rows without a time keep
    their key no longer than its other rows, or for ever if it has no others.
    """

    def __init__(self, given: Sequence[str], schema: T.StructType, key: str, ident: Sequence[str], at: str, slot: str, idle_ms: int, slots: int = SLOTS):
        self.given, self.schema, self.key, self.ident = list(given), schema, key, list(ident)
        self.at, self.slot, self.idle_ms, self.slots = at, slot, idle_ms, slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Times arrive without a zone, as pandas has them, and leave as they came.
        kind = lambda t: pa.timestamp("ns") if isinstance(t, T.TimestampType) else to_arrow_type(t)
        self.packed = pa.schema([(f.name, kind(f.dataType)) for f in self.schema.fields])
        self.rows = handle.getMapState("rows", "slot int", "packed binary")
        self.timer = handle.getValueState("timer", "due array<long>, timer long")

    def _due(self) -> tuple[np.ndarray, int | None]:
        """When the first key of each slot falls due, and the timer."""
        if not self.timer.exists():
            return np.full(self.slots, _NEVER), None
        due, timer = self.timer.get()
        return np.array(due, np.int64), timer

    def _held(self, slots: np.ndarray) -> tuple[list[pa.RecordBatch], np.ndarray]:
        """The rows held in some slots, and the slot of each row."""
        found = [(s, x[0]) for s in slots.tolist() if (x := self.rows.getValue((s,))) is not None]
        held = [pa.ipc.read_record_batch(pa.py_buffer(bytes(x)), self.packed) for _, x in found]
        return held, np.repeat(np.array([s for s, _ in found], np.int64), [b.num_rows for b in held])

    def _keys(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """A number for each row's key, and the moment from which each key is idle."""
        codes, keys = pd.factorize(rows.column(self.key).to_pandas(integer_object_nulls=True), use_na_sentinel=False)
        last = np.full(len(keys), _NO_TIME)
        np.maximum.at(last, codes, pc.fill_null(rows.column(self.at), _NO_TIME).to_numpy())
        return codes, np.where(last == _NO_TIME, _NEVER, last + self.idle_ms)

    def _store(self, rows: pa.Table, slot: np.ndarray, due: np.ndarray, slots: np.ndarray) -> tuple[int | None, int | None]:
        """Replace what some slots hold by these rows; the timer before and after, none if no key falls due."""
        first, before = self._due()
        order = np.argsort(slot, kind="stable")
        rows, slot, due = rows.take(order).combine_chunks(), slot[order], due[order]
        for s, a, b in zip(slots.tolist(), np.searchsorted(slot, slots).tolist(), np.searchsorted(slot, slots, "right").tolist()):
            first[s] = due[a:b].min(initial=_NEVER)
            if a < b:
                self.rows.updateValue((s,), (rows.slice(a, b - a).to_batches()[0].serialize().to_pybytes(),))
            else:
                self.rows.removeKey((s,))
        after = None if (least := int(first.min())) == _NEVER else least
        self.timer.update((first.tolist(), after))
        return before, after

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _named(rows, self.given)
        new = pa.RecordBatch.from_arrays([pa.array(frame[f.name], f.type, from_pandas=True) for f in self.packed], schema=self.packed)
        held, slot = self._held(np.unique(frame[self.slot].to_numpy(np.int64)))
        known, slot = len(slot), np.concatenate([slot, frame[self.slot].to_numpy(np.int64)])
        both = pa.Table.from_batches([*held, new]).combine_chunks()
        # Rows that are held come first, so it is their repeats that go.
        ident = both.select([*dict.fromkeys([self.key, *self.ident])]).to_pandas(integer_object_nulls=True)
        once = ~ident.duplicated().to_numpy()
        both, slot = both.filter(pa.array(once)), slot[once]
        if len(slot) == known:
            return
        codes, due = self._keys(both)
        changed = np.unique(slot[known:])
        kept = np.isin(slot, changed)
        _reschedule(self.handle, *self._store(both.filter(pa.array(kept)), slot[kept], due[codes[kept]], changed))
        grown = np.zeros(len(due), bool)
        grown[codes[known:]] = True
        whole = both.filter(pa.array(grown[codes]))
        for a in range(0, whole.num_rows, _ROWS):
            yield whole.slice(a, _ROWS).to_pandas(integer_object_nulls=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Idle keys lose their rows, and a later row would begin a group anew.
        now = timerValues.getCurrentWatermarkInMs()
        slots = np.flatnonzero(self._due()[0] < now)
        held, slot = self._held(slots)
        rows = pa.Table.from_batches(held, self.packed)
        codes, due = self._keys(rows)
        kept = due[codes] >= now
        # The timer that called is gone already.
        _, after = self._store(rows.filter(pa.array(kept)), slot[kept], due[codes[kept]], slots)
        _reschedule(self.handle, None, after)
        yield from ()

    def close(self) -> None:
        pass


def _bin(key: str) -> Column:
    """The bin of a key; rows without one have their own, so that a bin's keys are all there or all missing."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BINS))).cast("int")


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermark on ``time``, and the same moment in milliseconds as ``_ms`` for timers."""
    at = F.col(time).cast("timestamp")
    return stream.withColumn(time, at).withColumn("_ms", F.unix_millis(F.col(time))).withWatermark(time, delay)


def numbered(
    stream: DataFrame, key: str, order: Sequence[str], time: str, name: str, delay: str = "1 day", idle: str = "365 days",
) -> DataFrame:
    """The stream's rows with their 0-based ordinal per key, in order of arrival.

    Rows of one batch count in ``order``.  Rows behind the watermark are dropped, as in any
    event-time operator, so ``delay`` has to cover how late rows may come; a key without rows
    for ``idle`` of event time loses its counter.  Keys and times must be non-null.
    """
    timed = _timed(stream, time, delay).withColumn("_bin", _bin(key))
    counter = Counter(timed.columns, timed.schema[key], order, "_ms", name, _millis(idle))
    out = schema_with(timed.schema, name, T.LongType())
    return timed.groupBy("_bin").transformWithStateInPandas(counter, out, "append", "eventTime").drop("_ms", "_bin")


def whole_groups(stream: DataFrame, key: str, ident: Sequence[str], time: str, delay: str, idle: str) -> DataFrame:
    """For each batch, all rows so far of the keys that got new ones; repeats of ``ident`` count once.

    Only the slots of touched keys (one in ``BINS`` x ``SLOTS``) are read from the state, however
    long the log has become.  A key's state goes once the watermark has passed its last row by
    ``idle``; ``delay`` decides how late a row may be.  Times must be non-null.
    """
    # Times are held as whole microseconds; the watermark column itself stays outside the state.
    kept = _timed(stream, time, delay).withColumn("_us", F.unix_micros(F.col(time)))
    state = T.StructType([f for f in kept.schema.fields if f.name != time])
    dealt = kept.withColumns({"_bin": _bin(key), "_slot": F.pmod(F.xxhash64(key, F.lit(BINS)), F.lit(SLOTS)).cast("int")})
    keeper = GroupKeeper(dealt.columns, state, key, ident, "_ms", "_slot", _millis(idle))
    out = dealt.groupBy("_bin").transformWithStateInPandas(keeper, state, "update", "eventTime")
    return out.withColumn(time, F.timestamp_micros("_us")).select(*stream.columns)


def _millis(length: str) -> int:
    return int(pd.Timedelta(length) / pd.Timedelta(milliseconds=1))
