"""The monitoring task on record streams.

`windowed` keeps the last `width` records of every object and emits the features
of the current window for every record; scoring a stream is the same stateless
expression as in batch; `sustained` counts consecutive alerts. State per object
is bounded by the window width, whatever the history's length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from driftline.session import ensure_checkpoint_dir


def stateful_session(spark: SparkSession) -> SparkSession:
    """Stateful operators keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def new_files(spark: SparkSession, path: str, schema: T.StructType, *, pattern: str = "*",
              per_trigger: int | None = None) -> DataFrame:
    """Stream of the files in a folder; the checkpoint remembers which ones were read."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def deduplicated(stream: DataFrame, key: Sequence[str], time: str, delay: str = "30 days") -> DataFrame:
    """One record per key within the watermark delay, as with appends in batch."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def _window_values(x: np.ndarray) -> np.ndarray:
    """Mean, deviation, extremes, first and second step, slope and late/early ratio of one channel in every row of windows."""
    d1 = np.diff(x, axis=1)
    d2 = np.diff(d1, axis=1)
    i = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2.0
    mid = x.shape[1] // 2
    return np.column_stack([x.mean(1), x.std(1), x.min(1), x.max(1), d1.mean(1), d1.std(1), d2.mean(1) if d2.shape[1] else np.zeros(len(x)),
                            x @ i / (i @ i), x[:, mid:].mean(1) / (np.abs(x[:, :mid].mean(1)) + 1e-10)])


WINDOW_NAMES = ["mean", "std", "min", "max", "d1_mean", "d1_std", "d2_mean", "slope", "ratio"]
_SLAB = 8_192                       # windows whose values are worked out at a time


class _Windows(StatefulProcessor):
    """Last `width` records per object, in time order."""

    def __init__(self, key: str, time: str, channels: Sequence[str], width: int):
        self._key, self._time, self._channels, self._width = key, time, list(channels), width

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value, so that an object costs one read and one write: counts, and the held records as packed doubles
        self._state = handle.getValueState("state", T.StructType([
            T.StructField("seen", T.LongType()), T.StructField("dropped", T.LongType()), T.StructField("held", T.BinaryType())]))

    def _frame(self, key, win: np.ndarray, late: np.ndarray, dropped: np.ndarray, views: np.ndarray) -> pd.DataFrame:
        """Features of windows (windows, columns, width), one array a window: a column costs as much as a few dozen rows."""
        values = np.hstack([_window_values(np.ascontiguousarray(views[:, j])) for j in range(1, views.shape[1])])
        return pd.DataFrame({self._key: np.full(len(views), key[0]), "win": win, "t_end": views[:, 0, -1], "late": late, "dropped": dropped, "_values": list(values)}, copy=False)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, dropped, packed = self._state.get() or (0, 0, b"")
        held = np.frombuffer(packed, float).reshape(-1, len(self._channels) + 1)
        # an object's rows of one micro-batch come in several Arrow batches, in no order
        new = np.concatenate([np.column_stack([pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in (self._time, *self._channels)]) for pdf in rows])
        new = new[np.argsort(new[:, 0], kind="stable")]
        n_late = int((new[:, 0] < held[-1, 0]).sum()) if len(held) else 0                       # they come first
        ended = []                                      # win, dropped, window of each late record that is used
        for rec in new[:n_late]:
            if len(held) >= self._width and rec[0] < held[0, 0]:
                dropped += 1                           # older than everything still held
                continue
            seen += 1
            held = np.vstack([held, rec])
            held = held[np.argsort(held[:, 0], kind="stable")][-self._width:]
            if len(held) == self._width:
                ended.append((seen - self._width, dropped, held.T))
        n_ended = len(ended)
        win, lost, views = (np.array(x) for x in zip(*ended)) if ended else (np.zeros(0, int), np.zeros(0, int), np.zeros((0, new.shape[1], self._width)))
        # the others in order: windows end with each of them
        new = new[n_late:]
        before = held[-(self._width - 1):] if self._width > 1 else held[:0]
        whole = np.vstack([before, new])
        if len(new) and len(whole) >= self._width:
            first = seen - len(before)
            views = np.concatenate([views, np.lib.stride_tricks.sliding_window_view(whole, self._width, axis=0)]) if n_ended else np.lib.stride_tricks.sliding_window_view(whole, self._width, axis=0)
            win = np.concatenate([win, np.arange(first, first + len(whole) - self._width + 1)])
            lost = np.concatenate([lost, np.full(len(win) - n_ended, dropped)])
        late = np.arange(len(win)) < n_ended
        for at in range(0, len(win), _SLAB):
            part = slice(at, at + _SLAB)
            yield self._frame(key, win[part], late[part], lost[part], views[part])
        if len(new):
            seen, held = seen + len(new), whole[-self._width:]
        self._state.update((seen, dropped, np.ascontiguousarray(held).tobytes()))

    def close(self) -> None:
        pass


def windowed(stream: DataFrame, key: str, time: str, channels: Sequence[str], width: int = 30) -> DataFrame:
    """A feature row per record once `width` records of the object are known.

    `time` is a number. Records out of order are inserted while they fall inside
    the held window, else dropped and counted in `dropped`.
    """
    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, win bigint, t_end double, late boolean, dropped bigint, _values array<double>"
    found = stream.select(*dict.fromkeys([key, time, *channels])).groupBy(key).transformWithStateInPandas(
        _Windows(key, time, channels, width), outputStructType=schema, outputMode="Append", timeMode="None")
    names = [f"{c}_{n}" for c in channels for n in WINDOW_NAMES]
    return found.select(key, "win", "t_end", "late", "dropped", *[F.col("_values")[i].alias(n) for i, n in enumerate(names)])


class _Settled(StatefulProcessor):
    """Records wait until the watermark has passed them; then they are final, in order, and windows end with them."""

    def __init__(self, channels: Sequence[str], width: int, idle_ms: int, names: Sequence[str]):
        self._channels, self._width, self._idle, self._names = list(channels), width, idle_ms, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("us", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in self._channels]
        self._handle = handle
        self._waiting, self._held = handle.getListState("waiting", T.StructType(fields)), handle.getListState("held", T.StructType(fields))
        self._settled = handle.getValueState("settled", T.StructType([T.StructField("n", T.LongType()), T.StructField("last", T.LongType())]))

    @staticmethod
    def _rows(state) -> list[tuple]:
        return [tuple(r) for r in state.get()] if state.exists() else []

    def _settle(self, key, waiting: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        waiting.sort(key=lambda r: (r[0], *[(v is None, v or 0.0) for v in r[1:]]))
        ready = [r for r in waiting if r[0] <= watermark * 1000]
        waiting = waiting[len(ready):]
        held = self._rows(self._held)
        n, last = self._settled.get() if self._settled.exists() else (0, 0)
        rows = held + ready
        if ready and len(rows) >= self._width:
            block = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], dtype=float)
            views = np.lib.stride_tricks.sliding_window_view(block, self._width, axis=0)          # (windows, channels, width)
            ends = rows[self._width - 1:]
            first = n + len(ready) - len(ends) - self._width + 1
            out = {"key": [key[0]] * len(ends), "win": np.arange(first, first + len(ends)), "end": [r[0] for r in ends]}
            for j, c in enumerate(self._channels):
                out |= {f"{c}_{k}": f(views[:, j], axis=1) for k, f in (("mean", np.mean), ("std", np.std), ("min", np.min), ("max", np.max))}
            yield pd.DataFrame(out).set_axis(self._names, axis=1)
        n, last = n + len(ready), ready[-1][0] if ready else last
        for t in list(self._handle.listTimers()):
            if t > watermark:
                self._handle.deleteTimer(t)
        expiry = last // 1000 + self._idle
        if not waiting and expiry <= watermark:                             # the object has ended
            self._waiting.clear()
            self._held.clear()
            self._settled.clear()
            return
        self._waiting.put(waiting) if waiting else self._waiting.clear()
        kept = rows[-(self._width - 1):] if self._width > 1 else []
        self._held.put(kept) if kept else self._held.clear()
        self._settled.update((n, last))
        self._handle.registerTimer(-(-waiting[0][0] // 1000) if waiting else expiry)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # by place: key, time, microseconds, channels (a computed column does not keep its name on the way here)
        new = [tuple(r) for pdf in rows for r in pdf.iloc[:, 2:].astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None)]
        yield from self._settle(key, self._rows(self._waiting) + new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, self._rows(self._waiting), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def settled_windows(stream: DataFrame, key: str, time: str, channels: Sequence[str], width: int = 30, *, delay: str = "1 day", idle_seconds: int = 30 * 86_400) -> DataFrame:
    """A row (key, win, t_end in microseconds, mean, std, min, max of each channel) per record and its `width - 1` predecessors, by event time.

    `time` is a timestamp. Records up to `delay` late take their place: a record counts once the watermark (newest time seen by any object, less `delay`) has
    passed it, and the window that ends with it is final. Later records are dropped by Spark and counted in the query's progress
    (`numRowsDroppedByWatermark`); it drops by the watermark of the batch before, so one that comes before its place was settled is still used. State is `width - 1` records and those not yet passed; an object without records for `idle_seconds` of event time leaves none, and
    counts its windows from 0 if it comes back. A window over an unknown value is unknown.
    """
    names = [key, "win", "t_end", *[f"{c}_{k}" for c in channels for k in ("mean", "std", "min", "max")]]
    kinds = [stream.schema[key].dataType.simpleString(), "bigint", "bigint", *["double"] * (len(names) - 3)]
    ready = stream.withWatermark(time, delay).select(key, time, F.unix_micros(time).alias("_us"), *[F.col(c).cast("double").alias(c) for c in channels])
    return ready.groupBy(key).transformWithStateInPandas(
        _Settled(channels, width, idle_seconds * 1000, names), outputStructType=", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)), outputMode="Append", timeMode="EventTime")


class _Sustained(StatefulProcessor):
    """Consecutive alerts per object; a quiet record starts the count again."""

    def __init__(self, order: str, fired: str, lead: str, k: int, names: Sequence[str]):
        self._order, self._fired, self._lead, self._k, self._names = order, fired, lead, k, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._run = handle.getValueState("run", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run = (self._run.get() or (0,))[0]
        new = pd.concat([pdf[[self._order, self._fired, self._lead]] for pdf in rows], ignore_index=True).sort_values(self._order, kind="stable")
        fired, at = new[self._fired].to_numpy(dtype=bool, na_value=False), np.arange(len(new))
        quiet = np.maximum.accumulate(np.where(fired, -1 - run, at))                            # place of the last quiet record
        self._run.update((int(at[-1] - quiet[-1]),))
        hit = new.iloc[fired & (at - quiet == self._k), [0, 2]]
        if len(hit):
            hit.insert(0, "_key", key[0])
            yield hit.set_axis(self._names, axis=1)

    def close(self) -> None:
        pass


def sustained(stream: DataFrame, key: str, order: str, fired: str, value: str, k: int = 3) -> DataFrame:
    """A row each time an object completes `k` alerts in a row."""
    kind = lambda c: stream.schema[c].dataType.simpleString()
    schema = f"`{key}` {kind(key)}, `{order}` {kind(order)}, `{value}` {kind(value)}"
    return stream.groupBy(key).transformWithStateInPandas(
        _Sustained(order, fired, value, k, [key, order, value]), outputStructType=schema, outputMode="Append", timeMode="None")


def run_available(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Run a stream over everything that is there and return what it wrote to the shared folder. With the `base` of an earlier run it goes on from there."""
    spark = stream.sparkSession
    base = base or f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    q = (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
