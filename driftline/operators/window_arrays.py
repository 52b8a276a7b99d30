"""Window aggregates as arrays, for vectors of dozens of features.

Built-in aggregates copy every row into its width / stride windows and update each
aggregate once per copy. Here the rows of a task, ordered by object, are read as Arrow batches
and a batch's windows are one matrix per column; a feature takes a few array operations. Only
the rows of windows that are not complete yet are kept from batch to batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {F.avg: "avg", F.stddev_pop: "std", F.min: "min", F.max: "max", F.covar_pop: "cov", F.covar_samp: "cov1", F.regr_slope: "slope"}


class Unsupported(Exception):
    """An aggregate that has no array form."""


class Asked:
    """The aggregates that a feature function asks for, by name of the column that will hold them."""

    def __init__(self) -> None:
        self.inputs: dict[str, tuple[str, Column]] = {}
        self.wanted: dict[tuple, str] = {}

    def _input(self, c: str | Column) -> str:
        c = F.col(c) if isinstance(c, str) else c
        return self.inputs.setdefault(str(c), (f"_x{len(self.inputs)}", c))[0]

    def agg(self, fn: Callable[..., Column], cols: Sequence[str | Column], skip: int, half: str) -> Column:
        if fn not in _KINDS:
            raise Unsupported(fn)
        return self._named((_KINDS[fn], tuple(self._input(c) for c in cols), skip, half))

    def fourier(self, c: str, k: int) -> Column:
        return self._named((f"fft{k}", (self._input(c),), 0, ""))

    def _named(self, what: tuple) -> Column:
        return F.col(self.wanted.setdefault(what, f"_a{len(self.wanted)}"))


class _Windows:
    """Windows of one width: a matrix per column, unknown values masked."""

    def __init__(self, starts: np.ndarray, width: int, columns: dict[str, tuple[np.ndarray, np.ndarray | None]]):
        self.width, self.at, self.columns = width, starts[:, None] + np.arange(width), columns
        self.cuts: dict = {}
        self.spreads: dict = {}

    def cut(self, c: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray | None]:
        if c not in self.cuts:
            values, known = self.columns[c]
            self.cuts[c] = values[self.at], None if known is None else known[self.at]
        x, known = self.cuts[c]
        x, known = x[:, lo:hi], None if known is None else known[:, lo:hi]
        return x, None if known is None or known.all() else known

    def spread(self, c: str, lo: int, hi: int, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Deviations from the mean over the rows `among` (0 elsewhere), and the sum of their squares. Exact zeros for a constant."""
        if among is None and (c, lo, hi) in self.spreads:
            return self.spreads[c, lo, hi]
        x, _ = self.cut(c, lo, hi)
        if among is None:
            y = x - x[:, :1]
            y -= y.mean(axis=1)[:, None]
        else:
            first = np.take_along_axis(x, among.argmax(axis=1)[:, None], axis=1)
            y = np.where(among, x - first, 0.0)
            y = np.where(among, y - (y.sum(axis=1) / among.sum(axis=1))[:, None], 0.0)
        out = y, np.einsum("ij,ij->i", y, y)
        if among is None:
            self.spreads[c, lo, hi] = out
        return out

    def value(self, kind: str, names: tuple[str, ...], skip: int, half: str) -> tuple[np.ndarray, np.ndarray]:
        """The aggregate of every window, and where it is NULL."""
        mid = self.width // 2
        lo, hi = (0, mid) if half == "early" else (mid, self.width) if half == "late" else (min(skip, self.width), self.width)
        m = len(self.at)
        if lo == hi:
            return np.zeros(m), np.ones(m, bool)
        x, among = self.cut(names[0], lo, hi)
        if len(names) > 1:
            other = self.cut(names[1], lo, hi)[1]
            among = other if among is None else among if other is None else among & other
        n = np.full(m, hi - lo) if among is None else among.sum(axis=1)
        null = n == 0
        if kind == "avg":
            return (x if among is None else np.where(among, x, 0.0)).sum(axis=1) / n, null
        if kind == "std":
            return np.sqrt(self.spread(names[0], lo, hi, among)[1] / n), null
        if kind == "min":
            return np.fmin.reduce(x if among is None else np.where(among, x, np.nan), axis=1), null
        if kind == "max":
            return (x if among is None else np.where(among, x, -np.inf)).max(axis=1), null
        if kind.startswith("fft"):
            angle = 2.0 * math.pi * int(kind[3:]) / self.width * np.arange(self.width)
            parts = (x if among is None else np.where(among, x, 0.0)) @ np.column_stack([np.cos(angle), np.sin(angle)])
            return np.sqrt((parts * parts).sum(axis=1)), null
        one, two = (self.spread(c, lo, hi, among) for c in names)
        both = np.einsum("ij,ij->i", one[0], two[0])
        if kind == "cov":
            return both / n, null
        if kind == "cov1":
            return both / (n - 1), n < 2
        return both / two[1], (n < 2) | (two[1] == 0)


def _complete(batches: Iterator[pa.RecordBatch], names: Sequence[str], width: int, stride: int, shrink: bool = False,
              min_rows: int = 0) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, dict]]:
    """(rows, `_pos`, first and last rows of the windows that are complete in them, values of `names` with their known places)."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        pos, size = (table.column(c).to_numpy() for c in ("_pos", "_n"))
        w = np.minimum(width, size) if shrink else np.full(len(size), width)
        starts = np.flatnonzero((pos % stride == 0) & (pos + w <= size) & (size >= (min_rows if shrink else width)))
        ends = starts + w[starts] - 1
        ready = int(np.searchsorted(ends, len(pos)))
        held = table.slice(starts[ready]) if ready < len(starts) else None
        starts, ends = starts[:ready], ends[:ready]
        if not ready:
            continue
        if (pos[ends] != pos[starts] + w[starts] - 1).any():
            raise RuntimeError("the rows of an object are not in the order of their positions")
        columns = {}
        for c in names:
            array = table.column(c).chunk(0)
            columns[c] = array.to_numpy(zero_copy_only=False), (array.is_valid().to_numpy(zero_copy_only=False) if array.null_count else None)
        yield table, pos, starts, ends, columns
    if held is not None:
        raise RuntimeError("the rows of an object are not in the order of their positions")


def _places(key: list[str], keep: list[str]) -> list[Column]:
    return [*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], *[F.col(c).alias(f"_l{i}") for i, c in enumerate(keep)],
            F.col("pos").cast("long").alias("_pos"), F.col("n").cast("long").alias("_n")]


def _steps(column: tuple[np.ndarray, np.ndarray | None]) -> tuple[np.ndarray, np.ndarray | None]:
    """Differences to the row before; the first one of a window reaches out of it and must be skipped."""
    x, known = column
    return np.diff(x, prepend=np.nan), None if known is None else known & np.concatenate([[False], known[:-1]])


def window_vectors(base: DataFrame, key: Sequence[str], keep: Sequence[str], channels: Sequence[str], width: int, stride: int,
                   matrix: Callable[[Callable], np.ndarray], out: str) -> DataFrame:
    """key, `win`, `keep` and the array `out` (unknown: NaN) per complete window of `base`, which is as for `window_arrays`.

    `matrix(value)` has a row per window; `value(kind, names, skip, half)` is an aggregate of every window and where it is NULL, over channels `c` and
    their steps `d1_c` and `d2_c` (which have 1 and 2 rows to skip). The vectors leave the tasks as one column: dozens of columns are too long a method for
    the JVM to compile, here and in every pass that reads them.
    """
    key, keep, channels = list(key), list(keep), list(channels)
    rows = base.select(*_places(key, keep), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(channels)])
    types, names = dict(rows.dtypes), [f"_c{i}" for i in range(len(channels))]
    fields = [f"`{c}` {types[f'_k{i}']}" for i, c in enumerate(key)] + ["`win` bigint"] + [f"`{c}` {types[f'_l{i}']}" for i, c in enumerate(keep)] + [f"`{out}` array<double>"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, pos, starts, ends, columns in _complete(batches, names, width, stride):
            of: dict = {}
            for c, name in zip(channels, names):
                of[c] = columns[name]
                of[f"d1_{c}"] = _steps(of[c])
                of[f"d2_{c}"] = _steps(of[f"d1_{c}"])
            with np.errstate(all="ignore"):
                x = matrix(_Windows(starts, width, of).value)
            first, last = pa.array(starts), pa.array(ends)
            made = [table.column(f"_k{i}").take(first).combine_chunks() for i in range(len(key))] + [pa.array(pos[starts])]
            made += [table.column(f"_l{i}").take(last).combine_chunks() for i in range(len(keep))]
            made.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel())))
            yield pa.RecordBatch.from_arrays(made, [*key, "win", *keep, out])

    return rows.mapInArrow(windows, ", ".join(fields))


def window_arrays(base: DataFrame, key: Sequence[str], keep: Sequence[str], asked: Asked, width: int, stride: int, shrink: bool, min_rows: int) -> DataFrame:
    """key, `win`, `keep`, `_width` and the aggregates of `asked` per complete window of `base`.

    `base` has `pos` and `n`, and its tasks hold whole objects in the order of `pos` (as they leave a window function).
    """
    key, keep = list(key), list(keep)
    inputs = base.select(*[c.alias(name) for name, c in asked.inputs.values()])
    kinds = dict(inputs.dtypes)
    for kind, names, _, _ in asked.wanted:
        allowed = ("double",) if kind in ("min", "max") else ("double", "float", "int", "bigint", "smallint", "tinyint")
        if any(kinds[c] not in allowed for c in names):
            raise Unsupported(kind)
    rows = base.select(*_places(key, keep), *[c.cast("double").alias(name) for name, c in asked.inputs.values()])
    types = dict(rows.dtypes)
    fields = ([f"`{c}` {types[f'_k{i}']}" for i, c in enumerate(key)] + ["`win` bigint"] + [f"`{c}` {types[f'_l{i}']}" for i, c in enumerate(keep)]
              + ["`_width` bigint"] + [f"`{a}` double" for a in asked.wanted.values()])
    names, n_key, n_keep, wanted, made = [name for name, _ in asked.inputs.values()], len(key), len(keep), list(asked.wanted), list(asked.wanted.values())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, pos, starts, ends, columns in _complete(batches, names, width, stride, shrink, min_rows):
            w = ends - starts + 1
            for some in np.unique(w):
                mine = w == some
                at = pa.array(starts[mine]), pa.array(ends[mine])
                of = _Windows(starts[mine], int(some), columns)
                with np.errstate(all="ignore"):
                    found = [of.value(*what) for what in wanted]
                out = [table.column(f"_k{i}").take(at[0]).combine_chunks() for i in range(n_key)]
                out += [pa.array(pos[starts[mine]])] + [table.column(f"_l{i}").take(at[1]).combine_chunks() for i in range(n_keep)]
                out += [pa.array(np.full(int(mine.sum()), some, np.int64))] + [pa.array(v, pa.float64(), mask=null) for v, null in found]
                yield pa.RecordBatch.from_arrays(out, [*key, "win", *keep, "_width", *made])

    return rows.mapInArrow(windows, ", ".join(fields))
