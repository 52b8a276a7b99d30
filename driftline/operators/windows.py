"""Fixed-count windows over ordered histories.

A window is named by its start position `win`. Window values are computed in
one of three equal ways:

* frames: a moving row frame per aggregate, best when nearly every row ends a
  window (stride below `_FRAME_STRIDE`);
* groups: each row is copied into the windows it belongs to (width / stride
  copies) and aggregated by (object, win). After the ordering shuffle this needs
  no further exchange, and it also covers windows that shrink for short objects;
* arrays: as groups, but the windows are cut out as matrices inside the tasks
  (`window_arrays`). It takes the place of groups for `_WIDE` aggregates and more,
  where no object is cut into pieces.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftline.operators.ordering import (ROWS_PER_TASK, Frames, Layout, framed, layout_of, running,
                                          same_key, with_position)
from driftline.operators.window_arrays import Asked, Unsupported, window_arrays

_FRAME_STRIDE = 2
_WIDE = 32

Stage = Mapping[str, Callable[[WindowSpec], Column]]


class Span:
    """Builds aggregates over the rows of one window, in either form."""

    def __init__(self, width: int, frames: Frames | None = None, asked: Asked | None = None):
        self._width = width
        self._frames = frames
        self._asked = asked
        self.rows: Column = F.lit(width) if frames is not None else F.col("width")
        self.mid: Column = F.floor(self.rows / 2)
        # position modulo the width: window sums of x·exp(i·phase) only differ
        # from the ones counted from the window start by a factor of modulus 1
        self.phase: Column = F.pmod(F.col("pos"), self.rows)

    def agg(self, fn: Callable[..., Column], *cols: str | Column, skip: int = 0, half: str = "") -> Column:
        """`fn` over the window's rows, minus `skip` leading ones, or over one half."""
        if self._asked is not None:
            return self._asked.agg(fn, cols, skip, half)
        items = [F.col(c) if isinstance(c, str) else c for c in cols]
        if self._frames is not None:
            w, mid = self._width, self._width // 2
            low = mid if half == "late" else skip
            high = mid if half == "early" else w
            return fn(*items).over(self._frames.rows(low - (w - 1), high - w))
        inside = None
        if half:
            inside = F.col("off") < self.mid if half == "early" else F.col("off") >= self.mid
        elif skip:
            inside = F.col("off") >= skip
        if inside is not None:
            items = [F.when(inside, c) for c in items]
        return fn(*items)

    @property
    def size(self) -> Column:
        """The window's rows, as a value of the window."""
        if self._asked is not None:
            return F.col("_width")
        return self.rows if self._frames is not None else F.max(self.rows)

    def fourier(self, c: str, k: int) -> Column:
        """Magnitude of Fourier bin `k`."""
        if self._asked is not None:
            return self._asked.fourier(c, k)
        angle = F.lit(2.0 * math.pi * k) * self.phase / self.rows
        re = self.agg(F.sum, F.col(c) * F.cos(angle))
        im = self.agg(F.sum, F.col(c) * F.sin(angle))
        return F.sqrt(re * re + im * im)


Features = Callable[[Span], Mapping[str, Column]]


def _derive(df: DataFrame, frames: Frames, stages: Sequence[Stage]) -> DataFrame:
    for stage in stages:
        df = df.withColumns({name: build(frames.ordered) for name, build in stage.items()})
    return df


def assign_windows(df: DataFrame, width: int, stride: int = 1, *, shrink: bool = False,
                   min_rows: int = 3) -> DataFrame:
    """Copy positioned rows (`pos`, `n`) into the complete windows they belong to.

    Adds `win` (start), `off` (offset inside the window) and `width`. With
    `shrink`, an object shorter than `width` gets one window over all its rows.
    """
    w = F.least(F.lit(width), F.col("n")) if shrink else F.lit(width)
    out = df.withColumn("width", w.cast("long"))
    out = out.where(F.col("n") >= (min_rows if shrink else width))
    low = F.ceil(F.greatest(F.col("pos") - F.col("width") + 1, F.lit(0)) / stride)
    high = F.floor(F.least(F.col("pos"), F.col("n") - F.col("width")) / stride)
    out = out.withColumn("_a", low).withColumn("_b", high).where("_a <= _b")
    out = out.withColumn("_s", F.explode(F.sequence("_a", "_b"))).withColumn("win", F.col("_s") * stride)
    return out.withColumn("off", F.col("pos") - F.col("win")).drop("_a", "_b", "_s")


def window_features(df: DataFrame, key: Sequence[str], order: Sequence[str], width: int, stride: int,
                    features: Features, *, stages: Sequence[Stage] = (), last: Sequence[str] = (),
                    shrink: bool = False, min_rows: int = 3, limit: int = ROWS_PER_TASK,
                    rows: int | None = None, form: str | None = None) -> DataFrame:
    """One row per complete window: key, `win`, the `last` columns of its final row, features."""
    key = list(key)
    wide = _WIDE if form is None else 0 if form == "arrays" else math.inf
    form = form or ("groups" if shrink or stride >= _FRAME_STRIDE else "frames")
    keep = list(dict.fromkeys([*last]))
    if form == "frames":
        frames = framed(df, key, order, width - 1, limit=limit, rows=rows)
        base = _derive(frames.df, frames, stages)
        values = features(Span(width, frames))
        out = base.withColumn("win", F.col("pos") - (width - 1))
        out = out.select(*frames.part, "pos", "n", "win", *[c for c in keep if c not in ("pos", "n")],
                         *[v.alias(n) for n, v in values.items()])
        out = frames.finish(out).where((F.col("win") >= 0) & (F.col("win") % stride == 0))
        return out.select(*key, "win", *keep, *values)
    frames = framed(df, key, order, max(len(stages), 1), limit=limit, rows=rows)
    base = frames.finish(_derive(frames.df, frames, stages))
    if frames.own is None and wide < math.inf:
        asked = Asked()
        try:
            values = features(Span(width, asked=asked))
            if len(asked.wanted) >= wide:
                out = window_arrays(base, key, keep, asked, width, stride, shrink, min_rows)
                return out.select(*key, "win", *keep, *[v.alias(n) for n, v in values.items()])
        except Unsupported:
            pass                                            # built-in aggregates can do more
    spread = assign_windows(base, width, stride, shrink=shrink, min_rows=min_rows)
    values = features(Span(width))
    ends = F.col("off") == F.col("width") - 1
    tail = [F.max(F.when(ends, F.col(c))).alias(c) for c in keep]
    return spread.groupBy(*key, "win").agg(*tail, *[v.alias(n) for n, v in values.items()])


def complete_windows(df: DataFrame, key: Sequence[str], order: Sequence[str], width: int, stride: int = 1,
                     **kw) -> DataFrame:
    """Positions that end a complete window on the stride grid, with the row's own columns."""
    placed = with_position(df, key, order, **kw)
    start = F.col("pos") - (width - 1)
    return placed.withColumn("win", start).where((start >= 0) & (start % stride == 0))


def tail_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], m: int, **kw) -> DataFrame:
    """The last `m` rows of each object (all of them when it is shorter)."""
    placed = with_position(df, key, order, **kw)
    return placed.where(F.col("pos") >= F.col("n") - m)


def smooth(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], width: int = 5,
           *, limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Centred moving average with zero padding: the divisor is the full width at the edges too."""
    reach = width // 2
    frames = framed(df, key, order, reach, reach, limit=limit, rows=rows)
    spec = frames.rows(-(width - 1 - reach), reach)
    out = frames.df.withColumns({f"{c}_smooth": F.sum(c).over(spec) / F.lit(float(width)) for c in columns})
    return frames.finish(out)


def rolling_std(df: DataFrame, key: Sequence[str], order: Sequence[str], column: str, width: int, *,
                limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Trailing population deviation over `width` rows (fewer at the start)."""
    frames = framed(df, key, order, width - 1, limit=limit, rows=rows)
    out = frames.df.withColumn("roll_std", F.stddev_pop(column).over(frames.rows(-(width - 1), 0)))
    return frames.finish(out)


def baseline_scaled(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str],
                    first: int = 10, floor: float = 1e-10, **kw) -> DataFrame:
    """Express channels as deviations from the object's own first records."""
    placed = with_position(df, key, order, **kw)
    base = placed.where(F.col("pos") < first).groupBy(*key).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = placed.join(base, list(key))
    return joined.withColumns({
        f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}")) /
                       F.when(F.col(f"_s_{c}") < floor, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        for c in columns}).drop(*[f"_{p}_{c}" for p in "ms" for c in columns])


def arcs(df: DataFrame, key: Sequence[str], time: str, lengths: Sequence[float]) -> DataFrame:
    """Copies of each history cut to t0 + length, one per arc length (a fixed short list)."""
    start = df.groupBy(*key).agg(F.min(time).alias("_t0"))
    tagged = df.join(start, list(key)).withColumn("arc", F.explode(F.array(*[F.lit(float(x)) for x in lengths])))
    return tagged.where(F.col(time) <= F.col("_t0") + F.col("arc")).drop("_t0")


def prefix_stats(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], *,
                 limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Growing-prefix summaries: mean, min, max and last value of every prefix."""
    layout = layout_of(df, key, order, limit, rows)
    placed = with_position(df, key, order, layout=layout)
    measures = {}
    for c in columns:
        measures[f"_sum_{c}"] = ("sum", F.col(c))
        measures[f"_cnt_{c}"] = ("sum", F.when(F.col(c).isNotNull(), 1).otherwise(0))
        measures[f"{c}_min"] = ("min", F.col(c))
        measures[f"{c}_max"] = ("max", F.col(c))
    out = running(placed, key, order, measures, layout=layout)
    out = out.withColumns({f"{c}_mean": F.try_divide(F.col(f"_sum_{c}"), F.col(f"_cnt_{c}")) for c in columns})
    return out.withColumn("step", F.col("pos") + 1).drop(*[f"_{p}_{c}" for p in ("sum", "cnt") for c in columns])


def fill_gaps(df: DataFrame, key: Sequence[str], order: Sequence[str], column: str, out: str, *,
              limit: int = ROWS_PER_TASK, rows: int | None = None, layout: Layout | None = None) -> DataFrame:
    """Forward-fill; leading gaps take the first known value of the object."""
    layout = layout or layout_of(df, key, order, limit, rows)
    if not layout.sliced:
        w = Window.partitionBy(*key).orderBy(*[F.col(c) for c in order])
        so_far = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        first = F.first(column, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return df.withColumn(out, F.coalesce(so_far, first))
    place = F.struct(*[F.col(c) for c in order], F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]))
    filled = running(df, key, order, {"_f": ("last", F.col(column))}, layout=layout)
    first = df.groupBy(*key).agg(F.min_by(column, F.when(F.col(column).isNotNull(), place)).alias("_first"))
    return same_key(filled, first, list(key)).withColumn(out, F.coalesce("_f", "_first")).drop("_f", "_first")
