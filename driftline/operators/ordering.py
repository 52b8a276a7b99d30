"""Ordered work on groups of any size.

A window partitioned by object id puts one object's whole history into one
task. That is the right plan while every history is short, and the wrong one
when a single object holds a large share of the table. The functions here look
at the group sizes first (one narrow pre-aggregated count):

* no group above `limit` rows: plain window functions, one shuffle by key;
* otherwise: the table is range-partitioned by key, all order columns and, last, a
  hash of the row, so that equal order values are divided too. Every range is
  cut into pieces by row count and written once, every piece is ordered on its
  own, and a small table of totals per piece carries running values from one to
  the next.

Both ways give the same rows: NULL keys are a group, NULL and NaN are ordered as
Spark orders them (NULL first, NaN last), any order type will do, and the number of pieces
follows the table. `rows` is an upper bound on the row count that the
caller may already know; when it is within the limit no count is run. A `layout`
can be computed once and handed to several calls over the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftline.session import materialise

ROWS_PER_TASK = 2_000_000


@dataclass
class Layout:
    """Whether groups are cut into pieces, and into how many in all."""

    key: list[str]
    pieces: int = 0
    limit: int = ROWS_PER_TASK

    @property
    def sliced(self) -> bool:
        return self.pieces > 0


def layout_of(df: DataFrame, key: Sequence[str], order: Sequence[str] = (),
              limit: int = ROWS_PER_TASK, rows: int | None = None) -> Layout:
    """Look for groups above `limit` rows. `order` does not matter any more and is kept for callers."""
    key = list(key)
    if rows is not None and rows <= limit:
        return Layout(key, limit=limit)
    largest, total = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("_m"))
                      .agg(F.max("_m"), F.sum("_m")).first())
    if (largest or 0) <= limit:
        return Layout(key, limit=limit)
    return Layout(key, 2 * math.ceil(total / limit), limit)


def with_slice(df: DataFrame, layout: Layout, order: Sequence[str]) -> DataFrame:
    """Add `_slice`: the piece in key and order that a row falls into, of at most half a `limit` of rows.

    Tasks take ranges of `ROWS_PER_TASK` rows at most (about: the borders come from a sample) and number the pieces inside, so the tasks do not
    grow with the pieces. They are written to the shared folder: every reader has to see the same ones.
    """
    if not layout.sliced:
        return df.withColumn("_slice", F.lit(0))
    hashable = [c for c, t in df.dtypes if not t.startswith("map")]
    by = [F.col(c).asc() for c in [*layout.key, *order, "_tie"]]
    size = max(1, layout.limit // 2)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(layout.pieces, max(least, math.ceil(layout.pieces * size / ROWS_PER_TASK)))
    ranged = df.withColumn("_tie", F.xxhash64(*hashable)).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # the id is the range and, below 33 bits, the place in it: pieces rise with both
    place = F.monotonically_increasing_id()
    inside = F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / size)
    return materialise(ranged.withColumn("_slice", F.shiftleft(F.shiftright(place, 33), 33).bitwiseOR(inside)))


def same_key(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on `key`, where NULL is a value like any other; the columns of `key` come from the left."""
    if not key:
        return left.crossJoin(F.broadcast(right)) if how == "inner" else left.join(F.broadcast(right), F.lit(True), how)
    names = {c: f"_right_{c}" for c in key}
    right = right.withColumnsRenamed(names)
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return left.join(right, on, how).drop(*names.values())


def _ordered(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*[F.col(c).asc() for c in order])


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(df: DataFrame, key: Sequence[str], order: Sequence[str],
            measures: Mapping[str, tuple[str, Column]], *, limit: int = ROWS_PER_TASK,
            rows: int | None = None, layout: Layout | None = None) -> DataFrame:
    """Running aggregates from the start of each group to the current row.

    `measures` maps an output name to (kind, expression), kind one of `sum`,
    `min`, `max`, `last` (last non-null value so far).
    """
    key, order = list(key), list(order)
    layout = layout or layout_of(df, key, order, limit, rows)
    if not layout.sliced:
        frame = _ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({
            name: (F.last(expr, ignorenulls=True) if kind == "last" else _COMBINE[kind][0](expr)).over(frame)
            for name, (kind, expr) in measures.items()})

    part = [*key, "_slice"]
    cut = with_slice(df, layout, order)
    cut = cut.withColumns({f"_x_{n}": e for n, (_, e) in measures.items()})
    place = F.struct(*[F.col(c) for c in order], F.col("_tie"))
    totals = cut.groupBy(*part).agg(*[
        (F.max_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), place)) if kind == "last"
         else _COMBINE[kind][0](f"_x_{n}")).alias(f"_t_{n}")
        for n, (kind, _) in measures.items()])
    earlier = _ordered(key, ["_slice"]).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*part, *[
        (F.last(f"_t_{n}", ignorenulls=True) if kind == "last"
         else _COMBINE[kind][0](f"_t_{n}")).over(earlier).alias(f"_c_{n}")
        for n, (kind, _) in measures.items()])
    inside = _ordered(part, [*order, "_tie"]).rowsBetween(Window.unboundedPreceding, 0)
    out = same_key(cut, carry, part)
    for n, (kind, _) in measures.items():
        here, before = F.col(f"_x_{n}"), F.col(f"_c_{n}")
        if kind == "last":
            value = F.coalesce(F.last(here, ignorenulls=True).over(inside), before)
        else:
            value = _COMBINE[kind][1](_COMBINE[kind][0](here).over(inside), before)
        out = out.withColumn(n, value)
    return out.select(*df.columns, *measures)


def with_position(df: DataFrame, key: Sequence[str], order: Sequence[str], *,
                  limit: int = ROWS_PER_TASK, rows: int | None = None,
                  pos: str = "pos", size: str | None = "n",
                  layout: Layout | None = None) -> DataFrame:
    """0-based position of each row in its group, and the group's size."""
    key, order = list(key), list(order)
    layout = layout or layout_of(df, key, order, limit, rows)
    if not layout.sliced:
        out = df.withColumn(pos, F.row_number().over(_ordered(key, order)).cast("long") - 1)
        if size:
            out = out.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*key)))
        return out
    part = [*key, "_slice"]
    cut = with_slice(df, layout, order)
    totals = cut.groupBy(*part).agg(F.count(F.lit(1)).alias("_m"))
    earlier = _ordered(key, ["_slice"]).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*part, F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"),
                          F.sum("_m").over(Window.partitionBy(*key)).alias(size or "_n"))
    out = same_key(cut, carry, part).withColumn(
        pos, F.row_number().over(_ordered(part, [*order, "_tie"])).cast("long") - 1 + F.col("_before"))
    return out.select(*df.columns, pos, *([size] if size else []))


@dataclass
class Frames:
    """Rows ready for moving frames that reach `back` rows back and `ahead` rows ahead."""

    df: DataFrame
    part: list[str]
    own: Column | None
    order: list[str] = field(default_factory=lambda: ["pos"])

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.ordered.rowsBetween(start, end)

    @property
    def ordered(self) -> WindowSpec:
        return _ordered(self.part, self.order)

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop the copied border rows once the frame values are computed."""
        if self.own is None:
            return df
        return df.where(self.own).drop("_chunk")


def framed(df: DataFrame, key: Sequence[str], order: Sequence[str], back: int, ahead: int = 0, *,
           limit: int = ROWS_PER_TASK, rows: int | None = None, layout: Layout | None = None) -> Frames:
    """Position rows and, for large groups, cut them into chunks with copied borders."""
    key = list(key)
    layout = layout or layout_of(df, key, order, limit, rows)
    limit = layout.limit
    placed = with_position(df, key, order, layout=layout)
    if not layout.sliced:
        return Frames(placed, key, None, list(order))          # the order of the positions: one sort serves all frames
    size = max(limit, 4 * (back + ahead), 1)
    first = F.floor(F.greatest(F.col("pos") - ahead, F.lit(0)) / size)
    last = F.floor(F.least(F.col("pos") + back, F.col("n") - 1) / size)
    chunks = F.when(F.col("n") <= limit, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))
    own = (F.col("n") <= limit) | (F.col("_chunk") == F.floor(F.col("pos") / size))
    return Frames(placed.withColumn("_chunk", F.explode(chunks)), [*key, "_chunk"], own)


def per_group(df: DataFrame, key: Sequence[str], aggs: Mapping[str, Column], *,
              limit: int = ROWS_PER_TASK, rows: int | None = None, layout: Layout | None = None) -> DataFrame:
    """Attach whole-group aggregates to every row.

    Small groups share the window shuffle with later frames; large groups are
    pre-aggregated and joined back, where skewed join splitting applies.
    """
    key = list(key)
    layout = layout or layout_of(df, key, limit=limit, rows=rows)
    if not layout.sliced:
        whole = Window.partitionBy(*key)
        return df.withColumns({n: a.over(whole) for n, a in aggs.items()})
    return same_key(df, df.groupBy(*key).agg(*[a.alias(n) for n, a in aggs.items()]), key)


def average_ranks(df: DataFrame, key: Sequence[str], columns: Sequence[str], *,
                  limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Add `rank_<column>`: 1-based rank inside the group, ties sharing their mean rank."""
    key = list(key)
    layout = layout_of(df, key, columns[:1], limit, rows)
    out = df
    if not layout.sliced:
        for c in columns:
            first = F.rank().over(_ordered(key, [c]))
            ties = F.count(F.lit(1)).over(Window.partitionBy(*key, c))
            out = out.withColumn(f"rank_{c}", first + (ties - 1) / F.lit(2.0))
        return out
    for c in columns:
        distinct = df.groupBy(*key, c).agg(F.count(F.lit(1)).alias("_m"))
        placed = running(distinct, key, [c], {"_cum": ("sum", F.col("_m"))}, limit=limit)
        ranks = placed.select(*key, c, (F.col("_cum") - (F.col("_m") - 1) / F.lit(2.0)).alias(f"rank_{c}"))
        out = same_key(out, ranks, [*key, c])
    return out


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float], key: Sequence[str] = (), *,
              discrete: bool = False, limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Exact quantiles per group (linear interpolation, or the order statistic).

    Groups within the limit use the built-in aggregate. Larger groups are
    counted by distinct value, ordered in slices, and the wanted ranks are
    picked with conditional minima, so no task ever holds a whole group.
    """
    key = list(key)
    data = df.where(F.col(value).isNotNull())
    layout = layout_of(data, key, [value], limit, rows)
    if not layout.sliced:
        def pick(p: float) -> Column:
            if discrete:
                return F.expr(f"percentile_disc({p!r}D) WITHIN GROUP (ORDER BY `{value}`)")
            return F.percentile(value, F.lit(p))
        return data.groupBy(*key).agg(*[pick(p).alias(n) for n, p in probs.items()],
                                      F.count(F.lit(1)).alias("n"))
    distinct = data.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_m"))
    cum = running(distinct, key, [value], {"_cum": ("sum", F.col("_m"))}, limit=limit)
    sizes = data.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    if key:
        ranked = same_key(cum, sizes, key)
        total = F.col("n")
    else:
        ranked = cum
        total = F.lit(sizes.first()["n"])
    aggs = [F.max(total).alias("n")]
    for name, p in probs.items():
        if discrete:
            want = F.greatest(F.ceil(total * F.lit(p)), F.lit(1))
            aggs.append(F.min(F.when(F.col("_cum") >= want, F.col(value))).alias(name))
            continue
        spot = (total - 1) * F.lit(p)
        low, high = F.floor(spot), F.ceil(spot)
        at = lambda k: F.min(F.when(F.col("_cum") > k, F.col(value)))
        frac = F.max(spot - low)
        aggs.append((at(low) + (at(high) - at(low)) * frac).alias(name))
    return ranked.groupBy(*key).agg(*aggs).select(*key, *probs, "n")
