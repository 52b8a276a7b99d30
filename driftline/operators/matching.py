"""Remaining-life prediction by matching a history's tail against run-to-failure segments."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from driftline.operators.knn import BROADCAST_VALUES
from driftline.operators.ordering import ROWS_PER_TASK
from driftline.operators.windows import smooth


PIECE, TAILS = 16_384, 256              # segment starts of a history, and least tails of a block
RECORDS, DIRECT = 4_096, 1_024          # records compared at a time; values of a tail above which an FFT is cheaper


def _packed(rows: Column, channels: Sequence[str], extra: str | None = None) -> Column:
    """The smoothed records of a group in order, as arrays: `v` (records x channels) and the `extra` column."""
    ordered = F.array_sort(rows)
    values = F.flatten(F.transform(ordered, lambda r: F.array(*[r[f"{c}_smooth"].cast("double") for c in channels])))
    parts = [F.element_at(ordered, 1)["pos"].cast("long").alias("first"), values.alias("v")]
    if extra:
        parts.append(F.transform(ordered, lambda r: r[extra].cast("double")).alias("life"))
    return F.struct(*parts)


class _Slide:
    """Distances of tails to all segments of one piece of a history: sliding products by FFT, squares by running sums."""

    def __init__(self, x: np.ndarray):
        self._x, self._bad = x, ~np.isfinite(x).all(axis=1)
        self._shift = x[~self._bad].mean(axis=0) if not self._bad.all() else np.zeros(x.shape[1])
        y = np.where(self._bad[:, None], 0.0, x - self._shift)
        self._size = 1 << (2 * len(x) - 1).bit_length()
        self._spectrum = np.fft.rfft(y, self._size, axis=0)
        self._squares = np.concatenate([[0.0], np.cumsum((y * y).sum(axis=1))])
        self._unknown = np.concatenate([[0], np.cumsum(self._bad)])

    def nearest(self, q: np.ndarray, starts: int, top: int, names: Callable[[int], str]) -> list[tuple[float, int]]:
        """(squared distance, start) of the `top` nearest of the first `starts` segments, equal ones in the order of their names.

        Running sums and transforms are rounded, so every segment that could be among the nearest within that error is measured exactly.
        """
        m, n = len(q), min(starts, len(self._x) - len(q) + 1)
        if n <= 0 or not np.isfinite(q).all():
            return []
        known = self._unknown[m:m + n] == self._unknown[:n]
        if not known.any():
            return []
        shifted = q - self._shift
        turned = np.fft.rfft(shifted[::-1], self._size, axis=0)
        products = np.fft.irfft((self._spectrum * turned).sum(axis=1), self._size)[m - 1:m - 1 + n]
        own = float((shifted * shifted).sum())
        rough = np.where(known, own + self._squares[m:m + n] - self._squares[:n] - 2.0 * products, np.inf)
        margin = 1e-12 * math.log2(self._size) * (own + self._squares[-1] + 2.0 * math.sqrt(own * self._squares[-1]))
        place = min(top, int(known.sum())) - 1
        near = np.flatnonzero(rough <= np.partition(rough, place)[place] + 2.0 * margin)
        # in blocks: of equal segments there may be as many as the piece has
        exact = np.concatenate([((self._x[near[i:i + 4096, None] + np.arange(m)] - q) ** 2).sum(axis=(1, 2)) for i in range(0, len(near), 4096)])
        last = np.partition(exact, place)[place]
        few = [(float(d), int(s)) for d, s in zip(exact[exact <= last], near[exact <= last])]
        return sorted(few, key=lambda h: (h[0], names(h[1])))[:top]


class _Nearest:
    """The `top` nearest segments of many tails, over all pieces of histories that come by.

    Segments of pieces are compared with all tails of a length by one matrix product, tails with more than `DIRECT` values by FFT. A
    product is rounded, so every segment that could be among the nearest within its error is measured exactly.
    """

    def __init__(self, ids: Sequence, tails: Sequence[np.ndarray], top: int, size: int):
        self._ids, self._tails, self._top, self._size = ids, tails, top, size
        self._best: list[list] = [[] for _ in tails]                                # (squared distance, name, key, start, life) in order
        self._bound = np.full(len(tails), np.inf)                                  # squared distance of the last of them
        lengths: dict[int, list[int]] = {}
        for i, q in enumerate(tails):
            if len(q) and np.isfinite(q).all():
                lengths.setdefault(len(q), []).append(i)
        self._long = [i for n, at in lengths.items() for i in at if tails[i].size > DIRECT]
        self._short = [(n, np.array(at), np.stack([tails[i] for i in at])) for n, at in sorted(lengths.items()) if tails[at[0]].size <= DIRECT]
        self._shift = np.concatenate([q.reshape(-1, q.shape[2]) for *_, q in self._short]).mean(axis=0) if self._short else 0.0

    def add(self, batch: pa.RecordBatch, width: int) -> None:
        """Compare with the pieces of a batch (key, piece)."""
        keys, piece = batch.column(0), batch.column(1)
        first, values, life = piece.field("first").to_numpy(), piece.field("v"), piece.field("life")
        x = np.asarray(values.values.to_numpy(zero_copy_only=False), float).reshape(-1, width)
        lives, edge = life.values, values.offsets.to_numpy().astype(np.int64) // width
        lives_at = life.offsets.to_numpy().astype(np.int64)
        lo = 0
        while lo < len(keys):
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + RECORDS, "right")) - 1)
            named = lambda i: (keys[i].as_py(), int(first[i]) - int(edge[i]), lambda r, i=i: lives[int(lives_at[i] + r - edge[i])].as_py())
            for n, at, q in self._short:
                for some in range(0, len(at), 4096):
                    self._direct(n, at[some:some + 4096], q[some:some + 4096], x, edge[lo:hi + 1], lambda k, lo=lo: named(lo + k))
            for i in range(lo, hi) if self._long else ():
                key, base, alive = named(i)
                slide = _Slide(x[edge[i]:edge[i + 1]])
                for t in self._long:
                    q, start = self._tails[t], int(edge[i])
                    found = slide.nearest(q, self._size, self._top, lambda s: f"{key}:{base + start + s}")
                    self._merge(t, [(d, f"{key}:{base + start + s}", key, base + start + s, alive(start + s + len(q) - 1)) for d, s in found])
            lo = hi

    def _merge(self, t: int, found: list) -> None:
        self._best[t] = sorted(self._best[t] + found, key=lambda h: h[:2])[:self._top]
        if len(self._best[t]) == self._top:
            self._bound[t] = self._best[t][-1][0]

    def _direct(self, n: int, at: np.ndarray, q: np.ndarray, x: np.ndarray, edge: np.ndarray, named: Callable) -> None:
        counts = np.clip(np.minimum(np.diff(edge) - n + 1, self._size), 0, None)
        begins = np.cumsum(counts) - counts
        starts = np.repeat(edge[:-1] - begins, counts) + np.arange(counts.sum())
        segments = (x[starts[:, None] + np.arange(n)] - self._shift).reshape(len(starts), n * x.shape[1])
        known = np.isfinite(segments).all(axis=1)
        starts, segments = starts[known], segments[known]
        if not len(starts):
            return
        turned = (q - self._shift).reshape(len(q), -1)
        squares, own = np.einsum("ij,ij->i", segments, segments), np.einsum("ij,ij->i", turned, turned)
        # a row times a column is q s - s s / 2: half the square of q less half the squared distance
        columns = np.hstack([segments, -0.5 * squares[:, None]]).T
        rows = np.hstack([turned, np.ones((len(q), 1))])
        margin = 8.0 * (turned.shape[1] + 8) * 2.0 ** -53 * (own + squares.max())
        for lo in range(0, len(q), 256):
            some = slice(lo, lo + 256)
            near, last = rows[some] @ columns, (own[some] - self._bound[at[some]]) / 2 - margin[some]
            new = np.flatnonzero(np.isinf(last))
            if len(new):
                place = max(len(starts) - self._top, 0)
                last[new] = np.partition(near[new], place, axis=1)[:, place] - 2.0 * margin[some][new]
            qi, si = np.divmod(np.flatnonzero(near >= last[:, None]), len(starts))
            if not len(qi):
                continue
            qi += lo
            # in blocks: of equal segments there may be many
            exact = np.concatenate([((x[starts[si[i:i + 8192], None] + np.arange(n)] - q[qi[i:i + 8192]]) ** 2).sum(axis=(1, 2)) for i in range(0, len(qi), 8192)])
            by = np.lexsort((exact, qi))
            qi, si, exact = qi[by], si[by], exact[by]
            ends = np.append(np.flatnonzero(qi[1:] != qi[:-1]) + 1, len(qi))
            for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                t = int(at[qi[a]])
                worst = min(self._bound[t], exact[a + self._top - 1] if b - a >= self._top else np.inf)
                found = []
                for k in range(a, a + int(np.searchsorted(exact[a:b], worst, "right"))):
                    r = int(starts[si[k]])
                    key, base, alive = named(int(np.searchsorted(edge, r, "right")) - 1)
                    found.append((float(exact[k]), f"{key}:{base + r}", key, base + r, alive(r + n - 1)))
                if found:
                    self._merge(t, found)

    def rows(self) -> Iterator[tuple]:
        """(tail, key, start, length, distance, life) of the nearest."""
        for key, q, best in zip(self._ids, self._tails, self._best):
            for d, _, match, start, life in best:
                yield key, match, start, len(q), math.sqrt(d / q.size), life


def _unpacked(tails: pa.Table, width: int) -> tuple[list, list[np.ndarray]]:
    """Ids and values (records x channels) of the tails."""
    table = tails.combine_chunks()
    values = [v for chunk in table.column("_v").chunks for v in chunk]
    return table.column("_tail").to_pylist(), [np.asarray(v.values.to_numpy(zero_copy_only=False), float).reshape(-1, width) for v in values]


def _batch(rows: Iterator[tuple], kind: pa.DataType) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 6
    kinds = [kind, kind, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["_tail", "match_id", "win", "m", "distance", "rul_at_match"])


def segment_matches(test: DataFrame, train: DataFrame, key: str, order: Sequence[str], channels: Sequence[str], rul: str, *,
                    window: int = 30, top: int = 5, smoothing: int = 5, limit: int = ROWS_PER_TASK,
                    rows: int | None = None, bound: int = BROADCAST_VALUES) -> DataFrame:
    """The `top` nearest training segments of each test object's smoothed tail, `rank` from 1.

    A segment is any run of `window` smoothed training records; distance is the root mean square over records and channels. Objects
    shorter than the window match segments of their own length. Segments and tails with an unknown value match nothing. Of equal
    distances the one whose `object:start` comes first as text is nearer.

    Histories are cut into pieces of at most 16,384 starts (each with the `window - 1` records behind it), and a task compares its pieces
    with all tails by matrix products and keeps the nearest. The tails are broadcast while their values stay within `bound`; else blocks
    of tails of that size meet parts of the pieces, and the pieces are sent once per block.
    """
    opts, width, size, spark = {"limit": limit, "rows": rows}, len(channels), PIECE, train.sparkSession
    tails = smooth(test, [key], order, channels, smoothing, **opts).withColumn("m", F.least(F.col("n"), F.lit(window)))
    record = [F.col("pos"), *[F.col(f"{c}_smooth") for c in channels]]
    tails = tails.where(F.col("pos") >= F.col("n") - F.col("m")).groupBy(key).agg(_packed(F.collect_list(F.struct(*record)), channels).alias("t"))   # at most `window` records
    tails = tails.select(F.col(key).alias("_tail"), F.col("t.v").alias("_v"))
    count = test.select(key).distinct().count()

    library = smooth(train, [key], order, channels, smoothing, **opts)
    pieces = F.sequence(F.floor(F.greatest(F.col("pos") - (window - 1), F.lit(0)) / size), F.floor(F.col("pos") / size))
    library = library.select(key, F.explode(pieces).alias("_piece"), *record, F.col(rul).alias("_life"))
    packed = library.groupBy(key, "_piece").agg(_packed(F.collect_list(F.struct(*record, "_life")), channels, "_life").alias("piece"))
    kind = test.select(key).schema[0].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    schema = f"_tail {name}, match_id {name}, win long, m long, distance double, rul_at_match double"
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if count * window * width <= bound:
        shared = spark.sparkContext.broadcast(_unpacked(tails.toArrow(), width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _Nearest(*shared.value, top, size)
            for batch in batches:
                search.add(batch, width)
            yield from _batch(search.rows(), arrow).to_batches()

        # few tasks: each returns `top` rows a tail
        parts = max(1, min(spread, 3 * spark.sparkContext.defaultParallelism))
        near = packed.repartition(parts, key, "_piece").select(key, "piece").mapInArrow(run, schema)
    else:
        blocks = -(-count // max(TAILS, bound // (window * width)))
        parts = max(spread, -(-(rows or train.count()) * width // BROADCAST_VALUES))
        block, part = F.pmod(F.xxhash64("_tail"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64(key, "_piece"), F.lit(parts)).cast("int")
        left = tails.select(block.alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), "_tail", "_v")
        right = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), part.alias("_part"), F.col(key).alias("_key"), "piece")

        def compare(some: pa.Table, histories: pa.Table) -> pa.Table:
            search = _Nearest(*_unpacked(some, width), top, size)
            for batch in histories.select(["_key", "piece"]).to_batches() if some.num_rows else ():
                search.add(batch, width)
            return _batch(search.rows(), arrow)

        near = left.groupBy("_block", "_part").cogroup(right.groupBy("_block", "_part")).applyInArrow(compare, schema)
    by = Window.partitionBy("_tail").orderBy("distance", F.concat_ws(":", F.col("match_id").cast("string"), F.col("win")))
    ranked = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.select(F.col("_tail").alias(key), "rank", "match_id", (F.col("win") + F.col("m") - 1).alias("position"), "distance", "rul_at_match")


def match_remaining_life(test: DataFrame, train: DataFrame, key: str, order: Sequence[str], channels: Sequence[str],
                         rul: str, **kw) -> DataFrame:
    """Predict each test object's remaining life from its nearest training segments, by inverse distance.

    When every match is exact the plain mean is taken; objects without a match get NULL.
    """
    found = segment_matches(test, train, key, order, channels, rul, **kw)
    weight = F.lit(1.0) / (F.col("distance") + F.lit(1e-10))
    best = found.groupBy(key).agg(
        F.max("distance").alias("_far"), F.min("distance").alias("min_distance"),
        F.avg("rul_at_match").alias("_plain"),
        (F.sum(F.col("rul_at_match") * weight) / F.sum(weight)).alias("_weighted"))
    best = best.select(key, "min_distance",
                       F.when(F.col("_far") == 0, F.col("_plain")).otherwise(F.col("_weighted")).alias("predicted_rul"))
    return test.select(key).distinct().join(best, key, "left")


def errors(df: DataFrame, predicted: str = "predicted_rul", true: str = "true_rul",
           warning: float = 50.0) -> DataFrame:
    """Prediction errors (RMSE, MAE, asymmetric score) and detection counts; NULL predictions are left out."""
    e = F.col(predicted) - F.col(true)
    known = df.where(F.col(predicted).isNotNull())
    fired, due = F.col(predicted) <= warning, F.col(true) <= warning
    # fixed values: scale 13 for early, 10 for late predictions
    penalty = F.when(e < 0, F.exp(-e / 13.0) - 1.0).otherwise(F.exp(e / 10.0) - 1.0)
    return known.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(penalty).alias("score"),
                     F.count_if(fired & due).alias("tp"), F.count_if(fired & ~due).alias("fp"),
                     F.count_if(~fired & due).alias("fn"), F.count_if(~fired & ~due).alias("tn"))
