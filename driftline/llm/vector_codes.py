"""Vector codes: product quantisation in whole numbers, nearest entries found with LAESA pivots.

A component x becomes floor(1024 * x); vectors are cut into equal consecutive parts, and each part position has a codebook. Its pivots are
chosen once among the entries it starts with (each the farthest from those before it). The distances from every part to its pivots are
computed once and written next to the vectors; a round computes only the distances from pivots to entries. Their differences bound the distance
from a part to an entry from below: entries are taken in the order of that bound, in lots of growing size, and a part is done once the next bound is above the best
exact distance. Bounds are floating point less a margin, distances are whole numbers, so the result is that of comparing everything.

Every round reads the written table, with the codebooks (parts x entries, a fixed size) sent along; tasks add up members of entries, and the driver
gets one row per entry. Nothing else reaches it but the starting entries.

Whole numbers are 64-bit while components stay within 2^20, else Python's; sums travel in limbs of 40 bits, so they are exact for any size.

Defined cases: null vectors, and vectors with null or non-finite components, are dropped, as are empty ones and ones whose length is not the most frequent
among those that can be cut (of equally frequent ones the shortest); a null vec_id sorts before all others; rows with equal ids are ordered by
vector and each count; with fewer rows than entries every row starts an entry; equal parts go to the entry with the lower index; an empty table gives no rows; an error beyond
a long is null, and so is the sum of its label; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import discard, map_arrow, store

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 1024, 4, 256, 4, 8
BLOCK, LIMB, LARGE, SALT, SMALL_LABELS = 1_024, 40, 1 << 20, 16, 10_000
OUT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def whole(x: np.ndarray, large: bool) -> np.ndarray:
    """floor(1024 * x), exact; Python's whole numbers if `large`."""
    if not large:
        return np.floor(x * float(SCALE)).astype(np.int64)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) * SCALE if abs(v) >= 2.0 ** 60 else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows."""
    d = a - b
    return (d * d).sum(axis=-1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def choose_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """n of the entries, each with the largest distance to those chosen before; equal ones may be chosen when others run out."""
    chosen, least = [0], roots(squares(entries, entries[:1]))
    while len(chosen) < n:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, roots(squares(entries, entries[chosen[-1]][None])))
    return entries[chosen]


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) distances of one part position."""
    return np.stack([roots(squares(parts, p[None])) for p in pivots], axis=1)


def nearest(parts: np.ndarray, near: np.ndarray, entries: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of every part, the squared distance, and how many distances were computed.

    near: distances from parts to pivots; far: (entries, pivots) distances from entries to pivots."""
    m, e = len(parts), len(entries)
    bound = np.zeros((m, e))
    for p in range(far.shape[1]):
        np.maximum(bound, np.abs(near[:, p, None] - far[None, :, p]), out=bound)
    bound -= 1e-6 * (near.max(axis=1)[:, None] + far.max(axis=1)[None])          # stored distances have 24 bits
    order = np.argsort(bound, axis=1)
    bound = np.take_along_axis(bound, order, axis=1)
    best = np.full(m, -1, parts.dtype)                                          # distance * entries + entry: the smaller, the nearer
    limit = np.full(m, np.inf)
    active, at, lot, done = np.arange(m), 0, 2, 0
    while len(active):
        r, c = np.nonzero(bound[active, at:at + lot] <= limit[active, None])
        rows = active[r]
        found = order[rows, c + at]
        key = squares(parts[rows], entries[found]) * e + found
        done += len(key)
        sort = np.lexsort((key, rows)) if key.dtype != object else np.array(sorted(range(len(key)), key=lambda k: (rows[k], key[k])), np.int64)
        first = sort[np.flatnonzero(np.diff(rows[sort], prepend=-1))]
        old, new = best[rows[first]], key[first]
        best[rows[first]] = np.where((old < 0) | (new < old), new, old)
        limit[active] = np.sqrt((best[active] // e).astype(np.float64)) * (1 + 1e-9)
        at, lot = at + lot, lot * 2
        active = active[bound[active, at] <= limit[active]] if at < e else active[:0]
    return (best % e).astype(np.int64), best // e, done


class Books:
    """Codebooks of all part positions with their pivots, as sent to the tasks of a round."""

    def __init__(self, books: list[np.ndarray], pivots: list[np.ndarray], large: bool):
        self.books, self.pivots, self.large, self.n = books, pivots, large, len(books)
        self.far = [pivot_distances(b, p) for b, p in zip(books, pivots)]

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, int]]:
        """Of every block of rows: its start, the parts, (rows, parts) entries and squared distances, and distances computed."""
        for lo in range(0, batch.num_rows, BLOCK):
            some = batch.slice(lo, BLOCK)
            cut = np.split(whole(_matrix(some.column("v")), self.large), self.n, axis=1)
            near = np.split(_matrix(some.column("pivot")), self.n, axis=1)
            found = [nearest(x, d, b, f) for x, d, b, f in zip(cut, near, self.books, self.far)]
            yield lo, cut, np.stack([x for x, _, _ in found], axis=1), np.stack([x for _, x, _ in found], axis=1), sum(x for _, _, x in found)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _limbs(value: int, n: int) -> list[int]:
    sign, value = (-1, -value) if value < 0 else (1, value)
    return [sign * (value >> LIMB * k & (1 << LIMB) - 1) for k in range(n)]


def kept(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int, float]:
    """(vec_id, label, v) of usable rows, their length (0: there are none) and the largest component's size."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").alias("v")).where(F.col("v").isNotNull() & finite)
    size = F.size("v")
    most = (rows.where((size > 0) & (size % parts == 0)).groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).cast("double").alias("most"))
            .orderBy(F.desc("n"), "d").first())
    if most is None:
        return rows, 0, 0.0
    return rows.where(size == most.d), most.d, most.most


def _entry_sums(books: Books, limbs: int):
    """Rows -> per task one row for each used entry: part, entry, members, and their sums in limbs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = object if books.large else np.int64
        total = [np.zeros(b.shape, kind) for b in books.books]
        count = [np.zeros(len(b), np.int64) for b in books.books]
        work = 0
        for batch in batches:
            for _, cut, index, _, done in books.blocks(batch):
                work += done
                for p in range(books.n):
                    np.add.at(total[p], index[:, p], cut[p])
                    count[p] += np.bincount(index[:, p], minlength=len(count[p]))
        used = [(p, k) for p in range(books.n) for k in np.flatnonzero(count[p]).tolist()]
        if used:
            sums = [[x for v in total[p][k].tolist() for x in _limbs(v, limbs)] for p, k in used]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in used], pa.int32()), pa.array([k for _, k in used], pa.int32()), pa.array([int(count[p][k]) for p, k in used], pa.int64()),
                                              pa.array(sums, pa.list_(pa.int64())), pa.array([work if u == 0 else 0 for u in range(len(used))], pa.int64())], ["part", "entry", "n", "s", "work"])
    return run


def codebooks(rows: DataFrame, parts: int, entries: int, rounds: int, pivots: int, dims: int, most: float) -> tuple[DataFrame, Books, list[int]]:
    """The rows with their pivot distances (written), the final codebooks, and the distances computed in each round."""
    spark, width, large = rows.sparkSession, dims // parts, most * SCALE >= LARGE or dims // parts > 1_024
    start = rows.orderBy(F.asc_nulls_first("vec_id"), "v", F.asc_nulls_first("label")).limit(entries).select("v").collect()
    books = np.split(whole(np.array([r.v for r in start], np.float64), large), parts, axis=1)
    fixed = [choose_pivots(b, min(pivots, len(b))) for b in books]
    n_pivots = len(fixed[0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                some = batch.slice(lo, BLOCK)
                cut = np.split(whole(_matrix(some.column("v")), large), parts, axis=1)
                near = np.concatenate([pivot_distances(x, p) for x, p in zip(cut, fixed)], axis=1).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * (parts * n_pivots)), pa.array(near if large else near.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], [*some.schema.names, "pivot"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + f", pivot array<{'double' if large else 'float'}>"
    stored = store(map_arrow(rows, measure, schema), "vectors")
    limbs = 1 if not large else -(-int(np.ceil(np.log2(max(most, 1.0)) + 10 + 64)) // LIMB)
    work = []
    for _ in range(rounds):
        sums = map_arrow(stored.select("v", "pivot"), _entry_sums(Books(books, fixed, large), limbs), "part int, entry int, n long, s array<long>, work long")
        found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[k]) for k in range(width * limbs)]).alias("s"), F.sum("work").alias("work")).collect()
        books = [b.copy() for b in books]
        for r in found:
            total = [sum(x << LIMB * k for k, x in enumerate(r.s[limbs * d:limbs * (d + 1)])) for d in range(width)]
            books[r.part][r.entry] = [t // r.n for t in total]
        work.append(sum(r.work for r in found))
    return stored, Books(books, fixed, large), work


def coded(stored: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, index, squared, _ in books.blocks(batch):
                some = batch.slice(lo, BLOCK)
                raw = index.astype(np.uint8).tobytes().hex()
                step = 2 * books.n
                error = [x if x < 2 ** 63 else None for x in squared.sum(axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array([raw[step * k:step * (k + 1)] for k in range(some.num_rows)]), pa.array(error, pa.int64())],
                                                 ["vec_id", "label", "code", "error"])

    types = dict(stored.dtypes)
    return map_arrow(stored.select("vec_id", "label", "v", "pivot"), run, f"vec_id long, label {types['label']}, code string, error long")


def _with_label_errors(rows: DataFrame, small: int) -> DataFrame:
    """rows (vec_id, label, code, error) with label_error. The totals are broadcast if they are few, by a count; else labels are salted, as one may hold most rows."""
    whole_sum = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    totals = rows.groupBy(F.col("label").alias("_label")).agg(whole_sum.alias("label_error"))
    few = totals.limit(small + 1).count() <= small
    if few:
        return rows.join(F.broadcast(totals), rows.label.eqNullSafe(totals["_label"])).select("vec_id", "code", "error", "label_error")
    salted = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = rows.withColumn("_at", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int"))
    return dealt.join(salted, dealt.label.eqNullSafe(salted["_label"]) & (F.col("_at") == F.col("_salt"))).select("vec_id", "code", "error", "label_error")


def report(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS, small_labels: int = SMALL_LABELS) -> DataFrame:
    """vec_id, code, error, label_error and the codebooks' digest of every usable row."""
    if not 1 <= entries <= 256:
        raise ValueError("an index is written as two hex digits: at most 256 entries")
    rows, dims, most = kept(vectors, parts)
    if not dims:
        return vectors.sparkSession.createDataFrame([], OUT)
    stored, books, _ = codebooks(rows, parts, entries, rounds, pivots, dims, most)
    out = store(coded(stored, books), "codes")
    discard(stored)
    digest = hashlib.sha256(",".join(str(int(x)) for b in books.books for x in b.ravel().tolist()).encode()).hexdigest()
    return _with_label_errors(out, small_labels).withColumn("codebooks_sha256", F.lit(digest))
