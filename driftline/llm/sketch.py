"""A count-min sketch of 64-bit keys, built per partition, merged by counter range, and kept as one bit per counter.

The bit says that at least two keys were counted there. A key that occurs twice anywhere therefore has all of its bits set:
the estimate is never below the true count, so nothing that repeats is lost. Unset bits prove that a key is unique.
Partition sketches travel sparsely (positions of non-zero counters), sums are made per range of counters by many
tasks, and only the merged bits (at most `max_bits` per row, two rows) pass through the driver. Beyond that size the bits fill up: more unique
keys pass the filter and the exact second pass sees more rows, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import binary, map_arrow, pieces

ROWS = 2
RANGE_BITS = 20                     # counters per range
FLUSH = 1_000_000                   # keys of one partition sketch


def width_bits(keys: int, max_bits: int = 2 ** 28) -> int:
    """log2 of the counters of one row: about eight for each expected key."""
    return int(min(np.log2(max_bits), max(RANGE_BITS, int(8 * max(keys, 1)).bit_length())))


def _positions(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h >> np.uint64(row * 32)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _partial(keys: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    part, ones, more = [], [], []
    for row in range(ROWS):
        at = np.sort(_positions(keys, row, bits))
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(at))) > 1
        at = at[first]
        cut = np.searchsorted(at, np.arange(0, (1 << bits) + 1, 1 << RANGE_BITS))
        for r in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[r], cut[r + 1])
            low = (at[s] & ((1 << RANGE_BITS) - 1)).astype(np.uint32)
            part.append(row << (bits - RANGE_BITS) | r)
            ones.append(low[~many[s]].tobytes())
            more.append(low[many[s]].tobytes())
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), binary(ones), binary(more)], ["range", "ones", "more"])


def _merge(table: pa.Table) -> pa.Table:
    counts = np.zeros(1 << RANGE_BITS, np.uint8)
    for name, by in (("ones", 1), ("more", 2)):
        for value in table.column(name):
            at = np.frombuffer(value.as_buffer(), np.uint32)
            counts[at] = np.minimum(counts[at] + by, 2)
    return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int32()), "bits": binary([np.packbits(counts > 1, bitorder="little").tobytes()])})


class Repeats:
    """Which keys may occur more than once."""

    def __init__(self, bits: int, rows: list[np.ndarray]):
        self.bits, self.rows = bits, rows

    def maybe(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row, table in enumerate(self.rows):
            at = _positions(h, row, self.bits)
            out &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def repeats(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], expected: int, max_bits: int = 2 ** 28):
    """Broadcast `Repeats` over keys(slice) of all rows of `df` (a frame with a `text` column)."""
    bits = width_bits(expected, max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in pieces(batch):
                held.append(keys(part))
                n += len(held[-1])
                if n >= FLUSH:
                    yield from _partial(np.concatenate(held), bits)
                    held, n = [], 0
        if n:
            yield from _partial(np.concatenate(held), bits)

    sparse = map_arrow(df, run, "range int, ones binary, more binary")
    merged = sparse.groupBy("range").applyInArrow(_merge, "range int, bits binary")
    rows = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)]
    size, per_row = 1 << (RANGE_BITS - 3), 1 << (bits - RANGE_BITS)
    for r in merged.toLocalIterator(prefetchPartitions=True):
        rows[r["range"] // per_row][(r["range"] % per_row) * size:][:size] = np.frombuffer(r["bits"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(Repeats(bits, rows))
