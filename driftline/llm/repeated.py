"""A Bloom filter of the 64-bit keys that occur more than once.

Keys are dealt to ranges of about `RANGE_KEYS` and sent as `LOW_BITS` further bits, sorted, so that a key takes about two bytes; a task sends equal ones
once.
One task per range finds those sent twice and sets their bits in the range's part of the filter. Keys that occur once never enter it, so its bits are for
the repeated ones alone, and only the filter (at most `max_bits` bits) passes through the driver. A key that occurs twice is always let through; a
fuller filter lets more of the others through (and equal bits of different keys about one in 128), and an exact pass behind it sees more rows, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftline.llm.common import binary, map_arrow, mix, pack, pieces, unpack

RANGE_KEYS, LOW_BITS = 1 << 17, 24
FLUSH = 1_000_000                   # keys a task holds before it sends them
PROBES = 4
LEAST_BITS = 16                     # log2 of the bits of a range, at least


def _split(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range (upper bits) and the bits behind it of each key, in one number."""
    return mix(keys.copy()) >> np.uint64(64 - LOW_BITS - ranges)


def _places(low: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (mix(low.astype(np.uint64) + np.uint64((probe + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


class Repeated:
    """Which keys may occur more than once. `ranges` and `bits` are log2 of the ranges, and of the bits of each."""

    def __init__(self, ranges: int, bits: int, table: np.ndarray):
        self.ranges, self.bits, self.table = ranges, bits, table

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        f = _split(keys, self.ranges)
        first = (f >> np.uint64(LOW_BITS)).astype(np.int64) << self.bits
        out = np.ones(len(keys), bool)
        for k in range(PROBES):
            at = first + _places(f & np.uint64((1 << LOW_BITS) - 1), k, self.bits)
            out &= (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _sorted_bytes(low: np.ndarray) -> bytes:
    return pack([np.diff(low, prepend=np.uint32(0))])


def _from_bytes(value: pa.Scalar) -> np.ndarray:
    step, = unpack(value, [np.uint32])
    return np.cumsum(step, dtype=np.uint32)


def _partial(keys: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    f = np.sort(_split(keys, ranges))
    new = np.ones(len(f) + 1, bool)
    new[1:-1] = f[1:] != f[:-1]
    more = ~new[1:][new[:-1]]
    f = f[new[:-1]]
    cut = np.searchsorted(f, np.arange((1 << ranges) + 1, dtype=np.uint64) << np.uint64(LOW_BITS))
    low = (f & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint32)
    some = np.flatnonzero(np.diff(cut)).tolist()
    parts = [(low[cut[r]:cut[r + 1]], more[cut[r]:cut[r + 1]]) for r in some]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), binary([_sorted_bytes(x[~m]) for x, m in parts]), binary([_sorted_bytes(x[m]) for x, m in parts])], ["range", "ones", "more"])


def _merge(bits: int):
    def merge(table: pa.Table) -> pa.Table:
        more = [_from_bytes(v) for v in table.column("more")]
        low = np.sort(np.concatenate([*(_from_bytes(v) for v in table.column("ones")), *more, *more]))
        low = low[1:][low[1:] == low[:-1]]
        on = np.zeros(1 << bits, bool)
        for k in range(PROBES):
            on[_places(low, k, bits)] = True
        return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int32()), "bits": binary([np.packbits(on, bitorder="little").tobytes()])})
    return merge


def repeated(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], expected: int, max_bits: int):
    """Broadcast `Repeated` over keys(slice) of all rows of `df` (a frame with a `text` column): about two bits for each expected key."""
    ranges = min(max(1, int(max(expected, 1) // RANGE_KEYS).bit_length()), int(max_bits).bit_length() - 1 - LEAST_BITS)
    bits = max(LEAST_BITS, int(min(2 * max(expected, 1), max_bits)).bit_length() - 1 - ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in pieces(batch):
                held.append(keys(part))
                n += len(held[-1])
                if n >= FLUSH:
                    yield from _partial(np.concatenate(held), ranges)
                    held, n = [], 0
        if n:
            yield from _partial(np.concatenate(held), ranges)

    table, size = np.zeros(1 << (ranges + bits - 3), np.uint8), 1 << (bits - 3)
    sent = map_arrow(df, run, "range int, ones binary, more binary")
    for r in sent.groupBy("range").applyInArrow(_merge(bits), "range int, bits binary").toLocalIterator(prefetchPartitions=True):
        table[r["range"] * size:][:size] = np.frombuffer(r["bits"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(Repeated(ranges, bits, table))
