"""Rows with or without a key of another table, with only the rows that may have one leaving their place.

Up to `few` keys are broadcast, by a count. Beyond that a Bloom filter of the keys is: tasks set bits by range, ranges are merged by many tasks,
and the filter has at most `max_bits` bits. Rows that it excludes stay where they are; only the others are joined with the keys. A
full filter lets more rows into that join, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import binary, fresh, map_arrow, mix

FEW, MAX_BITS, RANGE_BITS, PROBES = 500_000, 2 ** 28, 20, 3


class Members:
    """A Bloom filter of 64-bit keys."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def maybe(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for k in range(PROBES):
            at = places(h, k, self.bits)
            out &= (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def places(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (mix(h + np.uint64((probe + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def filter_of(keys: DataFrame, n: int, max_bits: int = MAX_BITS):
    """Broadcast `Members` of the n keys (a frame of one long column)."""
    bits = int(min(max(RANGE_BITS, (10 * max(n, 1)).bit_length()), np.log2(max_bits)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate([places(h, k, bits) for k in range(PROBES)]))
            cut = np.searchsorted(at, np.arange(0, (1 << bits) + 1, 1 << RANGE_BITS))
            some = np.flatnonzero(np.diff(cut)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), binary([(at[cut[r]:cut[r + 1]] & ((1 << RANGE_BITS) - 1)).astype(np.uint32).tobytes() for r in some])], ["range", "at"])

    def merge(table: pa.Table) -> pa.Table:
        on = np.zeros(1 << RANGE_BITS, bool)
        for value in table.column("at"):
            on[np.frombuffer(value.as_buffer(), np.uint32)] = True
        return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int32()), "bits": binary([np.packbits(on, bitorder="little").tobytes()])})

    table, size = np.zeros(1 << (bits - 3), np.uint8), 1 << (RANGE_BITS - 3)
    for r in map_arrow(keys, partial, "range int, at binary").groupBy("range").applyInArrow(merge, "range int, bits binary").toLocalIterator(prefetchPartitions=True):
        table[r["range"] * size:][:size] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(Members(bits, table))


def screened(df: DataFrame, on: list[str], shared, inside: bool) -> DataFrame:
    """The rows of df that the filter lets through, or those that it excludes."""
    (h,), own = fresh(df, "h"), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = shared.value.maybe(batch.column(h).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(mask if inside else ~mask)).select(own)

    return map_arrow(df.withColumn(h, F.xxhash64(*on)), run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes))


def matched(df: DataFrame, keys: DataFrame, on: list[str], how: str, few: int = FEW, max_bits: int = MAX_BITS) -> DataFrame:
    """df.join(keys, on, how) for `inner`, `left_semi` and `left_anti`; keys (written, columns `on` not null and unique)."""
    n = keys.count()
    if n <= few:
        return df.join(F.broadcast(keys), on, how)
    shared = filter_of(keys.select(F.xxhash64(*on).alias("h")), n, max_bits)
    likely = screened(df, on, shared, True).join(keys, on, how)
    return likely.unionByName(screened(df, on, shared, False)) if how == "left_anti" else likely
