"""Rank correlation of every prefix of a history, without ranking the prefixes again.

With w(p, q) = 1 for p < q, 1/2 for equal values and 0 else, the mean rank of a value in a prefix is 1/2 plus the sum of w over the
prefix, and the covariance of the ranks of k pairs is k times less than Q - k^3 / 4, where Q sums w(a_i, a_j) * w(b_l, b_j) over all i, j, l
of the prefix. Q grows by sums over what is already there, so pairs are added in blocks: earlier pairs are counted once per block in
a table of the block's own values (how many lie above each pair of them), and only pairs inside a block meet one by one. A history of n pairs
takes n / block passes over its earlier part and n * block steps inside, about n^1.5 in all, and six numbers for each pair in memory.
The spread of the ranks depends on ties only: a value seen t times before adds 3t^2 + 3t to the tie term.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 32          # histories up to this length are done together, all of one length at once


def _share(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """w(first, second), elementwise."""
    return ((first < second) * 1.0 + (first <= second)) / 2


def _seen(x: np.ndarray) -> np.ndarray:
    """How often each value came before."""
    order = np.argsort(x, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]]))
    out = np.empty(len(x))
    out[order] = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    return out


def _rho(q: np.ndarray, ties_a: np.ndarray, ties_b: np.ndarray, k: np.ndarray) -> np.ndarray:
    spread = lambda ties: np.maximum((k ** 3 - k) / 12 - ties / 12, 0.0)
    scale = np.sqrt(spread(ties_a) * spread(ties_b))
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = (q - k ** 3 / 4) / scale
    return np.where((k < 3) | (scale == 0), 0.0, rho)


def _short(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(histories, n) values -> (histories, n) correlations; entry k is that of the first k + 1 pairs."""
    n = a.shape[1]
    ranks = [np.cumsum(_share(x[:, :, None], x[:, None, :]), axis=1) for x in (a, b)]                 # [., k, j]: sum over i <= k
    q = (ranks[0] * ranks[1] * np.tri(n)).sum(axis=2)
    ties = [np.cumsum(3 * t ** 2 + 3 * t, axis=1) for t in (np.tril(x[:, :, None] == x[:, None, :], -1).sum(axis=2).astype(float) for x in (a, b))]
    return _rho(q, *ties, np.arange(1.0, n + 1))


def prefix_rhos(a: np.ndarray, b: np.ndarray, block: int | None = None) -> np.ndarray:
    """The rank correlation of the first k + 1 pairs, for every k; 0 for fewer than three pairs and where a side is constant."""
    n = len(a)
    if not n:
        return np.zeros(0)
    block = block or int(np.clip(np.sqrt(n), 32, 1024))
    have_a, have_b, q, out = np.zeros(n), np.zeros(n), 0.0, np.empty(n)                                # sums of w over what is there
    for lo in range(0, n, block):
        x, y, m = a[lo:lo + block], b[lo:lo + block], min(block, n - lo)
        inside = [np.cumsum(_share(v[:, None], v[None, :]), axis=0) for v in (x, y)]
        added = np.zeros(m)
        if lo:
            grown = np.zeros((m, m))
            places, linear, earlier = [], [], []
            for v, old, weight in ((x, a[:lo], have_b[:lo]), (y, b[:lo], have_a[:lo])):
                order = np.argsort(v, kind="stable")
                below, upto = np.searchsorted(v[order], old, "left"), np.searchsorted(v[order], old, "right")
                places.append((order, below, upto))
                # the weights of what lies above each new value, and how many earlier values lie below it
                heavy = (np.bincount(below, weight, m + 1) + np.bincount(upto, weight, m + 1)) / 2
                count = (np.bincount(below, minlength=m + 1) + np.bincount(upto, minlength=m + 1)) / 2
                above, number = np.empty(m), np.empty(m)
                above[order], number[order] = heavy[::-1].cumsum()[::-1][1:], count[::-1].cumsum()[::-1][1:]
                linear.append(above)
                earlier.append(lo - number)
            (oa, la, ua), (ob, lb, ub) = places
            table = sum(np.bincount(p * (m + 1) + r, minlength=(m + 1) ** 2) for p in (la, ua) for r in (lb, ub)).reshape(m + 1, m + 1) / 4
            grown[np.ix_(oa, ob)] = table[::-1, ::-1].cumsum(axis=0).cumsum(axis=1)[::-1, ::-1][1:, 1:]
            added = np.cumsum(linear[0]) + np.cumsum(linear[1]) + np.diagonal(grown.cumsum(axis=0).cumsum(axis=1))
            inside = [s + e[None, :] for s, e in zip(inside, earlier)]
            have_a[:lo] += (la + ua) / 2
            have_b[:lo] += (lb + ub) / 2
        out[lo:lo + m] = q + added + (inside[0] * inside[1] * np.tri(m)).sum(axis=1)
        q += added[-1]
        have_a[lo:lo + m], have_b[lo:lo + m] = inside[0][-1], inside[1][-1]
        q += float(have_a[lo:lo + m] @ have_b[lo:lo + m])
    ties = [np.cumsum(3 * t ** 2 + 3 * t) for t in (_seen(a), _seen(b))]
    return _rho(out, *ties, np.arange(1.0, n + 1))


def prefix_correlation(df: DataFrame, key: Sequence[str], pos: str, x: str, y: str, name: str = "rho", *, rows_per_task: int = 500_000, rows: int | None = None) -> DataFrame:
    """(key, pos, name): the rank correlation of x and y over the object's pairs up to this record; pairs with a missing side are left out.

    `pos` is whole and unique within an object. A task takes whole objects in order; it holds one batch and, of an object that goes on in the next one, its pairs.
    """
    key, spark = list(key), df.sparkSession
    pairs = df.select(*key, F.col(pos).cast("long").alias(pos), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pairs = pairs.where("_x IS NOT NULL AND _y IS NOT NULL AND NOT isnan(_x) AND NOT isnan(_y)").withColumn("_key", F.xxhash64(*key, F.lit(7)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // rows_per_task))
    ordered = pairs.repartition(parts, *key).sortWithinPartitions(*key, pos)
    types = dict(pairs.dtypes)

    def finish(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        a, b = table.column("_x").to_numpy(), table.column("_y").to_numpy()
        out, size = np.empty(len(a)), ends - starts
        for n in np.unique(size[size <= SHORT]).tolist():
            some = starts[size == n]
            for lo in range(0, len(some), max(1, 2_000_000 // n ** 2)):
                at = some[lo:lo + max(1, 2_000_000 // n ** 2), None] + np.arange(n)
                out[at] = _short(a[at], b[at])
        for s, e in zip(starts[size > SHORT].tolist(), ends[size > SHORT].tolist()):
            out[s:e] = prefix_rhos(a[s:e], b[s:e])
        kept = table.select([*key, pos]).append_column(name, pa.array(out)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns], kept.column_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            mark, at = table.column("_key").to_numpy(), table.column(pos).to_numpy()
            new = np.flatnonzero((mark[1:] != mark[:-1]) | (at[1:] <= at[:-1])) + 1     # places rise within an object
            goes_on = bool(held) and held[-1].column("_key")[-1].as_py() == mark[0] and held[-1].column(pos)[-1].as_py() < at[0]
            if held and not goes_on:
                whole = pa.concat_tables(held)
                yield finish(whole, np.array([0]), np.array([whole.num_rows]))
                held = []
            last = int(new[-1]) if len(new) else 0
            if last:
                first = pa.concat_tables([*held, table.slice(0, last)])
                extra = first.num_rows - last
                edge = np.concatenate([[0], new + extra])
                yield finish(first, edge[:-1], edge[1:])
                held = []
            held.append(table.slice(last))
        if held:
            whole = pa.concat_tables(held)
            yield finish(whole, np.array([0]), np.array([whole.num_rows]))

    return ordered.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in [*key, pos]) + f", `{name}` double")
