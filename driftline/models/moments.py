"""Counts, sums and products of many features per group, added up in slices.

Every task reduces its rows to one triangle of products per group and hands it on in slices of a few thousand numbers; slices of one
place are added 64 tasks at a time, then together. So no adding task and no message is larger than some slices, whatever the
number of features, and what is left is one triangle per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SLICE, FAN, HELD = 4_096, 64, 64 << 20        # numbers a slice, tasks added at a time, bytes of products a task holds


@dataclass(frozen=True)
class Packed:
    """Features that are the items of one array column, in the order of `names`."""

    column: str
    names: Sequence[str]


def feature_columns(features: Sequence[str], packed: Packed | None) -> list[Column]:
    if packed is None:
        return [F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]
    return [F.col(packed.column).cast("array<double>").alias("_f")]


def feature_matrix(features: Sequence[str], packed: Packed | None) -> Callable[[Sequence[pa.Array]], np.ndarray]:
    """The values of `feature_columns` as a matrix (unknown: NaN) inside a task."""
    if packed is None:
        return lambda columns: np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
    width, at = len(packed.names), [list(packed.names).index(f) for f in features]
    whole = at == list(range(width))

    def matrix(columns: Sequence[pa.Array]) -> np.ndarray:
        x = columns[0].flatten().to_numpy(zero_copy_only=False).reshape(len(columns[0]), width)
        return x if whole else x[:, at]
    return matrix


def _merged(parts: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and squared deviations of several sets of rows together."""
    n, mean, square = parts[0]
    for m, other, more in parts[1:]:
        total = np.maximum(n + m, 1.0)
        away = np.where(m > 0, np.where(n > 0, other - mean, 0.0), 0.0)
        square = square + more + away * away * (n * m / total)
        mean = np.where(n > 0, mean + away * (m / total), other)
        n = n + m
    return n, mean, square


def packed_stats(df: DataFrame, packed: Packed) -> dict[str, tuple[float, float]]:
    """`scale.fit_stats` of packed features: mean and population deviation, unknown values left out, 64 tasks' results put together at a time."""
    d = len(packed.names)
    matrix = feature_matrix(packed.names, packed)
    schema = "_n array<double>, _m array<double>, _s array<double>"

    def table(found: tuple, **more) -> pa.Table:
        return pa.table({c: pa.array([v], pa.list_(pa.float64())) for c, v in zip(("_n", "_m", "_s"), found)} | {c: pa.array([v], pa.int64()) for c, v in more.items()})

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, held = TaskContext.get().partitionId() // FAN, (np.zeros(d),) * 3
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.columns)
            known = ~np.isnan(x)
            n = known.sum(axis=0).astype(float)
            # deviations from a value of the column: a constant one has exact zeros
            first = x[known.argmax(axis=0), np.arange(d)]
            with np.errstate(all="ignore"):
                y = np.where(known, x - first, 0.0)
                mean = y.sum(axis=0) / np.maximum(n, 1.0)
                y = np.where(known, y - mean, 0.0)
                held = _merged([held, (n, np.where(n > 0, first + mean, 0.0), np.einsum("ij,ij->j", y, y))])
        yield from table(held, _near=near).to_batches()

    def merge(some: pa.Table) -> pa.Table:
        parts = [tuple(np.array(r[c]) for c in ("_n", "_m", "_s")) for r in some.select(["_n", "_m", "_s"]).to_pylist()]
        with np.errstate(all="ignore"):
            return table(_merged(parts))

    sums = df.select(*feature_columns(packed.names, packed)).mapInArrow(reduce, schema + ", _near long")
    rows = sums.groupBy("_near").applyInArrow(merge, schema).collect()
    n, mean, square = (_merged([tuple(np.array(v) for v in r) for r in rows]) if rows else (np.zeros(d),) * 3)
    return {f: (float(mean[i]), float(np.sqrt(square[i] / n[i])) if n[i] else 0.0) for i, f in enumerate(packed.names)}


def _groups(batch: pa.RecordBatch, count: int) -> tuple[list[tuple], np.ndarray]:
    """The keys in the first `count` columns and each row's key by number; unknown is a key like any other."""
    code = np.zeros(batch.num_rows, np.int64)
    for i in range(count):
        enc = batch.column(i).dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(enc.dictionary) + 1) + enc.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, of = np.unique(code, return_index=True, return_inverse=True)
    return [tuple(batch.column(i)[int(r)].as_py() for i in range(count)) for r in first], of


def _adder(by: Sequence[str], schema: pa.Schema):
    def add(table: pa.Table) -> pa.Table:
        rows = table.column("_s").combine_chunks()
        total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
        row = {c: table.column(c)[0].as_py() for c in [*by, "_part"]} | {"_n": sum(table.column("_n").to_pylist()), "_s": total}
        return pa.table([pa.array([row[f.name]], f.type) for f in schema], schema=schema)
    return add


def packed_sums(rows: DataFrame, by: Sequence[str], features: Sequence[str], change: Callable[[np.ndarray], np.ndarray] | None = None,
                packed: Packed | None = None) -> DataFrame:
    """(by..., _part, _n, _s): slice `_part` of a group's sums of the features, then of their products (upper triangle by rows), over `_n` rows.

    Features hold no unknown values. Values should be near zero (standardised or centred), which keeps the sums well conditioned.
    Inside the tasks `change` turns the features' columns (unknown: NaN) into such ones.
    """
    by, d, k = list(by), len(features), len(by)
    rows, matrix = rows.select(*by, *feature_columns(features, packed)), feature_matrix(features, packed)
    kinds = "".join(f"`{c}` {t}, " for c, t in rows.select(*by).dtypes)
    schema = kinds + "_part int, _n long, _s array<double>"
    upper = np.triu_indices(d)
    keys = to_arrow_schema(rows.select(*by).schema)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = TaskContext.get().partitionId() // FAN
        held: dict[tuple, list] = {}

        def packed() -> Iterator[pa.RecordBatch]:
            for key, (n, sums, products) in held.items():
                whole = np.concatenate([sums, products[upper]])
                parts = [whole[i:i + SLICE] for i in range(0, len(whole), SLICE)]
                cols = [pa.array([v] * len(parts), f.type) for v, f in zip(key, keys)]
                cols += [pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64())), pa.array([near] * len(parts), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [*by, "_part", "_n", "_s", "_near"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.columns[k:]) if d else np.zeros((batch.num_rows, 0))
            if change and d:
                x = change(x)
            names, of = _groups(batch, k)
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=len(names)))
            for key, lo, hi in zip(names, np.concatenate([[0], ends[:-1]]), ends):
                if key not in held and (len(held) + 1) * d * d * 8 > HELD:
                    yield from packed()
                    held.clear()
                part = x[order[lo:hi]]
                own = held.setdefault(key, [0, np.zeros(d), np.zeros((d, d))])
                own[0] += len(part)
                own[1] += part.sum(axis=0)
                own[2] += part.T @ part
        yield from packed()

    out = rows.mapInArrow(reduce, schema + ", _near long")
    plain = to_arrow_schema(out.drop("_near").schema)
    for salt in (["_near"], []):
        out = out.groupBy(*by, "_part", *salt).applyInArrow(_adder(by, plain), schema)
    return out


def add_arrays(df: DataFrame, by: Sequence[str], spread: str, fan: int = 256) -> DataFrame:
    """(by..., _n, _s) added up by `by`: arrays of one length per group, `fan` lots by the hash of `spread` first."""
    by, one = list(by), df.select(*by, F.lit(0).alias("_part"), "_n", "_s", F.pmod(F.xxhash64(spread), F.lit(fan)).alias("_near"))
    kinds = "".join(f"`{c}` {t}, " for c, t in df.select(*by).dtypes) + "_part int, _n long, _s array<double>"
    plain = to_arrow_schema(one.drop("_near").schema)
    for salt in (["_near"], []):
        one = one.groupBy(*by, "_part", *salt).applyInArrow(_adder(by, plain), kinds)
    return one.select(*by, "_n", "_s")
