"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors are compared only under equal labels. Equal vectors are one class. Each table gives a class a key of `bits` signs; classes
that share a key in some table are compared by cosine in double precision. The signs grow with the largest label, so a bucket holds about
`bucket` classes at any size, and the tables grow with the signs: a pair at the threshold 0.93 shares no key, and is missed, with
probability 1.1e-6 or less (42 tables of 10 signs, 75 of 14, 171 of 20), a closer pair less. From each unit of work come a count per
class and a spanning set of links; no list of pairs is written.

A label of up to `tables` blocks of `block_rows` classes is cut into pairs of blocks: a vector is sent once per block, and the task
builds all tables for its pair of blocks. In a larger label a vector is sent once per table, to its bucket; a pair that shares several
keys is then counted in the first one only. Buckets above `block_rows` classes are cut into pairs of blocks too.

Defined cases: a null label or vector, a zero vector, null or non-finite components: linked with nothing, component its own id,
kept; vectors of different length link with nothing; a null id sorts before all others and is returned as null; a row repeated
with its id counts as one vector; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import MISSING_ID, components, discard, map_arrow, needs, store, union_find

THRESHOLD, TABLES, BITS = 0.93, 42, 10
MISS = 1.15e-6                 # of a pair at the threshold
BUCKET = 16                    # classes that share a key by chance, about
UNIT_ROWS = 50_000             # rows of a task that compares
CHUNK = 512
MOST_HOT = 10_000              # classes, labels or buckets whose few columns are broadcast


def tables_for(largest: int, threshold: float = THRESHOLD, bucket: int = BUCKET) -> tuple[int, int]:
    """(tables, bits) for a label of `largest` classes."""
    bits = max(BITS, math.ceil(math.log2(max(largest / bucket, 1))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log1p(-same)), bits


def _planes(d: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, d)).standard_normal((d, tables * bits))


def _signs(x: np.ndarray, planes: np.ndarray, tables: int, bits: int) -> np.ndarray:
    weight = 1 << np.arange(bits, dtype=np.int64)
    out = np.empty((len(x), tables), np.int64)
    for s in range(0, len(x), 4 * CHUNK):
        part = x[s:s + 4 * CHUNK]
        out[s:s + len(part)] = ((part @ planes > 0).reshape(len(part), tables, bits) * weight).sum(axis=2)
    return out


def _keys(tables: int, bits: int, seed: int):
    """(h, keys): each class's key in every table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("embedding")
            at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset:lists.offset + len(lists) + 1].astype(np.int64) if len(lists) else np.zeros(1, np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = at - at[0]
            keys = np.zeros((batch.num_rows, tables), np.int32)
            size = np.diff(at)
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                if d not in planes:
                    planes[d] = _planes(d, tables, bits, seed)
                keys[rows] = _signs(values[at[rows][:, None] + np.arange(d)], planes[d], tables, bits)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "label", "embedding", "mult", "low")),
                                              pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))],
                                             ["h", "label", "embedding", "mult", "low", "keys"])
    return run


def _units(table: pa.Table, names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (left, right) of every unit of work: the same rows twice where a block meets itself."""
    col = {c: table.column(c).to_numpy() for c in ("h", "b", *names)}
    order = np.lexsort((col["h"], *(col[c] for c in reversed(names))))
    new = np.ones(len(order), bool)
    new[1:] = np.any([col[c][order][1:] != col[c][order][:-1] for c in names], axis=0)
    first = np.flatnonzero(new)
    for a, b in zip(first.tolist(), np.append(first[1:], len(order)).tolist()):
        rows = order[a:b]
        i, j = int(col["i"][rows[0]]), int(col["j"][rows[0]])
        left, right = (rows, rows) if i == j else (rows[col["b"][rows] == i], rows[col["b"][rows] == j])
        if len(left) and len(right) and b - a > 1:
            yield left, right


def _unit_links(h: np.ndarray, mult: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    """Per class of the linked pairs (p, q) its linked vectors, and the smallest class of its links here."""
    nodes, back = np.unique(np.concatenate([p, q]), return_inverse=True)
    u, v = back[:len(p)], back[len(p):]
    many = np.bincount(u, mult[q], len(nodes)) + np.bincount(v, mult[p], len(nodes))
    root = union_find(len(nodes), u, v)
    return pa.RecordBatch.from_arrays([pa.array(h[nodes]), pa.array(many.astype(np.int64)), pa.array(h[nodes[root]])], ["h", "n", "root"])


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = table.column("embedding").combine_chunks()
    return lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)


def _unit_vectors(at: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = int(at[rows[0] + 1] - at[rows[0]])
    x = values[at[rows][:, None] + np.arange(d)].astype(np.float64)
    return x, np.sqrt((x * x).sum(axis=1))


def _compare_blocks(threshold: float, tables: int, bits: int, seed: int):
    """Whole pairs of blocks -> links: all tables are built here for the two blocks, and every pair that shares a key is compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table, planes = pa.Table.from_batches(held).combine_chunks(), {}
        h, mult = table.column("h").to_numpy(), table.column("mult").to_numpy()
        at, values = _vectors(table)
        for left, right in _units(table, ("label", "d", "i", "j")):
            y, y_size = _unit_vectors(at, values, right)
            d = y.shape[1]
            if d not in planes:
                planes[d] = _planes(d, tables, bits, seed)
            keys = _signs(y, planes[d], tables, bits)
            order = np.argsort(keys, axis=0, kind="stable")
            ordered = np.take_along_axis(keys, order, axis=0)
            ps, qs = [], []
            for s in range(0, len(left), CHUNK):
                if left is right:
                    x, x_size, mine = y[s:s + CHUNK], y_size[s:s + CHUNK], keys[s:s + CHUNK]
                else:
                    x, x_size = _unit_vectors(at, values, left[s:s + CHUNK])
                    mine = _signs(x, planes[d], tables, bits)
                shared = np.zeros((len(x), len(y)), bool)
                for t in range(tables):
                    low, high = (np.searchsorted(ordered[:, t], mine[:, t], side) for side in ("left", "right"))
                    many = high - low
                    p = np.repeat(np.arange(len(x)), many)
                    shared[p, order[np.arange(len(p)) + np.repeat(low - (np.cumsum(many) - many), many), t]] = True
                if left is right:
                    shared &= np.arange(len(y)) > s + np.arange(len(x))[:, None]
                if shared.mean() > 0.02:                                        # dense: one product of the blocks costs less than its pairs
                    p, q = np.nonzero(shared & (x @ y.T / np.outer(x_size, y_size) >= threshold))
                else:
                    p, q = np.nonzero(shared)
                    near = np.concatenate([np.einsum("ij,ij->i", x[p[c:c + 20_000]], y[q[c:c + 20_000]]) for c in range(0, len(p), 20_000)] or [np.zeros(0)])
                    near = near / (x_size[p] * y_size[q]) >= threshold
                    p, q = p[near], q[near]
                ps.append(left[s:s + CHUNK][p])
                qs.append(right[q])
            p, q = np.concatenate(ps), np.concatenate(qs)
            if len(p):
                yield _unit_links(h, mult, p, q)
    return run


def _compare(threshold: float):
    """Whole buckets, or pairs of their blocks -> links whose first shared table this is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        h, mult, tab = (table.column(c).to_numpy() for c in ("h", "mult", "tab"))
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        at, values = _vectors(table)
        for left, right in _units(table, ("label", "tab", "key", "d", "i", "j")):
            y, y_size = _unit_vectors(at, values, right)
            ps, qs = [], []
            for s in range(0, len(left), CHUNK):
                x, x_size = _unit_vectors(at, values, left[s:s + CHUNK])
                close = x @ y.T / np.outer(x_size, y_size) >= threshold
                if left is right:
                    close &= np.arange(len(y)) > s + np.arange(len(x))[:, None]
                p, q = np.nonzero(close)
                p, q = left[s:s + CHUNK][p], right[q]
                for c in range(0, len(p), 200_000):
                    a, b = p[c:c + 200_000], q[c:c + 200_000]
                    mine = (keys[a] == keys[b]).argmax(axis=1) == tab[right[0]]      # others are counted in an earlier table
                    ps.append(a[mine])
                    qs.append(b[mine])
            if ps and sum(map(len, ps)):
                yield _unit_links(h, mult, np.concatenate(ps), np.concatenate(qs))
    return run


def _in_blocks(rows: DataFrame, name: list[str], sizes: DataFrame, block_rows: int) -> DataFrame:
    """Rows of groups above `block_rows` (the only ones in `sizes`) once per block of their group, others once: columns i, j, b."""
    count = sizes.limit(MOST_HOT + 1).count()
    if not count:
        split = rows.withColumn("nb", F.lit(1))
    else:
        split = rows.join(F.broadcast(sizes) if count <= MOST_HOT else sizes, name, "left").withColumn("nb", F.coalesce(F.ceil(F.col("n") / block_rows), F.lit(1)).cast("int"))
    split = split.withColumn("b", F.when(F.col("nb") > 1, F.pmod(F.xxhash64("h"), F.col("nb")).cast("int")).otherwise(0))
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(F.col("b"), o).alias("i"), F.greatest(F.col("b"), o).alias("j")))
    return split.withColumn("p", F.explode(pair)).withColumn("i", F.col("p.i")).withColumn("j", F.col("p.j")).drop("p", "n", "nb")


def links(classes: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, bits: int | None = None, seed: int = 5, block_rows: int = 4_096) -> DataFrame:
    """(h, n, root) of linked classes, in pieces: n to be summed, root to be followed."""
    spark, out = classes.sparkSession, "h long, n long, root long"
    rows = classes.withColumn("d", F.size("embedding"))
    labels = store(rows.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n")), "label_sizes")
    largest = labels.agg(F.max("n")).first()[0] or 0
    if tables is None or bits is None:
        tables, bits = tables_for(largest, threshold)
    in_pairs = tables * block_rows                                               # a label beyond it is sent by table
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("n") / block_rows)
    copies, large = labels.agg(F.sum(F.when(F.col("n") <= in_pairs, F.col("n") * blocks)), F.sum(F.when(F.col("n") > in_pairs, F.col("n")))).first()
    big = labels.where(F.col("n") > block_rows)
    small, wide = rows, None
    if large:
        beyond = labels.where(F.col("n") > in_pairs).select("label", "d")
        hot = F.broadcast(beyond) if beyond.limit(MOST_HOT + 1).count() <= MOST_HOT else beyond
        small, wide = rows.join(hot, ["label", "d"], "left_anti"), rows.join(hot, ["label", "d"], "left_semi")
    units = _in_blocks(small.select("h", "label", "embedding", "mult", "d"), ["label", "d"], big.where(F.col("n") <= in_pairs), block_rows)
    found = map_arrow(units.repartition(max(least, -(-(copies or 0) // UNIT_ROWS)), "label", "d", "i", "j"), _compare_blocks(threshold, tables, bits, seed), out)
    if wide is None:
        return needs(found, labels)
    keyed = map_arrow(wide.select("h", "label", "embedding", "mult", F.lit(0).cast("long").alias("low")), _keys(tables, bits, seed),
                      "h long, label long, embedding array<" + wide.schema["embedding"].dataType.elementType.simpleString() + ">, mult long, low long, keys array<int>")
    keyed = store(keyed.drop("low").withColumn("d", F.size("embedding")), "keys")
    name = ["label", "tab", "key", "d"]
    full = keyed.select("label", "d", F.posexplode("keys").alias("tab", "key")).groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    full = store(full, "full_buckets")
    more = full.agg(F.sum(F.col("n") * (F.ceil(F.col("n") / block_rows) - 1))).first()[0] or 0
    units = _in_blocks(keyed.select("*", F.posexplode("keys").alias("tab", "key")), name, full, block_rows)
    parts = max(least, -(-(large * tables + more) // UNIT_ROWS))
    return needs(found.unionByName(map_arrow(units.repartition(parts, *name, "i", "j"), _compare(threshold), out)), labels, keyed, full)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, bits: int | None = None, seed: int = 5, block_rows: int = 4_096) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector. `tables` and `bits` follow from the largest label unless given."""
    x = F.col("embedding")
    good = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    wide = x.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), (x if narrow else wide).alias("embedding"))
    rows = rows.withColumn("h", F.when(F.coalesce(good, F.lit(False)), F.xxhash64("label", wide))).withColumn("id", F.coalesce("vec_id", F.lit(MISSING_ID)))
    used = rows.where("h IS NOT NULL")
    ids = used.select("h", "id").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("mult"), F.min("id").alias("low"))
    first = used.groupBy("h").agg(F.first(F.xxhash64("label")).alias("label"), F.first("embedding").alias("embedding"))
    classes = store(first.join(ids, "h").select("h", "label", "embedding", "mult", "low"), "classes")
    pieces = links(classes, threshold, tables, bits, seed, block_rows)
    found = store(pieces, "links")
    discard(pieces)
    comp = components(found.select(F.col("h").alias("src"), F.col("root").alias("dst")))
    named = classes.select("h", "mult", "low").join(comp, F.col("h") == F.col("node"), "left").withColumn("c", F.coalesce("component", "h"))
    lowest = named.groupBy("c").agg(F.min("low").alias("lowest"))
    counts = found.groupBy("h").agg(F.sum("n").alias("n"))
    per_class = store(named.join(lowest, "c").join(counts, "h", "left")
                      .select("h", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "lowest"), "classes_done")
    discard(classes, found, comp)
    # classes of many equal vectors are broadcast: fewer than MOST_HOT can hold more than total / MOST_HOT rows
    total = per_class.agg(F.sum("mult")).first()[0] or 0
    hot = F.col("mult") > max(1_000, total // MOST_HOT)
    often = per_class.where(hot).select(F.col("h").alias("_h"), F.col("n_links").alias("_n"), F.col("lowest").alias("_l"))
    rest = per_class.where(~hot).select(F.col("h").alias("k"), "n_links", "lowest")
    value = F.coalesce("_l", "lowest", "id")
    # rows that need no second join are spread by their id in place of a shared key
    out = (rows.select("vec_id", "id", "h").join(F.broadcast(often), F.col("h") == F.col("_h"), "left")
           .withColumn("_key", F.when(F.col("_h").isNull() & F.col("h").isNotNull(), F.col("h")).otherwise(F.xxhash64("id")))
           .join(rest, (F.col("_key") == F.col("k")) & (F.col("h") == F.col("k")), "left")
           .select("vec_id", F.coalesce("_n", "n_links", F.lit(0)).cast("long").alias("n_links"), F.when(value != MISSING_ID, value).alias("component_id"), (value == F.col("id")).alias("kept")))
    return needs(out, per_class)
