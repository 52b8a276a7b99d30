"""Shared helpers: the cluster's scratch folder, Arrow text as flat bytes, rolling hashes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 250_000          # text handled at once inside a task: its arrays fit the cache
KEPT_POWERS = 1 << 22
MISSING_ID = -(2 ** 63)        # stands for a null id while ids are compared: before all others


# ---------------------------------------------------------------- scratch folder
def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder in `spark.checkpoint.dir`; a temporary one only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}/{label}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what `store` wrote for these tables, and for those that `needs` names, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_llm_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        discard(*getattr(df, "_llm_needs", ()))


def needs(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, with the note that it reads these stored tables: `discard(df)` deletes them too."""
    df._llm_needs = (*getattr(df, "_llm_needs", ()), *tables)
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of `df` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_size(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and bytes of text."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return n, size or 0


def row_id(doc: Column | str = "doc_id", text: Column | str = "text") -> list[Column]:
    """What names a row: its id (null: before all others) and a hash of its text, so that rows that share an id
    but not their text stay apart and equal rows are treated alike."""
    doc, text = (F.col(c) if isinstance(c, str) else c for c in (doc, text))
    return [F.coalesce(doc.cast("long"), F.lit(MISSING_ID)).alias("_doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_txt")]


# ---------------------------------------------------------------- Arrow text
def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts (one more entry than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    data = np.frombuffer(body, np.uint8)[at[0]:at[-1]] if body is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch of about `size` bytes of text each (a longer text stays whole, in a slice of its own)."""
    n = batch.num_rows
    if not n:
        return
    _, at = flat(batch.column(column))
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def ragged(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces data[start:start+length], end to end."""
    total = int(lengths.sum())
    if not total:
        return data[:0]
    first = np.cumsum(lengths) - lengths
    return data[np.arange(total) + np.repeat(starts - first, lengths)]


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers end to end, the first bytes of an array's numbers before their second bytes: upper bytes are mostly equal, and compress."""
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)


def unpack(value: pa.Scalar, types: list[type]) -> list[np.ndarray]:
    """The arrays (of one length) of a value that `pack` made."""
    width = [np.dtype(t).itemsize for t in types]
    data = np.frombuffer(value.as_buffer(), np.uint8)
    n = len(data) // sum(width)
    edge = np.cumsum([0, *width]) * n
    return [np.ascontiguousarray(data[a:b].reshape(w, n).T).view(t).reshape(n) for a, b, w, t in zip(edge, edge[1:], width, types)]


# ---------------------------------------------------------------- words and hashes
def byte_class(drop: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for a, b in drop:
        table[a:b + 1] = False
    return table


NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])                                      # [^\x20\x09-\x0D]
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])                            # after lower-casing A-Z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def find_words(data: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of `keep` bytes within a text, and the index of each text's first word."""
    inside = keep[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = at[1:][at[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, min(2 * n, KEPT_POWERS), 1 << 18)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2 ** 64), np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size > KEPT_POWERS:             # not kept: one very long text should not stay in memory
            return have
        _POWERS[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2 ** 64 - 1, 256, np.uint64)


_TABLES = [byte_values(11), byte_values(12)]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] (uint64 values) for many spans at once, by one running sum."""
    n = len(values)
    up, down = powers(BASES[which], n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def hash_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return span_hash(_TABLES[which][data], starts, ends, which)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """min(v[i:i+width]) for every i with i + width <= len(v)."""
    if len(v) < width:
        return v[:0]
    have = 1
    out = v
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[:len(out) - (width - have)], out[width - have:])
    return out


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` neighbouring hashes the position of its smallest, the leftmost of equals.

    Equal runs of hashes give equal relative positions, and neighbouring runs mostly share theirs. Only the upper bits
    are compared, so unequal hashes may count as equal; that costs nothing but an anchor elsewhere, alike in all copies.
    """
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    packed = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    return (sliding_min(packed, width) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal neighbours."""
    if not len(starts):
        return starts[:0], starts[:0]
    cut = np.flatnonzero(starts[1:] != starts[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component, given links a-b (numpy label spreading with pointer jumping)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


# ---------------------------------------------------------------- distributed connected components
def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in `edges` (src, dst longs): component is the smallest node reachable.

    Alternating large-star and small-star steps; each round's edges are written to the shared folder, so lineage
    stays short. A node's neighbours are never gathered: only their minimum is, and edges are joined with it.
    """
    e = store(edges.select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")).where("u < v").distinct(), "edges")
    size = _signature(e)
    while size[0]:
        # large star: larger neighbours move to the smallest neighbour
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), F.least("v", "m").alias("m"))
        large = both.where("u > v").join(low, F.col("v") == F.col("k")).select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "k")
        moved = large.join(least, F.col("v") == F.col("k"))
        small = moved.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(moved.select("v", F.col("m").alias("u"))).where("u < v").distinct()
        new = store(small, "edges")
        now = _signature(new)
        discard(e)
        e = new
        if now == size:
            break
        size = now
    return needs(e.select(F.col("v").alias("node"), F.col("u").alias("component")), e)


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)
