"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed n-grams: words, word pairs (a word after itself is one feature of
its own), and strings of 3 and 5 bytes. A softmax layer gives the score. Training is numpy stochastic gradient descent
over a bounded sample of labelled documents (`max_documents`, the smallest of a hash of the id; their texts are whole), in one task.
Since the output is linear in the average, scoring needs one number per bucket: that table (`2 ** hash_bits` floats) is all
that is collected and broadcast.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out and never trained on. Labels, language, source and id are no features.

Defined cases: a null or empty text has no n-grams and gets the prior; null labels are not used; several labels of one document all
count; a null id is not held out and not trained on; no labelled rows: every score is 0.5; equal rows get equal scores; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import NOT_SPACE, find_words, flat, hash_bytes, map_arrow, pieces

HASH_BITS, DIM, VISITS, RATE, BATCH, MAX_DOCUMENTS, THRESHOLD = 18, 8, 24_000, 0.5, 32, 2_000, 0.7
STRINGS = (3, 5)
_KINDS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(column: pa.Array, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per kind of n-gram: the buckets of all texts end to end, and where each text's begin (one more entry than texts)."""
    data, at = flat(column)
    starts, ends, first = find_words(data, at, NOT_SPACE)
    shift = np.uint64(64 - bits)
    words = hash_bytes(data, starts, ends)
    buckets, edges = [(words * _KINDS[0]) >> shift], [first]
    pair = words[:-1] * _KINDS[1] + words[1:]
    pair[words[:-1] == words[1:]] = np.uint64(1)
    inside = np.ones(len(pair), bool)
    last = first[1:-1]
    inside[last[(last > 0) & (last <= len(pair))] - 1] = False                    # pairs stay within a text
    buckets.append(((pair * _KINDS[2]) >> shift)[inside])
    edges.append(np.append(0, np.cumsum(inside))[np.minimum(first, len(pair))])
    for k, size in enumerate(STRINGS):
        many = np.maximum(np.diff(at) - size + 1, 0)
        begin = np.flatnonzero(_within(at, many, len(data)))
        buckets.append((hash_bytes(data, begin, begin + size) * _KINDS[3 - k]) >> shift)
        edges.append(np.append(0, np.cumsum(many)))
    return [b.astype(np.int64) for b in buckets], edges


def _within(at: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    delta = np.zeros(n + 1, np.int32)
    some = many > 0
    np.add.at(delta, at[:-1][some], 1)
    np.add.at(delta, at[:-1][some] + many[some], -1)
    return np.cumsum(delta[:-1]) > 0


def _sums(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(values))
    return total[edge[1:]] - total[edge[:-1]]


def fit(texts: pa.Array, labels: np.ndarray, bits: int = HASH_BITS, dim: int = DIM, visits: int = VISITS, rate: float = RATE, seed: int = 3) -> tuple[np.ndarray, float]:
    """(value of each bucket, bias): the logit of label 1 is bias + the mean value of a text's n-grams."""
    n, size = len(labels), 1 << bits
    if not n:
        return np.zeros(size, np.float32), 0.0
    rows = []                                                                     # per text: distinct buckets and their shares
    for k in range(n):
        b, e = features(texts[k:k + 1], bits)
        keys, many = np.unique(np.concatenate(b).astype(np.int32), return_counts=True)
        rows.append((keys, (many / max(1, many.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((dim, size), np.float32) - 0.5) / dim)
    out, bias = np.zeros((2, dim)), np.zeros(2)
    epochs = -(-visits // n)                                                      # every text is seen as often as makes up `visits`
    steps, done = epochs * n, 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            some = order[lo:lo + BATCH]
            keys = np.concatenate([rows[k][0] for k in some])
            share = np.concatenate([rows[k][1] for k in some])
            count = np.array([len(rows[k][0]) for k in some])
            edge = np.append(0, np.cumsum(count))
            x = np.stack([_sums(vectors[d][keys] * share, edge) for d in range(dim)], axis=1)
            z = x @ out.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1                            # gradient of the loss by the logits
            step = rate * (1 - done / steps)
            back = p @ out
            out -= step * p.T @ x
            bias -= step * 0.1 * p.sum(axis=0)
            used, at = np.unique(keys, return_inverse=True)
            for d in range(dim):
                vectors[d][used] -= (step * np.bincount(at, share * np.repeat(back[:, d], count), len(used))).astype(np.float32)
            done += len(some)
    weight = out[1] - out[0]
    return (weight @ vectors).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_documents: int = MAX_DOCUMENTS, bits: int = HASH_BITS) -> tuple[np.ndarray, float]:
    """The scoring table, fitted in one task on at most `max_documents` labelled rows that are not held out."""
    doc = F.col("doc_id").cast("long")
    chosen = (labels.where(F.col(target).isNotNull() & doc.isNotNull() & ~held_out(doc)).select(doc.alias("_id"), (F.col(target) == 1).cast("int").alias("_y"))
              .orderBy(F.xxhash64("_id", F.lit(1)), "_id", "_y").limit(max_documents))
    sample = docs.select(doc.alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("_y", "ascending")]).combine_chunks()
        value, bias = fit(table.column("text").combine_chunks(), table.column("_y").to_numpy(), bits)
        yield pa.RecordBatch.from_arrays([pa.array([value.tobytes()], pa.binary()), pa.array([bias])], ["value", "bias"])

    got = map_arrow(sample.repartition(1), run, "value binary, bias double").collect()   # one row of 2 ** bits floats
    return (np.frombuffer(got[0]["value"], np.float32), got[0]["bias"]) if got else (np.zeros(1 << bits, np.float32), 0.0)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """All columns of `docs` with a score from 0 to 1."""
    bits = len(model[0]).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, bias = shared.value
        for batch in batches:
            for part in pieces(batch):
                total, n = np.zeros(part.num_rows), np.zeros(part.num_rows)
                for b, e in zip(*features(part.column("text"), bits)):
                    total += _sums(value[b].astype(np.float64), e)
                    n += np.diff(e)
                score = 1 / (1 + np.exp(-(bias + total / np.maximum(n, 1))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(score)], [*own, name])

    return map_arrow(docs, run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{name}` double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
