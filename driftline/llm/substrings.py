"""Substring dedup on words: windows of `width` words that start in a document with a smaller id are removed.

First pass: a count-min sketch (`sketch`) over window marks. A mark is the smallest of the half-window hashes inside a window;
equal windows have equal marks, neighbouring windows share theirs, so there are about 26 windows to two marks and every window that
repeats has a mark that repeats. Second pass: the windows of marks that the sketch calls repeated are grouped exactly, by
a 128-bit hash of their words; all others are proven unique. A task sends each distinct window once, from its smallest
document; its other copies are repeats already, so a passage that a third of the documents share moves once per task. A mark
that stands in very many different windows could still fill one task: beyond `most` windows a task sends all it gets on to a second
grouping, spread by the windows' own hashes.

Defined cases: a null or empty text has no words; fewer words than `width` have no window; a null id counts as smaller than all
others; rows that share an id never remove each other's words; equal rows are treated alike; very long texts are processed whole;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import (NOT_SPACE, anchors, binary, find_words, flat, hash_bytes, map_arrow, mix, pieces, ragged, row_id, runs, span_hash,
                                  text_size)
from driftline.llm.sketch import Repeats, repeats

WIDTH = 50
FLUSH = 400_000                     # windows a task holds before it sends them


def _windows(column: pa.Array, width: int):
    """Word table of a slice, the windows' first words, their documents, and each run of windows with one mark."""
    data, at = flat(column)
    starts, ends, first = find_words(data, at, NOT_SPACE)
    words = hash_bytes(data, starts, ends)
    n = np.diff(first)
    many = np.maximum(n - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), many)
    begin = np.repeat(first[:-1] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    half = max(1, width // 2)
    grams = span_hash(words, np.arange(max(0, len(words) - half + 1)), np.arange(max(0, len(words) - half + 1)) + half)
    mark = anchors(grams, width - half + 1)[begin] if len(begin) else begin
    lo, hi = runs(mark)
    return data, starts, ends, first, words, begin, doc, lo, hi, grams[mark[lo]] if len(lo) else grams[:0]


def _marks(width: int):
    return lambda part: _windows(part.column("text"), width)[-1]


def _send(h1, h2, doc, txt, word, bucket, parts: int) -> Iterator[pa.RecordBatch]:
    """One flush of a task: each distinct window from its smallest document, the others as known repeats."""
    order = np.lexsort((word, txt, doc, h2, h1))
    h1, h2, doc, txt, word, bucket = (x[order] for x in (h1, h2, doc, txt, word, bucket))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    same = doc == least                                                        # copies in the smallest document still compete
    yield from _repeats(doc[~same], txt[~same], word[~same], parts)
    h1, h2, doc, txt, word, bucket = (x[same] for x in (h1, h2, doc, txt, word, bucket))
    order = np.argsort(bucket, kind="stable")
    lo, hi = runs(bucket[order])
    key, payload = [], []
    for a, b in zip(lo.tolist(), hi.tolist()):
        s = order[a:b + 1]
        key.append(int(bucket[s[0]]))
        payload.append(b"".join(x[s].tobytes() for x in (h1, h2, doc, txt, word)))
    n = len(key)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.int64()), binary(payload)], ["bucket", "_doc", "_txt", "payload"])


def _repeats(doc, txt, word, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, txt, runs of first words: pairs first, last) of windows that are repeats."""
    if not len(doc):
        return
    order = np.lexsort((word, txt, doc))
    doc, txt, word = doc[order], txt[order], word[order]
    cut = np.ones(len(doc), bool)
    owner = np.ones(len(doc), bool)
    owner[1:] = (doc[1:] != doc[:-1]) | (txt[1:] != txt[:-1])
    cut[1:] = owner[1:] | (word[1:] > word[:-1] + 1)
    first = np.flatnonzero(cut)
    pairs = np.stack([word[first], word[np.append(first[1:], len(word)) - 1]], axis=1).astype(np.int32)
    own = np.flatnonzero(owner[first])
    payload = [p.tobytes() for p in np.split(pairs, own[1:])]
    at = first[own]
    key = (mix(doc[at].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(doc[at]), pa.array(txt[at]), binary(payload)], ["bucket", "_doc", "_txt", "payload"])


def _candidates(shared, width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Repeats = shared.value
        held, n = [], 0
        for batch in batches:
            for part in pieces(batch):
                data, starts, ends, first, words, begin, doc, lo, hi, key = _windows(part.column("text"), width)
                keep = known.maybe(key)
                if not keep.any():
                    continue
                length = (hi - lo + 1)[keep]
                some = ragged(np.arange(len(begin)), lo[keep], length)
                at = begin[some]
                other = hash_bytes(data, starts, ends, 1)
                ids, txts = part.column("_doc").to_numpy(), part.column("_txt").to_numpy()
                held.append((span_hash(words, at, at + width), span_hash(other, at, at + width, 1), ids[doc[some]], txts[doc[some]], (at - first[doc[some]]).astype(np.int64),
                             np.repeat((key[keep] % np.uint64(parts)).astype(np.int64), length)))
                n += len(at)
                if n >= FLUSH:
                    yield from _send(*(np.concatenate(x) for x in zip(*held)), parts)
                    held, n = [], 0
        if n:
            yield from _send(*(np.concatenate(x) for x in zip(*held)), parts)
    return run


def _group(parts: int, most: int | None):
    """Windows of whole buckets: those whose smallest document is another one are repeats.

    With `most`, a task that holds more windows than that sends all of its buckets' windows on, spread by their own hash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, full = [], 0, False
        for batch in batches:
            done = batch.column("_doc").is_valid()
            if done.true_count:
                yield batch.filter(done)
            for value in batch.filter(pc.invert(done)).column("payload"):
                held.append(np.frombuffer(value.as_buffer(), np.uint64).reshape(5, -1))
                n += held[-1].shape[1]
                full = full or (most is not None and n > most)
                if full and n > FLUSH:
                    yield from _send_on(held, parts)
                    held, n = [], 0
        if not held:
            return
        if full:
            yield from _send_on(held, parts)
            return
        h1, h2, doc, txt, word = np.concatenate(held, axis=1)
        doc, txt, word = doc.view(np.int64), txt.view(np.int64), word.view(np.int64)
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc, txt, word = (x[order] for x in (h1, h2, doc, txt, word))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        more = doc != doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        yield from _repeats(doc[more], txt[more], word[more], parts)
    return run


def _send_on(held: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    h1, h2, doc, txt, word = np.concatenate(held, axis=1)
    yield from _send(h1, h2, doc.view(np.int64), txt.view(np.int64), word.view(np.int64), (mix(h1) % np.uint64(parts)).astype(np.int64), parts)


def repeated_windows(docs: DataFrame, width: int = WIDTH, max_bits: int = 2 ** 28, most: int = 2_000_000) -> DataFrame:
    """(_doc, _txt, payload): runs of first words of windows that start in a document with a smaller id."""
    n, size = text_size(docs)
    marks = size // 6 * 2 // (width - width // 2 + 2) + 1
    rows = docs.select("text", *row_id())
    shared = repeats(rows.select("text"), _marks(width), marks, max_bits)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // 8_000_000))
    buckets, schema = parts * 64, "bucket int, _doc long, _txt long, payload binary"
    found = map_arrow(rows, _candidates(shared, width, buckets), schema)
    first = map_arrow(found.repartition(parts, "bucket"), _group(buckets, most), schema)
    # nearly empty, unless some mark stands in very many different windows
    second = map_arrow(first.repartition(parts, "bucket"), _group(buckets, None), schema)
    return second.select("_doc", "_txt", "payload")


def _removed(width: int, n: int, spans: list[bytes] | None) -> np.ndarray:
    delta = np.zeros(n + 1, np.int32)
    for s in spans or ():
        pairs = np.frombuffer(s, np.int32).reshape(-1, 2)
        np.add.at(delta, pairs[:, 0], 1)
        np.add.at(delta, pairs[:, 1] + width, -1)
    return np.cumsum(delta[:-1]) > 0


def deduplicated(docs: DataFrame, width: int = WIDTH, max_bits: int = 2 ** 28, texts: bool = True, most: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with `texts`, else null) kept_text of every document."""
    spans = repeated_windows(docs, width, max_bits, most).groupBy("_doc", "_txt").agg(F.collect_list("payload").alias("spans"))
    joined = docs.select(F.col("doc_id").cast("long"), "text", *row_id()).join(spans.hint("shuffle_hash"), ["_doc", "_txt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                data, at = flat(part.column("text"))
                starts, ends, first = find_words(data, at, NOT_SPACE)
                counts, gone, digest, kept = np.diff(first), [], [], []
                for d, s in enumerate(part.column("spans").to_pylist()):
                    a, b = int(first[d]), int(first[d + 1])
                    out = _removed(width, b - a, s)
                    w = np.flatnonzero(~out) + a
                    length = ends[w] - starts[w] + 1                            # a word and the byte behind it, made a space
                    if len(w):
                        body = ragged(np.append(data, np.uint8(32)), starts[w], length)
                        body[np.cumsum(length) - 1] = 32
                        text = body[:-1].tobytes()
                    else:
                        text = b""
                    gone.append(int(out.sum()))
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept.append(text if texts else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), binary(kept).cast(pa.string())],
                                                 ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return map_arrow(joined.select("doc_id", "text", "spans"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def report(docs: DataFrame) -> DataFrame:
    return deduplicated(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
