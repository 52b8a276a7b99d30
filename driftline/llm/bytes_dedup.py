"""Exact substring dedup on bytes with suffix arrays, over shards that hold all possible matches of their text.

Every `width`-byte window has an anchor: the smallest of the hashes of the strings of 3/8 its length inside it, the leftmost of equals. Equal
windows have equal anchors at equal places, and neighbouring windows share theirs: the windows of one anchor are one segment of
text. Segments meet by anchor, so equal windows always do. A filter (`repeated`) of the anchors that occur twice goes first and drops the other
segments. The rest are sent as hashes: of equal segments the one of the smallest document stays, the others are repeats. Only the segments that
stay of an anchor with several different ones are then sent with their bytes (the windows of one segment all differ). Each shard of them gets a
suffix array by induced sorting and permuted common prefixes (`sais`); neighbours in the array that share `width` bytes are equal windows, the
first in (doc_id, position) order stays.

An anchor that stands in many different contexts (a line that a third of the documents share) would fill one shard; with more than `hot_segments`
different segments they are sent on as the hashes of single windows, spread by these, where equal ones combine again.

Defined cases: a null or empty text has no bytes; texts shorter than `width` are kept; a null id counts as smaller than all others;
rows that share an id but not their text do not remove each other's bytes; equal rows are treated alike; very long texts are
processed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import BASES, _TABLES, anchors, binary, flat, hash_bytes, map_arrow, mix, needs, pack, pieces, powers, ragged, row_id, runs, store, text_size, unpack
from driftline.llm.members import filter_of, screened
from driftline.llm.repeated import repeated
from driftline.llm.sais import common_prefixes, suffix_array

WIDTH = 100
FLUSH = 200_000                     # segments a task holds before it sends them
FLUSH_BYTES = 3_000_000             # the same for their bytes
SHARD = 1_500_000                   # bytes of one suffix array
#: A segment or window by its hashes; one with its bytes. `key` is 32 bits of the anchor behind those that choose the bucket.
PRINT = (np.uint32, np.uint64, np.uint32, np.int64, np.int64, np.int32, np.int32)      # key, h1, h2, doc, txt, start, size
PIECE = (np.uint32, np.int64, np.int64, np.int32, np.int32)                            # key, doc, txt, start, size
ROW = "bucket int, _doc long, _txt long, spans binary, prints binary, segments binary, body binary"
NAMES = ["bucket", "_doc", "_txt", "spans", "prints", "segments", "body"]
FOUND = "_doc long, _txt long, spans binary, wanted array<long>, hot array<long>"


def _grams(data: np.ndarray, half: int) -> np.ndarray:
    """Hashes of all strings of `half` bytes."""
    up, down = powers(BASES[0], len(data) + 1)
    v = _TABLES[0][data]
    v *= up[:len(v)]
    total = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    h = total[half:] - total[:-half]
    h *= down[:len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def gram_bytes(width: int) -> int:
    """Long enough to be rare by chance, short enough that a segment has many windows."""
    return max(1, width * 3 // 8)


def _segments(column: pa.Array, width: int):
    """Runs of windows with one anchor: text, document, first byte, windows, anchor hash."""
    data, at = flat(column)
    many = np.maximum(np.diff(at) - width + 1, 0)
    if not many.any():
        return data, *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), at
    grams = _grams(data, gram_bytes(width))
    mark = anchors(grams, width - gram_bytes(width) + 1)                   # of every window of the slice, crossing ones too
    new = np.ones(len(mark), bool)
    new[1:] = mark[1:] != mark[:-1]
    inside = np.zeros(len(mark) + 1, np.int32)
    some = np.flatnonzero(many)
    np.add.at(inside, at[:-1][some], 1)
    np.add.at(inside, at[:-1][some] + many[some], -1)
    inside = np.cumsum(inside[:-1]) > 0
    new[at[:-1][some]] = True
    first = np.flatnonzero(new & inside)
    doc = np.searchsorted(at, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(mark)), (at[:-1] + many)[doc])
    return data, doc, first, last - first, grams[mark[first]], at


def _anchor_keys(width: int):
    return lambda part: _segments(part.column("text"), width)[4]


def _named(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each anchor, and 32 bits that name it there."""
    h = mix(key.copy())
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int32), h.astype(np.uint32)


def _places(doc: np.ndarray, txt: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each segment's place."""
    return mix(mix(mix(doc.view(np.uint64).copy()) ^ txt.view(np.uint64)) + start.astype(np.uint64))


def _span_rows(doc, txt, start, size) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Known repeats: per document its runs of windows (first window, number of windows)."""
    if not len(doc):
        return
    order = np.lexsort((start, txt, doc))
    doc, txt = doc[order], txt[order]
    pairs = np.stack([start[order], size[order]], axis=1).astype(np.int32)
    owner = np.ones(len(doc), bool)
    owner[1:] = (doc[1:] != doc[:-1]) | (txt[1:] != txt[:-1])
    at = np.flatnonzero(owner)
    edge = np.append(at, len(doc)) * pairs.itemsize * 2
    raw = pairs.tobytes()
    yield doc[at], txt[at], [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def _sent_spans(known, parts: int) -> Iterator[pa.RecordBatch]:
    for doc, txt, spans in _span_rows(*known):
        none = pa.nulls(len(doc), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(_named(doc.view(np.uint64), parts)[0]), pa.array(doc), pa.array(txt), binary(spans), none, none, none], NAMES)


def _found_spans(known) -> Iterator[pa.RecordBatch]:
    for doc, txt, spans in _span_rows(*known):
        none = pa.nulls(len(doc), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(txt), binary(spans), none, none], ["_doc", "_txt", "spans", "wanted", "hot"])


def _passed_on(some: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(some.num_rows, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([*(some.column(c) for c in ("_doc", "_txt", "spans")), none, none], ["_doc", "_txt", "spans", "wanted", "hot"])


def _combine(bucket, key, h1, h2, doc, txt, start, size):
    """Equal segments of an anchor once, from the smallest document; the places that are copies of it, and the rest by bucket and key.

    Equal rows of the table name the same places: one of them is taken.
    """
    anchor = bucket.astype(np.int64) << 32 | key
    order = np.lexsort((start, txt, doc, h2, h1, anchor))
    anchor, bucket, key, h1, h2, doc, txt, start, size = (x[order] for x in (anchor, bucket, key, h1, h2, doc, txt, start, size))
    new, own = np.ones(len(key), bool), np.zeros(len(key), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (size[1:] != size[:-1])
    own[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (txt[1:] == txt[:-1])
    twice = own.copy()
    twice[1:] &= start[1:] == start[:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    # the first place of a text, for those of it that come later
    origin = np.maximum.accumulate(np.where(own, 0, np.arange(len(key))))
    known = ~twice & ((doc > doc[lead]) | (start > start[origin]))
    keep = ~twice & ~known
    return tuple(x[known] for x in (doc, txt, start, size)), tuple(x[keep] for x in (bucket, key, h1, h2, doc, txt, start, size))


def _send_prints(held: list, parts: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the segments of one flush, equal ones once; a bucket's are one row of arrays."""
    anchor, h1, h2, doc, txt, start, size = (np.concatenate(x) for x in zip(*held))
    known, (bucket, key, h1, h2, doc, txt, start, size) = _combine(*_named(anchor, parts), h1, h2.astype(np.uint32), doc, txt, start.astype(np.int32), size.astype(np.int32))
    yield from _sent_spans(known, parts)
    lo, hi = runs(bucket)
    if len(lo):
        none, empty = pa.nulls(len(lo), pa.int64()), pa.nulls(len(lo), pa.binary())
        prints = [pack([x[a:b + 1] for x in (key, h1, h2, doc, txt, start, size)]) for a, b in zip(lo.tolist(), hi.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[lo]), none, none, empty, binary(prints), empty, empty], NAMES)


def _send_bytes(held: list, width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Segments of one flush with their bytes; a bucket's are one row of arrays."""
    anchor, doc, txt, start, size, body = (np.concatenate(x) for x in zip(*held))
    bucket, key = _named(anchor, parts)
    length = size + width - 1
    at = np.cumsum(length) - length
    order = np.lexsort((key, bucket))
    bucket, key, doc, txt, start, size, length, at = (x[order] for x in (bucket, key, doc, txt, start.astype(np.int32), size.astype(np.int32), length, at))
    lo, hi = runs(bucket)
    text, upto = ragged(body, at, length), np.append(0, np.cumsum(length))
    cut = list(zip(lo.tolist(), hi.tolist()))
    none, empty = pa.nulls(len(lo), pa.int64()), pa.nulls(len(lo), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(bucket[lo]), none, none, empty, empty, binary([pack([x[a:b + 1] for x in (key, doc, txt, start, size)]) for a, b in cut]),
                                      binary([text[upto[a]:upto[b + 1]].tobytes() for a, b in cut])], NAMES)


def _candidates(shared, width: int, parts: int):
    """Hashes of the segments whose anchor may be repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in pieces(batch):
                data, doc, first, size, key, at = _segments(part.column("text"), width)
                keep = shared.value.maybe(key)
                if not keep.any():
                    continue
                doc, first, size, key = doc[keep], first[keep], size[keep], key[keep]
                ids, txts = part.column("_doc").to_numpy(), part.column("_txt").to_numpy()
                held.append((key, *(hash_bytes(data, first, first + size + width - 1, k) for k in (0, 1)), ids[doc], txts[doc], first - at[doc], size))
                n += len(key)
                if n >= FLUSH:
                    yield from _send_prints(held, parts)
                    held, n = [], 0
        if held:
            yield from _send_prints(held, parts)
    return run


def _classes(hot_segments: int):
    """Hashes of whole buckets: copies are known repeats; what stays of an anchor that has several different segments is wanted with its bytes.

    An anchor of which more than `hot_segments` stay is reported as hot.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, 4 * FLUSH
        for batch in batches:
            done = batch.column("_doc").is_valid()
            if done.true_count:
                yield _passed_on(batch.filter(done))
            rest = batch.filter(pc.invert(done))
            for bucket, value in zip(rest.column("bucket").to_pylist(), rest.column("prints")):
                prints = unpack(value, PRINT)
                held.append((np.full(len(prints[0]), bucket, np.int32), *prints))
                n += len(prints[0])
                if n > most:
                    known, kept = _combine(*(np.concatenate(x) for x in zip(*held)))
                    yield from _found_spans(known)
                    held, n = [kept], len(kept[0])
                    most = max(most, 2 * n)
        if not held:
            return
        known, (bucket, key, _, _, doc, txt, start, _) = _combine(*(np.concatenate(x) for x in zip(*held)))
        yield from _found_spans(known)
        anchor = bucket.astype(np.int64) << 32 | key
        lo, hi = runs(anchor)
        many = hi - lo + 1
        several = np.repeat(many > 1, many)
        if several.any():
            lists = [pa.ListArray.from_arrays([0, len(x)], pa.array(x)) for x in (_places(doc[several], txt[several], start[several]).view(np.int64), anchor[lo[many > hot_segments]])]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *lists], ["_doc", "_txt", "spans", "wanted", "hot"])
    return run


def _wanted(shared, places, hot, width: int, parts: int):
    """The wanted segments with their bytes; those of hot anchors as single windows, by the windows' own hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, windows, m = [], 0, [], 0
        for batch in batches:
            for part in pieces(batch):
                data, doc, first, size, key, at = _segments(part.column("text"), width)
                ids, txts = part.column("_doc").to_numpy(), part.column("_txt").to_numpy()
                some = np.flatnonzero(shared.value.maybe(key))
                d = doc[some]
                some = some[places.value.maybe(_places(ids[d], txts[d], first[some] - at[d]))]
                if not len(some):
                    continue
                doc, first, size, key = doc[some], first[some], size[some], key[some]
                bucket, name = _named(key, parts)
                is_hot = np.isin(bucket.astype(np.int64) << 32 | name, hot.value)
                if is_hot.any():
                    who = np.repeat(np.flatnonzero(is_hot), size[is_hot])
                    w = ragged(np.arange(len(data)), first[is_hot], size[is_hot])
                    h1, h2 = (hash_bytes(data, w, w + width, k) for k in (0, 1))
                    windows.append((h1, h1, h2, ids[doc[who]], txts[doc[who]], w - at[doc[who]], np.ones(len(w), np.int64)))
                    m += len(w)
                    doc, first, size, key = doc[~is_hot], first[~is_hot], size[~is_hot], key[~is_hot]
                held.append((key, ids[doc], txts[doc], first - at[doc], size, ragged(data, first, size + width - 1)))
                n += len(held[-1][-1])
                if n >= FLUSH_BYTES:
                    yield from _send_bytes(held, width, parts)
                    held, n = [], 0
                if m >= FLUSH:
                    yield from _send_prints(windows, parts)
                    windows, m = [], 0
        if n:
            yield from _send_bytes(held, width, parts)
        if windows:
            yield from _send_prints(windows, parts)
    return run


def _shard(doc, txt, start, size, body, width: int) -> Iterator[pa.RecordBatch]:
    """One suffix array over whole anchors: which windows start earlier elsewhere. No place is there twice."""
    length = size + width - 1
    order = np.lexsort((start, txt, doc))
    at = np.cumsum(length) - length
    doc, txt, start, size, length, at = (x[order] for x in (doc, txt, start, size, length, at))
    room_in = length + 1                                                       # a byte that UTF-8 never has ends each segment
    text = np.full(int(room_in.sum()), 0xFF, np.uint8)
    place = np.cumsum(room_in) - room_in
    text[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = ragged(body, at, length)
    room = np.repeat(place + length, room_in) - np.arange(len(text))
    sa = suffix_array(text)
    same = common_prefixes(text, sa, room)[sa] >= width
    group = np.cumsum(~same)
    # only groups of two or more matter; inside one, text position is (doc_id, position) order
    big = same | np.append(same[1:], False)
    p, group = sa[big], group[big]
    inner = np.lexsort((p, group))
    p, group = p[inner], group[inner]
    if not len(p):
        return
    seg = np.searchsorted(place, p, "right") - 1
    new = np.ones(len(p), bool)
    new[1:] = group[1:] != group[:-1]
    lead = seg[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = np.zeros(len(p), bool)
    again[1:] = ~new[1:] & (doc[seg[1:]] == doc[seg[:-1]]) & (txt[seg[1:]] == txt[seg[:-1]])
    hit = np.sort(p[again | (doc[seg] > doc[lead])])
    cut = np.ones(len(hit), bool)
    cut[1:] = hit[1:] != hit[:-1] + 1                                          # windows never touch across segments
    first = np.flatnonzero(cut)
    n = np.diff(np.append(first, len(hit)))
    seg = np.searchsorted(place, hit[first], "right") - 1
    yield from _found_spans((doc[seg], txt[seg], start[seg] + hit[first] - place[seg], n))


def _arrays(width: int):
    """Whole buckets: segments as suffix arrays of about SHARD bytes that hold whole anchors, single windows by their hashes."""
    def arrays(anchor, doc, txt, start, size, body) -> Iterator[pa.RecordBatch]:
        length = size.astype(np.int64) + width - 1
        at = np.cumsum(length) - length
        order = np.lexsort((start, txt, doc, anchor))
        same = np.zeros(len(order), bool)                                      # equal rows of the table name the same places
        same[1:] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (anchor, doc, txt, start)])
        order = order[~same]
        lo, hi = runs(anchor[order])
        upto = np.append(0, np.cumsum(length[order]))
        lo, hi = lo[hi > lo], hi[hi > lo]                                      # the windows of one segment all differ
        end = np.cumsum(upto[hi + 1] - upto[lo])
        a = 0
        while a < len(lo):
            b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + SHARD, "right")))
            s = order[ragged(np.arange(len(order)), lo[a:b], (hi - lo + 1)[a:b])]
            yield from _shard(doc[s], txt[s], start[s], size[s], ragged(body, at[s], length[s]), width)
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = [], []
        for batch in batches:
            done = batch.column("_doc").is_valid()
            if done.true_count:
                yield _passed_on(batch.filter(done))
            rest = batch.filter(pc.invert(done))
            for bucket, prints, segments, body in zip(*(rest.column(c) for c in ("bucket", "prints", "segments", "body"))):
                if prints.is_valid:
                    some = unpack(prints, PRINT)
                    windows.append((np.full(len(some[0]), bucket.as_py(), np.int32), *some))
                else:
                    key, *some = unpack(segments, PIECE)
                    held.append((np.int64(bucket.as_py()) << 32 | key.astype(np.int64), *some, np.frombuffer(body.as_buffer(), np.uint8)))
        if windows:
            yield from _found_spans(_combine(*(np.concatenate(x) for x in zip(*windows)))[0])
            windows = []
        if held:
            yield from arrays(*(np.concatenate(x) for x in zip(*held)))
    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH, max_bits: int = 2 ** 29, hot_segments: int = 50_000) -> DataFrame:
    """(_doc, _txt, spans): runs (first window, number of windows) of windows that also start earlier. Written; some texts have several rows."""
    spark, size = docs.sparkSession, text_size(docs)[1]
    rows = docs.select("text", *row_id())
    shared = repeated(rows.select("text"), _anchor_keys(width), 2 * size // (width - gram_bytes(width) + 2) + 1, max_bits)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // 16_000_000))
    buckets = parts * 8
    prints = map_arrow(rows, _candidates(shared, width, buckets), ROW)
    classes = store(map_arrow(prints.repartition(parts, "bucket"), _classes(hot_segments), FOUND), "classes")
    wanted = classes.where("wanted IS NOT NULL")
    n = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]
    # an anchor is hot for `hot_segments` different segments and more: few are
    hot = spark.sparkContext.broadcast(np.array([r[0] for r in wanted.select(F.explode("hot")).collect()], np.int64))
    places = filter_of(wanted.select(F.explode("wanted")), n, max_bits)
    segments = map_arrow(rows, _wanted(shared, places, hot, width, buckets), ROW)
    arrays = store(map_arrow(segments.repartition(parts, "bucket"), _arrays(width), FOUND).select("_doc", "_txt", "spans"), "arrays")
    return needs(classes.where("spans IS NOT NULL").select("_doc", "_txt", "spans").unionByName(arrays), classes, arrays)


def _digests(width: int, bodies: bool, moved=None):
    """The kept bytes of texts, given their runs of windows that go; or of those texts that `moved` excludes, which stay whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                if moved:
                    part = part.filter(pa.array(~moved.value.maybe(part.column("h").to_numpy().view(np.uint64))))
                data, at = flat(part.column("text"))
                body = data.tobytes()
                gone, many, digest, kept = [], [], [], []
                for d, found in enumerate([None] * part.num_rows if moved else part.column("spans").to_pylist()):
                    text = body[at[d]:at[d + 1]]
                    cut = []
                    if found:
                        pairs = np.concatenate([np.frombuffer(s, np.int32).reshape(-1, 2) for s in found]).astype(np.int64)
                        for a, b in sorted(zip(pairs[:, 0].tolist(), (pairs[:, 0] + pairs[:, 1] + width - 1).tolist())):
                            if cut and a <= cut[-1][1]:
                                cut[-1][1] = max(cut[-1][1], b)
                            else:
                                cut.append([a, b])
                        edges = [0, *(x for c in cut for x in c), len(text)]
                        text = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    gone.append(sum(b - a for a, b in cut))
                    many.append(len(cut))
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept.append(text if bodies else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(digest, pa.string()), binary(kept)],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def deduplicated(docs: DataFrame, width: int = WIDTH, max_bits: int = 2 ** 29, hot_segments: int = 50_000, bodies: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with `bodies`, else null) kept bytes of every document.

    Only texts that may have something to remove leave their place: a Bloom filter of them is broadcast.
    """
    spans = repeated_spans(docs, width, max_bits, hot_segments)
    n = spans.agg(F.approx_count_distinct(F.xxhash64("_doc", "_txt"))).first()[0]
    some = filter_of(spans.select(F.xxhash64("_doc", "_txt").alias("h")), n)
    rows = docs.select(F.col("doc_id").cast("long"), "text", *row_id())
    runs_of = spans.groupBy("_doc", "_txt").agg(F.collect_list("spans").alias("spans")).hint("shuffle_hash")
    moved = screened(rows, ["_doc", "_txt"], some, True).join(runs_of, ["_doc", "_txt"], "left").select("doc_id", "text", "spans")
    still = rows.select("doc_id", "text", F.xxhash64("_doc", "_txt").alias("h"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return needs(map_arrow(moved, _digests(width, bodies), schema).unionByName(map_arrow(still, _digests(width, bodies, some), schema)), spans)


def report(docs: DataFrame) -> DataFrame:
    return deduplicated(docs, bodies=False).drop("kept")
