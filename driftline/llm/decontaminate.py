"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents, exactly verified.

A window is `width` consecutive words of an item (a shorter item is one window). A document contains a window only if it holds all
of its shingles; so one of them, the rarest over all documents, is a sufficient prefix. Documents are joined
with those prefix shingles; a match fixes where the window would lie, which must be inside the document (position and length
bound); the window's words are then compared one by one.

The benchmark is the query set: it is broadcast in blocks of at most `block_bytes` of text, one after another, and the hits of
all blocks are united. Corpus counts come from a full pass with partial sums.

Defined cases: null or empty texts have no words (documents: no hit; items: no window); items may repeat: an id counts once,
a null id is named "null"; repeated documents each get their row; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import ALNUM, LOWER, find_words, flat, hash_bytes, map_arrow, pieces, ragged, row_id, span_hash, text_size

WIDTH, SHINGLE = 10, 3


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, at = flat(column)
    data = LOWER[data]
    starts, ends, first = find_words(data, at, ALNUM)
    return data, starts, ends, first, hash_bytes(data, starts, ends)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    at = np.arange(max(0, len(words) - size + 1))
    return span_hash(words, at, at + size)


class Block:
    """The windows of a bounded part of the benchmark, and where each one's prefix shingle stands in it."""

    def __init__(self, rows: list[tuple[str, str | None]], width: int):
        data, starts, ends, first, hashes = _words(pa.array([t for _, t in rows], pa.string()))
        windows: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        text = data.tobytes()
        words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        where: dict[tuple[bytes, ...], int] = {}
        for k, (name, _) in enumerate(rows):
            a, b = int(first[k]), int(first[k + 1])
            for s in range(a, max(a + 1, b - width + 1) if b > a else a):
                w = tuple(words[s:min(s + width, b)])
                windows[w].add(name)
                where.setdefault(w, s)
        self.names = [sorted(x) for x in windows.values()]
        self.length = np.array([len(w) for w in windows], np.int64)
        at = np.array([where[w] for w in windows], np.int64)
        self.hash = span_hash(hashes, at, at + self.length) if len(at) else np.zeros(0, np.uint64)
        joined = [b"".join(w) for w in windows]
        self.bytes = np.frombuffer(b"".join(joined), np.uint8)
        self.byte_at = np.concatenate([[0], np.cumsum([len(x) for x in joined])]).astype(np.int64)
        size = np.minimum(self.length, SHINGLE)
        many = self.length - size + 1
        self.gram_window = np.repeat(np.arange(len(at)), many)
        self.gram_offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        self.gram_size = size[self.gram_window]
        begin = at[self.gram_window] + self.gram_offset
        self.gram = span_hash(hashes, begin, begin + self.gram_size) if len(begin) else np.zeros(0, np.uint64)

    def choose(self, counts: dict[int, int]) -> None:
        """Keep the rarest shingle of each window (ties: the smallest hash, then the leftmost)."""
        n = np.array([counts.get(g, 0) for g in self.gram.view(np.int64).tolist()], np.int64)
        order = np.lexsort((self.gram_offset, self.gram, n, self.gram_window))
        new = np.ones(len(order), bool)
        new[1:] = self.gram_window[order][1:] != self.gram_window[order][:-1]
        best = order[new]
        best = best[np.argsort(self.gram[best], kind="stable")]
        self.gram, self.gram_window, self.gram_offset, self.gram_size = self.gram[best], self.gram_window[best], self.gram_offset[best], self.gram_size[best]


class Lookup:
    """Membership of many hashes in a small sorted set: a bit table first, then a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def positions(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[(h >> np.uint64(44)).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        return at[self.keys[k] == h[at]]


def _count(block: Block):
    """Occurrences of the block's shingles, summed over a partition."""
    sizes, gram, gram_size = np.unique(block.gram_size).tolist(), block.gram, block.gram_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = defaultdict(int)
        tables = {s: Lookup(gram[gram_size == s]) for s in sizes}
        for batch in batches:
            for part in pieces(batch):
                _, _, _, first, hashes = _words(part.column("text"))
                for s in sizes:
                    h = _grams(hashes, s)
                    at = tables[s].positions(h)
                    if len(at):
                        at = at[at + s <= first[np.searchsorted(first, at, "right")]]       # within one text
                        keys, n = np.unique(h[at], return_counts=True)
                        for k, c in zip(keys.view(np.int64).tolist(), n.tolist()):
                            total[k] += c
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])
    return run


def _tables(block: Block) -> dict:
    """Per shingle size: the prefix shingles, and the rows of the block that each one has."""
    tables = {}
    for s in np.unique(block.gram_size).tolist():
        rows = np.flatnonzero(block.gram_size == s)
        look = Lookup(block.gram[rows])
        look.rows = rows                                                                  # sorted by shingle
        tables[s] = (look, np.searchsorted(block.gram[rows], look.keys), np.searchsorted(block.gram[rows], look.keys, "right"))
    return tables


def _occurrences(block: Block, tables: dict, data, starts, ends, first, hashes) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every verified occurrence in a slice of texts."""
    begin, window = [], []
    for s, (lookup, lo, hi) in tables.items():
        h = _grams(hashes, s)
        at = lookup.positions(h)
        if not len(at):
            continue
        k = np.searchsorted(lookup.keys, h[at])
        many = hi[k] - lo[k]
        row = np.repeat(lo[k] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        pick = lookup.rows[row]
        begin.append(np.repeat(at, many) - block.gram_offset[pick])
        window.append(block.gram_window[pick])
    if not begin:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, window = np.concatenate(begin), np.concatenate(window)
    ok = begin >= 0
    begin, window = begin[ok], window[ok]
    text = np.searchsorted(first, begin, "right")
    ok = begin + block.length[window] <= first[np.minimum(text, len(first) - 1)]            # inside one text
    begin, window = begin[ok], window[ok]
    if not len(begin):
        return begin, window
    ok = span_hash(hashes, begin, begin + block.length[window]) == block.hash[window]       # then byte by byte
    begin, window = begin[ok], window[ok]
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    size = total[begin + block.length[window]] - total[begin]
    ok = size == block.byte_at[window + 1] - block.byte_at[window]
    begin, window, size = begin[ok], window[ok], size[ok]
    if not len(begin):
        return begin, window
    good = np.zeros(len(begin), bool)
    compact = ragged(data, starts, ends - starts)
    for lo in range(0, len(begin), 20_000):
        s = slice(lo, lo + 20_000)
        same = ragged(compact, total[begin[s]], size[s]) == ragged(block.bytes, block.byte_at[window[s]], size[s])
        good[s] = np.logical_and.reduceat(same, np.cumsum(size[s]) - size[s])
    # equal joined bytes could still be cut into words differently; the word hashes above have settled that
    return begin[good], window[good]


def _hits(block: Block):
    """Per document: number of words, hit word ranges, items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(block)
        for batch in batches:
            for part in pieces(batch):
                data, starts, ends, first, hashes = _words(part.column("text"))
                begin, window = _occurrences(block, tables, data, starts, ends, first, hashes)
                n = part.num_rows
                delta = np.zeros(len(starts) + 1, np.int64)
                np.add.at(delta, begin, 1)
                np.add.at(delta, begin + block.length[window], -1)
                hit = (np.cumsum(delta)[:-1] > 0).astype(np.int8)
                names: dict[int, set] = defaultdict(set)
                spans: dict[int, list[int]] = defaultdict(list)
                doc = np.searchsorted(first, begin, "right") - 1
                for d, w in set(zip(doc.tolist(), window.tolist())):
                    names[d].update(block.names[w])
                for d in names:
                    a, b = int(first[d]), int(first[d + 1])
                    change = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b], [0]])))
                    spans[d] = change.tolist()                                            # start, end, start, end ...
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_txt"), pa.array(np.diff(first), pa.int64()),
                     pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.int64())), pa.array([sorted(names.get(d, ())) for d in range(n)], pa.list_(pa.string()))],
                    ["doc_id", "_txt", "n_words", "spans", "items"])
    return run


def _covered(spans: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks of about `block_bytes`, each with its rarest shingles chosen by counts over all of `docs`."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    blocks = max(1, -(-text_size(items)[1] // block_bytes))
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        block = Block([(r[0], r[1]) for r in some.collect()], width)                      # at most about block_bytes
        counts = map_arrow(docs.select("text"), _count(block), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        block.choose({r[0]: r[1] for r in counts.collect()})                              # one number per shingle of the block
        yield block


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = 8_000_000) -> DataFrame:
    """The rows of `docs` whose text holds no window of any item, with their columns unchanged."""
    own = docs.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    for block in _blocks(docs, benchmark, width, block_bytes):
        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            tables = _tables(block)
            for batch in batches:
                for part in pieces(batch):
                    data, starts, ends, first, hashes = _words(part.column("text"))
                    begin, _ = _occurrences(block, tables, data, starts, ends, first, hashes)
                    good = np.ones(part.num_rows, bool)
                    good[np.searchsorted(first, begin, "right") - 1] = False
                    yield part.select(own).filter(pa.array(good))

        docs = map_arrow(docs, run, schema)
    return docs


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, n_words, spans (hit word ranges: start, end, start, end, ...), items (sorted ids as strings) of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", row_id()[1])
    parts = [map_arrow(docs, _hits(b), "doc_id long, _txt long, n_words long, spans array<long>, items array<string>") for b in _blocks(docs, benchmark, width, block_bytes)]
    if len(parts) == 1:
        return parts[0].drop("_txt")
    rows = parts[0].withColumn("_first", F.lit(1))
    for p in parts[1:]:
        rows = rows.unionByName(p.withColumn("_first", F.lit(0)))
    merged = rows.groupBy("doc_id", "_txt", "n_words").agg(
        F.sum("_first").cast("int").alias("_n"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("doc_id", "n_words", "spans", "items")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = 8_000_000) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [sum(b - a for a, b in _covered(s)) for s in batch.column("spans").to_pylist()]
            items = batch.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([h > 0 for h in hit], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return map_arrow(matches(docs, benchmark, width, block_bytes), run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
