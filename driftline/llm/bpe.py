"""Byte-level BPE by DuckDB recursive queries inside each task: encoding to ids and decoding back.

Each text is split by the pattern; the distinct pieces of a slice that the worker has not met are encoded together. Rows (word,
position, token) join the merge table; every step of the recursion contracts each word's leftmost pair of minimum rank, until
no pair of the word is in the table. Long pieces (above `LONG` bytes) are first cut where no token of the vocabulary holds the two
bytes side by side, and then contract all pairs of the word's minimum rank in one step, of overlapping ones every second: the
same result as long as no merge makes a pair of lower rank than its own. The query watches for that, and a piece where it
happens is done again one pair at a time. Decoding joins ids with the vocabulary and concatenates by ordered aggregation.

Vocabulary and pattern are parameters, read by the driver and broadcast (a rank file is about a megabyte; `max_vocabulary`
bounds it). A worker keeps the pieces it has encoded, at most `CACHE` of them.

Defined cases: null and empty texts have no ids and decode to no bytes; very long texts are processed whole; text without
special tokens: their strings are ordinary text; an unknown id stops the job; equal rows give equal rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import binary, fresh, map_arrow, pieces, ragged

LONG, CACHE, SLICE, DECODE_TOKENS = 48, 300_000, 3_000_000, 500_000

# k orders all rows by word and position; best holds a word's smallest rank and the leftmost position that has it
STEP = """
WITH RECURSIVE s(k, w, t, live) AS (
  SELECT w::BIGINT * 65536 + pos, w, t, true FROM tok
  UNION ALL
  (WITH n AS (SELECT k, w, t, lead(t) OVER o AS nt, lead(k) OVER o AS nk, lead(w) OVER o AS nw FROM s WHERE live WINDOW o AS (ORDER BY k)),
        p AS (SELECT n.w, g.m::BIGINT * 65536 + n.k % 65536 AS best, n.nk FROM n JOIN merges g ON g.l = n.t AND g.r = n.nt WHERE n.nw = n.w),
        b AS (SELECT w, min(best) AS best, arg_min(nk, best) AS gone FROM p GROUP BY w)
   SELECT n.k, n.w, CASE WHEN n.k % 65536 = b.best % 65536 THEN b.best // 65536 ELSE n.t END::INTEGER, b.w IS NOT NULL
   FROM n LEFT JOIN b ON b.w = n.w WHERE b.gone IS NULL OR n.k <> b.gone)
)
SELECT w, t, false AS odd FROM s WHERE NOT live ORDER BY k"""

# all pairs of the word's minimum rank at once; of pairs that overlap every second one; odd: a step's minimum is below an earlier one
WAVES = """
WITH RECURSIVE s(w, pos, t, step, last, odd) AS (
  SELECT w, pos, t, 0, -1, false FROM tok
  UNION ALL
  SELECT w, pos, CASE WHEN joins THEN m ELSE t END, step, least_m, odd OR least_m < last
  FROM (SELECT *, coalesce(lag(joins) OVER o, false) AS gone
        FROM (SELECT *, coalesce(m = least_m, false) AND (row_number() OVER (PARTITION BY w, part, m ORDER BY pos) - 1) % 2 = 0 AS joins
              FROM (SELECT *, sum(CASE WHEN m = least_m THEN 0 ELSE 1 END) OVER o AS part
                    FROM (SELECT p.*, g.m, min(g.m) OVER (PARTITION BY w) AS least_m
                          FROM (SELECT w, step + 1 AS step, pos, t, last, odd, lead(t) OVER o AS nt FROM s WINDOW o AS (PARTITION BY w ORDER BY pos)) p
                          LEFT JOIN merges g ON g.l = p.t AND g.r = p.nt)
                    WHERE least_m IS NOT NULL
                    WINDOW o AS (PARTITION BY w ORDER BY pos)))
        WINDOW o AS (PARTITION BY w ORDER BY pos))
  WHERE NOT gone
)
SELECT w, pos, t, odd FROM s QUALIFY step = max(step) OVER (PARTITION BY w) ORDER BY w, pos"""


def read_ranks(path: str, max_vocabulary: int = 1_000_000) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > max_vocabulary or sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("the rank file is too large, or its ranks have gaps")
    return sorted(ranks, key=ranks.get)


class _Numbered(dict):
    """Numbers its keys in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Codec:
    """One worker's DuckDB connection, merge table and pieces met so far."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        # beyond the limit DuckDB writes to the task's own temporary folder, and takes that away again
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": f"{tempfile.gettempdir()}/duckdb-{uuid.uuid4().hex}"})
        rank = {t: k for k, t in enumerate(tokens)}
        self.byte = np.array([rank.get(bytes([b]), -1) for b in range(256)], np.int32)
        triples = [(rank[t[:k]], rank[t[k:]], r) for t, r in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        l, r, m = (pa.array(np.array(x, np.int32)) for x in zip(*triples)) if triples else (pa.array([], pa.int32()),) * 3
        merges, vocabulary = pa.table({"l": l, "r": r, "m": m}), pa.table({"t": pa.array(range(len(tokens)), pa.int32()), "hex": [t.hex() for t in tokens]})
        self.con.register("merges_in", merges)
        self.con.register("vocabulary_in", vocabulary)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")
        self.beside = np.zeros((256, 256), bool)                            # bytes that stand side by side in some token
        for t in tokens:
            b = np.frombuffer(t, np.uint8)
            self.beside[b[:-1], b[1:]] = True
        self.clear()

    def clear(self) -> None:
        self.known = _Numbered()
        self.ids, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _run(self, sql: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        w = np.repeat(np.arange(len(words)), lengths)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.con.register("tok_in", pa.table({"w": w.astype(np.int32), "pos": pos.astype(np.int32), "t": self.byte[data]}))
        self.con.execute("CREATE OR REPLACE TEMP TABLE tok AS SELECT * FROM tok_in")
        self.con.unregister("tok_in")
        out = self.con.execute(sql).fetchnumpy()
        return np.asarray(out["w"]), np.asarray(out["t"], np.int32), np.asarray(out["odd"], bool)

    def learn(self, words: list[str]) -> None:
        """Encode the pieces that were met last."""
        raw = [w.encode() for w in words]
        owner, parts = self._cut(raw)
        found, raw, whole = [], parts, raw
        short, long = [k for k, w in enumerate(raw) if len(w) <= LONG], [k for k, w in enumerate(raw) if len(w) > LONG]
        for lo in range(0, len(short), 40_000):
            found += self._encode(STEP, raw, short[lo:lo + 40_000])[0]
        for lot in _lots(long, raw, 200_000):
            done, again = self._encode(WAVES, raw, lot)
            found += done
            for k in again:
                found += self._encode(STEP.replace("65536", str(2 ** 31)), raw, [k])[0]
        found.sort(key=lambda x: x[0])
        lengths = np.bincount(owner, [len(x) for _, x in found], len(whole)).astype(np.int64)
        base = len(self.ids)
        self.ids = np.concatenate([self.ids, *(x for _, x in found)])
        self.start = np.concatenate([self.start, base + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])

    def _cut(self, raw: list[bytes]) -> tuple[list[int], list[bytes]]:
        """Pieces, long ones cut where no merge can cross, and the piece each part belongs to."""
        owner, parts = [], []
        for k, w in enumerate(raw):
            if len(w) > LONG:
                b = np.frombuffer(w, np.uint8)
                edges = [0, *(np.flatnonzero(~self.beside[b[:-1], b[1:]]) + 1).tolist(), len(w)]
                parts += [w[x:y] for x, y in zip(edges[:-1], edges[1:])]
                owner += [k] * (len(edges) - 1)
            else:
                parts.append(w)
                owner.append(k)
        return owner, parts

    def _encode(self, sql: str, raw: list[bytes], some: list[int]) -> tuple[list[tuple[int, np.ndarray]], list[int]]:
        if not some:
            return [], []
        w, t, odd = self._run(sql, [raw[k] for k in some])
        cut = np.searchsorted(w, np.arange(len(some) + 1))
        bad = set(w[odd].tolist())
        return ([(k, t[cut[j]:cut[j + 1]]) for j, k in enumerate(some) if j not in bad], [some[j] for j in sorted(bad)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.clear()
        have = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(map(len, split)))
        if len(self.known) > have:
            self.learn(list(itertools.islice(self.known, have, None)))
        lengths = self.length[at]
        upto = np.append(0, np.cumsum(lengths))
        edge = np.append(0, np.cumsum([len(p) for p in split]))
        return ragged(self.ids, self.start[at], lengths), np.diff(upto[edge])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each id list: a join with the vocabulary and an ordered aggregation."""
        out, base = [], np.append(0, np.cumsum(counts))
        lo = 0
        while lo < len(counts):
            hi = max(lo + 1, int(np.searchsorted(base, base[lo] + DECODE_TOKENS, "right")) - 1)
            some = ids[base[lo]:base[hi]]
            self.con.register("ids_in", pa.table({"d": np.repeat(np.arange(hi - lo, dtype=np.int32), counts[lo:hi]), "pos": np.arange(len(some), dtype=np.int32), "t": some}))
            got = self.con.execute("SELECT d, count(*) AS n, string_agg(hex, '' ORDER BY pos) AS hex FROM ids_in JOIN vocabulary USING (t) GROUP BY d").fetchall()
            self.con.unregister("ids_in")
            text = {d: (n, h) for d, n, h in got}
            for d in range(hi - lo):
                n, h = text.get(d, (0, ""))
                if n != counts[lo + d]:
                    raise ValueError("an id is not in the vocabulary")
                out.append(bytes.fromhex(h))
            lo = hi
        return out


def _lots(keys: list[int], raw: list[bytes], size: int) -> Iterator[list[int]]:
    lot, n = [], 0
    for k in keys:
        lot.append(k)
        n += len(raw[k])
        if n >= size:
            yield lot
            lot, n = [], 0
    if lot:
        yield lot


_CODECS: dict[tuple, Codec] = {}


def codec(tokens: list[bytes], pattern: str) -> Codec:
    """The worker's codec for this vocabulary; kept between tasks of a reused worker."""
    mark = (hashlib.sha256(b"\0".join(tokens)).hexdigest(), pattern)
    if mark not in _CODECS:
        _CODECS.clear()
        _CODECS[mark] = Codec(tokens, pattern)
    return _CODECS[mark]


def encoded(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs with `ids` (array of ints) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for part in pieces(batch, size=SLICE):
                ids, n = own.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], [*keep, "ids"])

    rows = docs.select(*[F.col(c) for c in keep if c != "text"], "text")
    types = dict(rows.dtypes)
    return map_arrow(rows, run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", ids array<int>")


def decoded(df: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """Columns `keep` of df with `bytes` (binary) of its `ids`."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids = part.column("ids")
                n = np.diff(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1])
                out = own.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), n.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), binary(out)], [*keep, "bytes"])

    types = dict(df.dtypes)
    return map_arrow(df.select(*keep, "ids"), run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for part in pieces(batch, size=SLICE):
                ids, n = own.encode(part.column("text").to_pylist())
                at = np.append(0, np.cumsum(n))
                raw = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n.astype(np.int64)),
                     pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]),
                     pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids, n)])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of `docs` other than text, with ids, n_tokens and round_trip (the ids decode to the text's bytes)."""
    shared, keep = docs.sparkSession.sparkContext.broadcast(read_ranks(path)), [c for c in docs.columns if c != "text"]
    types = dict(docs.dtypes)
    added = fresh(docs, "ids", "n_tokens", "round_trip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for part in pieces(batch, size=SLICE):
                texts = part.column("text").to_pylist()
                ids, n = own.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids))
                same = [x == (t or "").encode() for x, t in zip(own.decode(ids, n), texts)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists, pa.array(n.astype(np.int64)), pa.array(same, pa.bool_())], [*keep, *added])

    return map_arrow(docs, run, ", ".join(f"`{c}` {types[c]}" for c in keep) + f", {added[0]} array<int>, {added[1]} long, {added[2]} boolean")
