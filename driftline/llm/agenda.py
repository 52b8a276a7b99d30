"""SentencePiece encoding and decoding for merge-type vocabularies: a score-ordered agenda of adjacent symbol pairs.

A normalised text starts as its characters (user-defined pieces are symbols of their own and never merge). Every pair of neighbours
whose joined text is a piece waits in a heap, best score first, of equal scores the leftmost. The top pair is merged unless one of its symbols has
changed since; the two pairs that the new symbol makes are added. When the heap is empty each symbol is a piece, or unknown: then its UTF-8
bytes are written as byte pieces where the vocabulary has them. Pieces marked as unused are taken apart again into what they were merged from.

No merge crosses two characters that no piece holds side by side, so texts are first cut there, and a worker keeps the ids of the segments
it has met (at most `CACHE`, of at most `CACHE_CHARS` characters). Every slice of an Arrow batch is encoded by the library too: a difference stops the
job. Ids are decoded with the library's `decode`.

The model is read by the driver and broadcast (half a megabyte; `max_bytes` bounds it).

Defined cases: a null text is an empty one; an empty text has no ids and decodes to an empty text; very long texts are processed whole;
spaces that the model's normaliser changes stay changed after decoding; equal rows give equal rows; an empty table gives no rows; other columns are kept by
`encoded` and `decoded` and ignored by `round_trip`.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import fresh, map_arrow, pieces, ragged

CACHE, CACHE_CHARS, SLICE = 1_000_000, 16_000_000, 1_000_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)                      # fixed values: types of pieces in a model file
MERGE_TYPE = 2                                                                  # fixed value: trainer_spec.model_type of merge-type models


def read_model(path: str, max_bytes: int = 64_000_000) -> bytes:
    with open(path, "rb") as f:
        model = f.read(max_bytes + 1)
    if len(model) > max_bytes:
        raise ValueError("the model file is too large")
    return model


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of every field of a protocol buffer message: whole numbers, or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """Pieces, scores and types of a model file."""

    def __init__(self, model: bytes):
        self.merge, self.unknown, self.byte = {}, 0, {}                         # piece -> (id, score)
        self.user, self.unused, trainer, n = set(), set(), {}, 0
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                text, score, kind = piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)
                if kind == UNKNOWN:
                    self.unknown = n
                elif kind == BYTE:
                    self.byte[int(text[3:5], 16)] = n
                elif kind != CONTROL:
                    self.merge[text] = (n, score)
                    if kind == USER:
                        self.user.add(text)
                    elif kind == UNUSED:
                        self.unused.add(text)
                n += 1
            elif number == 2:
                trainer = dict(fields(value))
        if trainer.get(3, 1) != MERGE_TYPE:
            raise ValueError("only merge-type (bpe) models are encoded here")
        self.fallback = bool(trainer.get(35, 0))
        self.longest_user = max(map(len, self.user), default=0)


class _Numbered(dict):
    """Numbers its keys in the order they are first asked for; `new` lists those met since it was emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class _Growing:
    """An array that is appended to; `data` may be longer than `size`."""

    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1 << 16, kind), 0

    def append(self, more: np.ndarray) -> None:
        size = self.size + len(more)
        if size > len(self.data):
            self.data = np.concatenate([self.data[:self.size], np.zeros(size, self.data.dtype)])
        self.data[self.size:size] = more
        self.size = size


class Encoder:
    """One worker's vocabulary, the library's processor, and the segments met so far."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.words = Vocabulary(model)
        better = {score: k for k, score in enumerate(sorted({score for _, score in self.words.merge.values()}, reverse=True))}
        self.rank = {p: better[score] for p, (_, score) in self.words.merge.items()}
        self.ids_of = {p: k for p, (k, _) in self.words.merge.items()}
        self.digits = [str(k) for k in range(self.library.get_piece_size())]
        long = [p for p in self.words.merge if len(p) > 1]
        inner = sorted({c for p in long for c in p})
        self.number = np.zeros(0x110000, np.int32)                              # 0: a character that no longer piece holds
        self.number[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.width = len(inner) + 1
        pairs = {(a, b) for p in long for a, b in zip(p[:-1], p[1:])}
        keys = np.array(sorted(int(self.number[ord(a)]) * self.width + int(self.number[ord(b)]) for a, b in pairs), np.int64)
        self.beside = np.zeros(self.width ** 2, bool) if self.width <= 8_192 else None
        if self.beside is not None:
            self.beside[keys] = True
        self.keys = keys
        self.clear()

    def clear(self) -> None:
        self.known, self.chars = _Numbered(), 0
        self.ids, self.start, self.length = _Growing(np.int32), _Growing(np.int64), _Growing(np.int64)

    def _start(self, text: str) -> tuple[list[str], list[bool]]:
        """The first symbols, and which of them never merge (empty: all may)."""
        if not self.words.user:
            return list(text), []
        symbols, fixed, at = [], [], 0
        while at < len(text):
            size = next((k for k in range(min(self.words.longest_user, len(text) - at), 0, -1) if text[at:at + k] in self.words.user), 0)
            symbols.append(text[at:at + (size or 1)])
            fixed.append(size > 0)
            at += size or 1
        return symbols, fixed

    def merged(self, text: str) -> list[int]:
        """The ids of a segment, by the agenda.

        An entry is one number: the rank of the score, the left symbol, and the length of both symbols. The right one is the left one's neighbour;
        symbols only grow, so an entry is out of date exactly if the length is another."""
        symbols, fixed = self._start(text)
        n, find, unused, made_of = len(symbols), self.rank.get, self.words.unused, {}
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        width = max(22, len(text).bit_length())
        mask, agenda, free = (1 << width) - 1, [], not fixed and not unused
        left = 0
        for here, there in zip(symbols, symbols[1:]):
            found = find(here + there)
            if found is not None and (free or self._allowed(left, left + 1, symbols, fixed, made_of)):
                agenda.append((found << width | left) << width | len(here) + len(there))
            left += 1
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry >> width & mask
            here, right = symbols[left], after[left]
            if not here or right == n or len(here) + len(symbols[right]) != entry & mask:
                continue
            symbols[left] = here = here + symbols[right]
            symbols[right] = ""
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                joined = here + symbols[right]
                found = find(joined)
                if found is not None and (free or self._allowed(left, right, symbols, fixed, made_of)):
                    heappush(agenda, (found << width | left) << width | len(joined))
            right, left = left, before[left]
            if left >= 0:
                joined = symbols[left] + here
                found = find(joined)
                if found is not None and (free or self._allowed(left, right, symbols, fixed, made_of)):
                    heappush(agenda, (found << width | left) << width | len(joined))
        if free:
            ids = [self.ids_of.get(s) for s in symbols if s]
            if None not in ids:
                return ids
        out, todo = [], [s for s in reversed(symbols) if s]
        while todo:
            s = todo.pop()
            if s in made_of:
                todo += reversed(made_of[s])
            elif s in self.ids_of:
                out.append(self.ids_of[s])
            elif self.words.fallback:
                out += [self.words.byte[b] for b in s.encode()]
            else:
                out.append(self.words.unknown)
        return out

    def _allowed(self, left: int, right: int, symbols: list[str], fixed: list[bool], made_of: dict) -> bool:
        """Whether the pair may merge; what an unused piece is made of is noted."""
        if fixed and (fixed[left] or fixed[right]):
            return False
        joined = symbols[left] + symbols[right]
        if joined in self.words.unused:
            made_of[joined] = (symbols[left], symbols[right])
        return True

    def _cut(self, text: str) -> list[str]:
        """The segments of a normalised text."""
        if len(text) < 2:
            return [text] if text else []
        code = self.number[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
        key = code[:-1] * self.width + code[1:]
        if self.beside is not None:
            joined = self.beside[key]
        else:
            joined = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        edge = [0, *(np.flatnonzero(~joined) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(edge[:-1], edge[1:])]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text; the library's are compared."""
        split = [self._cut(t) for t in self.library.normalize(texts)] if texts else []
        if len(self.known) > CACHE or self.chars > CACHE_CHARS:
            self.clear()
        at = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(map(len, split)))
        if self.known.new:
            new, self.known.new = self.known.new, []
            self.chars += sum(map(len, new))
            found = [self.merged(s) for s in new]
            lengths = np.array([len(x) for x in found], np.int64)
            self.start.append(self.ids.size + np.cumsum(lengths) - lengths)
            self.length.append(lengths)
            self.ids.append(np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum())))
        lengths = self.length.data[at]
        edge = np.append(0, np.cumsum([len(s) for s in split])).astype(np.int64)
        ids, upto = ragged(self.ids.data, self.start.data[at], lengths), np.append(0, np.cumsum(lengths))[edge]
        if not self.words.fallback and len(ids):                                # neighbouring unknown symbols are one id
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.words.unknown) & (ids[:-1] == self.words.unknown)
            again[upto[:-1][upto[:-1] < len(ids)]] = False
            ids, upto = ids[~again], upto - np.append(0, np.cumsum(again))[upto]
        values, upto = ids.tolist(), upto.tolist()
        out = [values[a:b] for a, b in zip(upto[:-1], upto[1:])]
        if texts and self.library.encode(texts, num_threads=1) != out:
            raise ValueError("the agenda's ids differ from the library's")
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The worker's encoder for this model; kept between tasks of a reused worker."""
    mark = hashlib.sha256(model).digest()
    if mark not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[mark] = Encoder(model)
    return _ENCODERS[mark]


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column("text").to_pylist()]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """The rows of docs with `ids` (array of ints; with underscores if taken) of each text."""
    shared, own, (name,) = docs.sparkSession.sparkContext.broadcast(read_model(path)), docs.columns, fresh(docs, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(shared.value)
        for batch in batches:
            for part in pieces(batch, size=SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(mine.encode(_texts(part)), pa.list_(pa.int32()))], [*own, name])

    return map_arrow(docs, run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", {name} array<int>")


def decoded(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows of df with `decoded` (with underscores if taken): the text of its ids, null for null."""
    shared, own, (name,) = df.sparkSession.sparkContext.broadcast(read_model(path)), df.columns, fresh(df, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lists = part.column(ids).to_pylist()
                out = mine.decode([x or [] for x in lists])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if x is None else t for x, t in zip(lists, out)], pa.string())], [*own, name])

    return map_arrow(df, run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {name} string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(shared.value)
        for batch in batches:
            for part in pieces(batch, size=SLICE):
                lists = mine.encode(_texts(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in lists], pa.int64()),
                     pa.array([hashlib.sha256(",".join([mine.digits[k] for k in x]).encode()).hexdigest() for x in lists]),
                     pa.array([hashlib.sha256(t.encode()).hexdigest() for t in mine.decode(lists)])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
