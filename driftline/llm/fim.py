"""Fill-in-middle: texts cut into prefix, middle and suffix, found in a wavelet matrix over character classes.

A symbol of the matrix is the class of a UTF-8 byte together with the class of the byte after it in the same text. Units (tokens, lines,
characters) end at certain symbols, so the ranks of those symbols add up to the number of units that end before a place, and the rank of the
further bytes turns byte places into code points. Bisection on these ranks finds the place where a given unit ends. One matrix serves
all texts of a slice: ranks at a text's start are subtracted, and the bisections of all its texts run side by side.

Two units are drawn by the hash of `seed:doc_id`; the prefix ends after the smaller, the middle after the larger. A text stays plain if it is
empty, if it holds a marker, or by its hash (`rate` percent are cut, `spm` percent of these in suffix-prefix-middle order). As no cut text
holds a marker, the first occurrence of each marker in the output is the one that was put there, and the text is rebuilt exactly.

Defined cases: a null text is an empty one; a null id hashes as the empty string; very long texts are processed whole, one at a time; equal rows
give equal rows; an empty table gives no rows; further columns are kept, added ones get underscores before names that are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import flat, fresh, map_arrow, pieces

SEED, RATE, SPM, SLICE = 42, 50, 80, 1_000_000
MARKERS = ("<P>", "<S>", "<M>")
ADDED = ("n_units", "form", "prefix_chars", "middle_chars")

WHITE, BREAK, FIRST, REST = range(4)             # a byte: white space, line break, first byte of another character, further byte
SPACE_NEXT, END, FIRST_NEXT, REST_NEXT = range(4)  # what follows it: white space or line break, the end of the text, ...
BITS = 4                                         # symbol = 4 * class + what follows
CLASS = np.full(256, FIRST, np.uint8)
CLASS[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = WHITE
CLASS[0x0A] = BREAK
CLASS[0x80:0xC0] = REST


def _symbols(rule) -> np.ndarray:
    return np.array([rule(s // 4, s % 4) for s in range(1 << BITS)], bool)


#: The symbols with which a unit ends. Tokens are `white space* word | white space+`: they end with a word, or with a text that ends in white space.
UNITS = {
    "token": _symbols(lambda own, after: after == END or (own in (FIRST, REST) and after == SPACE_NEXT)),
    "line": _symbols(lambda own, after: after == END or own == BREAK),
    "character": _symbols(lambda own, after: after != REST_NEXT),
}
FURTHER = _symbols(lambda own, after: own == REST)


class WaveletMatrix:
    """Bit vectors of a symbol sequence, most significant first; every level holds the symbols stably sorted by the bits above it."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        n = len(symbols)
        for k in range(bits - 1, -1, -1):
            bit = (symbols >> k & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            some = np.packbits(bit, bitorder="little")
            packed[:len(some)] = some
            words = packed.view(np.uint64)
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, n - int(np.count_nonzero(bit))))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        w = at >> 6
        return before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, chosen: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first at[i] symbols are chosen, by a mask over all symbols: the sum of ranks of the fewest whole subtrees."""
        total = np.zeros(len(at), np.int64)
        todo = [(0, 0, 1 << self.bits, np.append(at, 0))]                    # level, symbols lo to hi, places; the last one is the node's start
        while todo:
            level, lo, hi, place = todo.pop()
            if chosen[lo:hi].all():
                total += place[:-1] - place[-1]
            elif chosen[lo:hi].any():
                ones, mid = self._ones(level, place), (lo + hi) // 2
                todo += [(level + 1, lo, mid, place - ones), (level + 1, mid, hi, self.levels[level][2] + ones)]
        return total

    def locate(self, chosen: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The smallest place from low[i] to high[i] with count[i] chosen symbols before it."""
        low, high = low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) // 2
            enough = self.rank(chosen, mid) >= count[live]
            high[live[enough]] = mid[enough]
            low[live[~enough]] = mid[~enough] + 1
            live = live[low[live] < high[live]]
        return low


def matrix(data: np.ndarray, at: np.ndarray) -> WaveletMatrix:
    """The matrix of several texts end to end; text i is data[at[i]:at[i + 1]]."""
    own = CLASS[data]
    after = np.empty_like(own)
    after[:-1] = np.where(own[1:] <= BREAK, SPACE_NEXT, own[1:])
    after[at[1:][at[1:] > at[:-1]] - 1] = END
    return WaveletMatrix(own * np.uint8(4) + after, BITS)


def _check(markers: tuple[str, str, str], unit: str) -> None:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    if len(set(markers)) != 3 or not all(markers):
        raise ValueError("three different markers are needed")
    if any(y.startswith(x[k:]) for x in markers for y in markers for k in range(1, len(x))) or any(x in y for x in markers for y in markers if x != y):
        raise ValueError("markers must not overlap or hold each other")


def cuts(data: np.ndarray, at: np.ndarray, draw_a: np.ndarray, draw_b: np.ndarray, unit: str = "token") -> tuple[np.ndarray, ...]:
    """Units of each text, the byte places where prefix and middle end, and the code points of prefix and middle."""
    tree, ends = matrix(data, at), UNITS[unit]
    start, stop = at[:-1], at[1:]
    upto = tree.rank(ends, at)
    n = np.diff(upto)
    a, b = draw_a % (n + 1), draw_b % (n + 1)
    first = tree.locate(ends, start, stop, upto[:-1] + np.minimum(a, b))
    second = tree.locate(ends, first, stop, upto[:-1] + np.maximum(a, b))
    further = tree.rank(FURTHER, np.concatenate([start, first, second])).reshape(3, -1)
    return n, first, second, first - start - (further[1] - further[0]), second - first - (further[2] - further[1])


def _draws(seed: int) -> list:
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = "token", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """The rows of `docs` with `text` in fill-in-middle form, and n_units, form (plain, psm or spm), prefix_chars, middle_chars."""
    _check(markers, unit)
    own, added, draws = docs.columns, fresh(docs, *ADDED), fresh(docs, "h1", "h2", "h3", "h4")
    p, s, m = (x.encode() for x in markers)

    def one(text: bytes, i: int, j: int, h3: int, h4: int) -> tuple[bytes, str]:
        if not text or h3 % 100 >= rate or p in text or s in text or m in text:
            return text, "plain"
        if h4 % 100 < spm:
            return b"".join((s, text[j:], p, text[:i], m, text[i:j])), "spm"
        return b"".join((p, text[:i], s, text[j:], m, text[i:j])), "psm"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, size=SLICE):
                data, at = flat(part.column("text"))
                h = [part.column(c).to_numpy(zero_copy_only=False) for c in draws]
                n, first, second, before, between = cuts(data, at, h[0], h[1], unit)
                raw = data.tobytes()
                out = [one(raw[x:y], i - x, j - x, u, v) for x, y, i, j, u, v in zip(at[:-1].tolist(), at[1:].tolist(), first.tolist(), second.tolist(), h[2].tolist(), h[3].tolist())]
                plain = np.array([f == "plain" for _, f in out], bool)
                text = pa.array([t for t, _ in out], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(text if c == "text" else part.column(c) for c in own), pa.array(n), pa.array([f for _, f in out]), pa.array(before, mask=plain), pa.array(between, mask=plain)], [*own, *added])

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in own) + f", {added[0]} long, {added[1]} string, {added[2]} long, {added[3]} long"
    return map_arrow(docs.withColumns(dict(zip(draws, _draws(seed)))), run, schema)


def restored(df: DataFrame, form: str = "form", column: str = "text", name: str = "restored", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """df with `name`: the text that `transformed` was given, rebuilt from its output and form (null and unknown forms: as it is)."""
    _check(markers, "token")
    p, s, m = (x.encode() for x in markers)

    def one(out: bytes, how: str | None) -> bytes:
        if how == "psm":
            a, b = out.index(s), out.index(m)
            return out[len(p):a] + out[b + len(m):] + out[a + len(s):b]
        if how == "spm":
            a, b = out.index(p), out.index(m)
            return out[a + len(p):b] + out[b + len(m):] + out[len(s):a]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column, SLICE):
                texts = part.column(column).view(pa.binary()).to_pylist()
                back = pa.array([one(t or b"", f) for t, f in zip(texts, part.column(form).to_pylist())], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, back], [*part.schema.names, name])

    return map_arrow(df, run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` string")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of output and rebuilt text."""
    out = restored(transformed(docs.select(F.col("doc_id").cast("long"), "text")))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
                      F.sha2("text", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
