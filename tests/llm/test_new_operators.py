"""Fill-in-middle, SentencePiece encoding and vector codes against brute force on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import agenda, fim, vector_codes

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, form string, ids string, h1 string, n_units int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, texts):
    """Documents with columns that clash with names the operators use."""
    return spark.createDataFrame([(i, t, "en", "x", None, "s", 3) for i, t in texts], DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["alpha", "beta", "Gamma", "dé", "日本", "x1", "!?", "the", "of", "ﬁ", "🙂", "​", "½"]
    gaps = [" ", " ", "  ", "\n", "\t ", "\r\n", "\x0b", " ", "　", ", "]
    rows = [(k, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 60)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n\n \t"), (204, "a" * 3000), (205, "日" * 500), (206, "has <P> in it"), (207, "<S>"), (208, "x<M>"), (209, "<P <S <M"), (210, "<"),
             (211, "word " * 40_000), (212, "▁ ▁▁ a"), (213, "\x00 nul"), (None, "no id here at all"), (None, None), (214, rows[3][1]), (214, rows[3][1]), (-5, "minus five")]
    return rows


# ---------------------------------------------------------------- 11
def test_ranks_and_places():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 1000):
        s = rng.integers(0, 16, n).astype(np.uint8)
        tree, at = fim.WaveletMatrix(s, 4), np.arange(n + 1)
        for _ in range(6):
            chosen = rng.random(16) < rng.random()
            upto = np.concatenate([[0], np.cumsum(chosen[s])])
            assert tree.rank(chosen, at).tolist() == upto.tolist()
            count = rng.integers(0, upto[-1] + 1, 20)
            assert tree.locate(chosen, np.zeros(20, np.int64), np.full(20, n), count).tolist() == np.searchsorted(upto, count).tolist()


def brute(i, t, ends):
    t, h = t or "", hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    stops = [0, *ends(t)]
    n = len(stops) - 1
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = t[:stops[a]], t[stops[a]:stops[b]], t[stops[b]:]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    return (n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 80 else (n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}")


def test_fill_in_middle(spark, texts):
    expect = Counter((i, *brute(i, t, lambda t: [m.end() for m in TOKEN.finditer(t)])[:4], sha(brute(i, t, lambda t: [m.end() for m in TOKEN.finditer(t)])[4]), sha(t or "")) for i, t in texts)
    got = Counter(tuple(r) for r in fim.report(frame(spark, texts)).collect())
    assert got == expect and {r[2] for r in got} == {"plain", "psm", "spm"}
    out = fim.transformed(frame(spark, texts))
    assert out.columns == [*DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), "_n_units", "_form", "prefix_chars", "middle_chars"]
    assert fim.report(frame(spark, texts).where("false")).count() == 0


@pytest.mark.parametrize("unit,ends", [("line", lambda t: [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+\Z", t)]), ("character", lambda t: list(range(1, len(t) + 1)))])
def test_other_units(spark, texts, unit, ends):
    rows = [(i, t) for i, t in texts if i != 211]
    got = fim.restored(fim.transformed(frame(spark, rows), unit=unit), form="_form").select("doc_id", "_n_units", "_form", "prefix_chars", "middle_chars", "text", "restored").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *brute(i, t, ends), t or "") for i, t in rows)


def test_markers_must_not_overlap(spark, texts):
    for markers in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "x"), ("<P>", "P", "<M>"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.transformed(frame(spark, texts), markers=markers)


# ---------------------------------------------------------------- 12
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_sentencepiece(spark, texts):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model_path())
    ids = {t: sp.encode(t or "") for _, t in texts}
    got = agenda.round_trip(frame(spark, texts), model_path()).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(sp.decode(ids[t]))) for i, t in texts)
    both = agenda.decoded(agenda.encoded(frame(spark, texts), model_path()), model_path(), "_ids")
    assert both.columns[-2:] == ["_ids", "decoded"]
    assert Counter((r.doc_id, r.text, tuple(r["_ids"]), r.decoded) for r in both.collect()) == Counter((i, t, tuple(ids[t]), sp.decode(ids[t])) for i, t in texts)
    assert agenda.round_trip(frame(spark, texts).where("false"), model_path()).count() == 0


def model(pieces, kind=2, fallback=False, dummy=True):
    """A model file: (piece, score, type) each."""
    def field(number, wire, body):
        return bytes([*varint(number << 3 | wire)]) + (bytes([*varint(len(body))]) + body if wire == 2 else body)

    def varint(v):
        out = []
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        return [*out, v]

    body = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([t]))) for p, s, t in pieces)
    trainer = field(3, 0, bytes([kind])) + field(4, 0, bytes(varint(len(pieces)))) + field(35, 0, bytes([fallback]))
    return body + field(2, 2, trainer) + field(3, 2, field(1, 2, b"identity") + field(3, 0, bytes([dummy])) + field(4, 0, b"\0") + field(5, 0, b"\1"))


@pytest.mark.parametrize("fallback", [False, True])
def test_agenda_on_made_vocabularies(fallback):
    """User-defined and unused pieces, tied scores, unknown characters: the library's ids (the encoder compares them itself)."""
    pytest.importorskip("sentencepiece")
    rng = random.Random(9)
    for trial in range(12):
        longer = {"".join(rng.choice("abc▁") for _ in range(rng.randrange(2, 6))) for _ in range(40)}
        pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + ([(f"<0x{b:02X}>", 0, 6) for b in range(256)] if fallback else [])
        pieces += [(c, -1000 - k, 1) for k, c in enumerate("abc▁")] + [("<user>", 0, 4), ("bca", 0, 4)]
        pieces += [(p, -float(rng.randrange(12)), 5 if rng.random() < 0.3 else 1) for p in sorted(longer - {"bca"})]
        own = agenda.Encoder(model(pieces, fallback=fallback, dummy=trial % 2 == 0))
        lots = [["".join(rng.choice(["a", "b", "c", " ", "é日", "z", "<user>", "bca", "ab"]) for _ in range(rng.randrange(0, 60))) for _ in range(30)] for _ in range(3)]
        for lot in lots:
            assert len(own.encode(lot)) == len(lot)
    with pytest.raises(ValueError):
        agenda.Vocabulary(model(pieces, kind=1))


def test_a_difference_stops_the_job():
    pytest.importorskip("sentencepiece")
    own = agenda.Encoder(agenda.read_model(model_path()))
    own.encode(["some words"])
    own.ids.data += 1
    with pytest.raises(ValueError):
        own.encode(["some words"])


# ---------------------------------------------------------------- 13
def codes(rows, parts=4, entries=256, rounds=4):
    ok = [(i, v, y) for i, v, y in rows if v is not None and v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    if not ok:
        return Counter()
    sizes = Counter(len(v) for _, v, _ in ok)
    width = min(sizes, key=lambda d: (-sizes[d], d))
    ok = [(i, [math.floor(1024 * x) if abs(x) < 2 ** 60 else 1024 * int(x) for x in v], y, v) for i, v, y in ok if len(v) == width]
    w = width // parts
    start = [v for _, v, _, _ in sorted(ok, key=lambda r: (r[0] is not None, r[0] or 0, r[3]))[:entries]]
    books = [[v[p * w:p * w + w] for v in start] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _, _ in ok:
                x = v[p * w:p * w + w]
                members.setdefault(near(x, books[p])[1], []).append(x)
            for k, xs in members.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [(i, y, [near(v[p * w:p * w + w], books[p]) for p in range(parts)]) for i, v, y, _ in ok]
    errors, by_label = [sum(d for d, _ in f) for _, _, f in found], {}
    for (_, y, _), e in zip(found, errors):
        by_label[y] = by_label.get(y, 0) + e
    fit = lambda e: e if e < 2 ** 63 else None
    large = {y for (_, y, _), e in zip(found, errors) if fit(e) is None}
    return Counter((i, "".join(f"{k:02x}" for _, k in f), fit(e), None if y in large else fit(by_label[y]), digest) for (i, y, f), e in zip(found, errors))


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, y, "x", 1.0) for i, v, y in rows], f"vec_id long, embedding array<{kind}>, label int, v string, error double").repartition(3)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(13)
    base = rng.standard_normal((9, 8))
    rows = [(int(k), (base[k % 9] + 0.3 * rng.standard_normal(8)).astype(np.float32).tolist(), int(k % 3) if k % 5 else None) for k in rng.permutation(300)]
    rows += [(400, [0.0] * 8, 1), (401, [0.0] * 8, 1), (402, [-0.0005] * 8, 2), (403, None, 1), (404, [], 1), (405, [1.0] * 7, 1), (406, [1.0] * 4, 1), (407, [None] * 8, 1), (408, [float("nan")] * 8, 0),
             (409, [float("inf")] + [0.0] * 7, 0), (None, rows[0][1], 0), (rows[1][0], rows[2][1], 0), (rows[1][0], rows[1][1], 0)]
    return rows


@pytest.mark.parametrize("entries,pivots", [(256, 8), (16, 3), (1, 1)])
def test_codes(spark, points, entries, pivots):
    got = vector_codes.report(vectors(spark, points), entries=entries, pivots=pivots)
    assert Counter(tuple(r) for r in got.collect()) == codes(points, entries=entries)
    assert [f"{n} {t}" for n, t in got.dtypes] == ["vec_id bigint", "code string", "error bigint", "label_error bigint", "codebooks_sha256 string"]


def test_codes_with_many_labels_and_none(spark, points):
    got = vector_codes.report(vectors(spark, points), entries=16, small_labels=1)
    assert Counter(tuple(r) for r in got.collect()) == codes(points, entries=16)
    few = [(i, v, y) for i, v, y in points if i in (3, 7, 403)]
    assert Counter(tuple(r) for r in vector_codes.report(vectors(spark, few)).collect()) == codes(few)
    for none in (vectors(spark, points).where("false"), vectors(spark, [(1, None, 1), (2, [], 0)])):
        assert vector_codes.report(none).collect() == []


@pytest.mark.parametrize("size", [1e4, 1e12, 1e30])
def test_codes_of_large_components(spark, points, size):
    rows = [(i, None if v is None else [None if x is None else x * size if k % 2 else -x * size for x in v], y) for k, (i, v, y) in enumerate(points)]
    got = vector_codes.report(vectors(spark, rows, "double"), entries=12)
    assert Counter(tuple(r) for r in got.collect()) == codes(rows, entries=12)


def test_pruning_gives_the_nearest():
    rng = np.random.default_rng(3)
    for spread in (3, 4000):
        x, book = rng.integers(-spread, spread, (500, 6)), rng.integers(-spread, spread, (64, 6))
        piv = vector_codes.choose_pivots(book, 8)
        index, d, done = vector_codes.nearest(x, vector_codes.pivot_distances(x, piv).astype(np.float32).astype(float), book, vector_codes.pivot_distances(book, piv))
        every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert index.tolist() == every.argmin(axis=1).tolist() and d.tolist() == every.min(axis=1).tolist() and done < every.size


@pytest.mark.parametrize("tables,bits,block", [(12, 2, 2), (12, 2, 8), (40, 6, 4_096)])
def test_near_vectors_by_bucket_and_by_block(spark, tables, bits, block):
    """A label beyond `tables` blocks is sent by bucket, smaller ones by pairs of blocks; both give the links of brute force."""
    from driftline.llm import near_vectors

    rng = np.random.default_rng(9)
    base = rng.standard_normal((15, 12))
    x = (base[np.arange(120) % 15] + 0.12 * rng.standard_normal((120, 12))).astype(np.float32)
    label = [1 if i % 4 else 2 for i in range(120)]
    rows = [(i, x[i].tolist(), label[i]) for i in range(120)] + [(500 + i, x[3].tolist(), label[3]) for i in range(5)]
    v = np.array([r[1] for r in rows], np.float64)
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    y = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.93) & (y[:, None] == y)
    np.fill_diagonal(near, False)
    part = np.arange(len(rows))
    while True:
        low = np.array([min(part[i], part[near[i]].min() if near[i].any() else part[i]) for i in range(len(rows))])
        if (low == part).all():
            break
        part = low
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(df, tables=tables, bits=bits, block_rows=block).collect()}
    assert got == {r[0]: (int(near[i].sum()), rows[part[i]][0], part[i] == i) for i, r in enumerate(rows)}


def test_tables_for_any_label_size():
    """The bits keep a bucket's size, the tables keep the miss rate of a pair at the threshold."""
    import math

    from driftline.llm import near_vectors

    assert near_vectors.tables_for(100) == (42, 10)
    for n in (0, 1, 5_000, 10 ** 5, 10 ** 7):
        tables, bits = near_vectors.tables_for(n)
        assert n / 2 ** bits <= near_vectors.BUCKET
        assert (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables <= near_vectors.MISS
