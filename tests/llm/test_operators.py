"""The training-data operators against brute force on small fixtures: nulls, ties, repeated rows, long and empty texts, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.llm import bpe, bytes_dedup, common, decontaminate, lines, members, near_vectors, quality, sais, shards, simhash, substrings, warc

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, score string, _doc string, shard string, n_removed int"


def frame(spark, texts, schema=DOCS):
    """Documents with columns that clash with names the operators use."""
    return spark.createDataFrame([(i, t, "en", "x", None, "s", 3) for i, t in texts], schema).repartition(3)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "dé", "日本", "x1", "!?", "the", "of"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passage, other = words(rng, 70), words(rng, 30)
    rows = [(k, words(rng, rng.randrange(1, 200))) for k in range(30)]
    rows += [(30 + k, f"{words(rng, 20)}\n{passage} {words(rng, 15)}") for k in range(6)]
    rows += [(40 + k, f"{other}\n{words(rng, 5)}\n{other}\nlicense line here\n{words(rng, 3)}") for k in range(4)]
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, None), (53, ""), (54, " \t\n"), (55, "a" * 700), (56, "a" * 300), (57, "ab" * 400), (58, "　wide"), (59, words(rng, 6000))]
    rows += [(60, rows[1][1]), (60, rows[1][1]), (61, rows[2][1]), (61, rows[4][1] + " tail"), (None, rows[5][1]), (None, passage)]
    return rows


# ---------------------------------------------------------------- 1 and 7: substrings
def order(i):
    return -(2 ** 63) if i is None else i


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for k in range(120):
        t = rng.integers(97, 97 + rng.integers(1, 6), rng.integers(1, 300)).astype(np.uint8)
        if k % 3 == 0:
            t = np.concatenate([t, t[:len(t) // 2], t])
        b = t.tobytes()
        expect = sorted(range(len(b)), key=lambda i: b[i:])
        sa = sais.suffix_array(t)
        assert sa.tolist() == expect
        got = sais.common_prefixes(t, sa, np.arange(len(t), 0, -1))
        for i in range(1, len(b)):
            x, y = b[expect[i]:], b[expect[i - 1]:]
            assert got[expect[i]] == next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


@pytest.mark.parametrize("hot", [50_000, 2])
def test_bytes(spark, texts, hot):
    width = 40
    distinct = {(order(i), t or "") for i, t in texts}
    first = {}
    for i, t in sorted(distinct):
        b = t.encode()
        for p in range(len(b) - width + 1):
            w = b[p:p + width]
            if w not in first or i < first[w]:
                first[w] = i
    expect = Counter()
    for i, t in texts:
        b, own = (t or "").encode(), set()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            w = b[p:p + width]
            if first[w] < order(i) or w in own:
                gone[p:p + width] = b"\1" * width
            own.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        expect[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    got = bytes_dedup.deduplicated(frame(spark, texts), width, hot_segments=hot)
    assert Counter(tuple(r)[:5] for r in got.collect()) == expect
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got.collect())


@pytest.mark.parametrize("width,bits,most", [(10, 2 ** 28, 2_000_000), (50, 2 ** 20, 2_000_000), (10, 2 ** 28, 3)])
def test_windows(spark, texts, width, bits, most):
    first = {}
    for i, t in texts:
        w = SPACE.findall(t or "")
        for p in range(len(w) - width + 1):
            key = tuple(w[p:p + width])
            first[key] = min(first.get(key, order(i)), order(i))
    expect = Counter()
    for i, t in texts:
        w = SPACE.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p:p + width])] < order(i):
                gone[p:p + width] = [True] * width
        expect[(i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())] += 1
    got = substrings.deduplicated(frame(spark, texts), width, bits, most=most)
    assert Counter(tuple(r)[:4] for r in got.collect()) == expect


def test_anchors_are_alike_in_copies():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2 ** 63, 500).astype(np.uint64)
    twice = np.concatenate([h, rng.integers(0, 2 ** 63, 77).astype(np.uint64), h])
    a = common.anchors(twice, 9)
    assert (a[:492] == a[577:577 + 492] - 577).all()
    assert [int(x) for x in a[:20]] == [k + int(np.argmin(twice[k:k + 9] >> np.uint64(11))) for k in range(20)]


# ---------------------------------------------------------------- 2: vectors
@pytest.mark.parametrize("block", [2048, 3])
def test_vectors(spark, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = [(k, (base[k % 12] + 0.08 * rng.standard_normal(16)).astype(np.float32).tolist(), k % 2 if k % 3 else 1) for k in range(90)]
    rows += [(100, rows[5][1], rows[5][2]), (101, rows[5][1], rows[5][2]), (102, [0.0] * 16, 1), (103, None, 1), (104, rows[1][1], None), (105, [float("nan")] * 16, 1),
             (106, [None] * 16, 1), (107, [float("inf")] + [1.0] * 15, 0), (108, [1.0, 2.0], 0), (109, [], 1), (None, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("h", F.lit("clash"))
    ok = [(order(i), np.array(v, np.float64), y) for i, v, y in rows if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    comp, links = {order(i): order(i) for i, _, _ in rows}, Counter()

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, x, p), (j, y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                u, v = find(i), find(j)
                comp[max(u, v)] = min(u, v)
    back = {-(2 ** 63): None}
    expect = {(i, links[order(i)], back.get(find(order(i)), find(order(i))), find(order(i)) == order(i)) for i, _, _ in rows}
    got = near_vectors.near_duplicates(df, tables=40, bits=6, block_rows=block)
    assert {tuple(r) for r in got.collect()} == expect


def test_pairs_at_the_threshold_share_a_key():
    rng = np.random.default_rng(15)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 20_000, 32)))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    c = near_vectors.THRESHOLD
    c = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b, axis=1, keepdims=True)
    keys = []
    for v in (a, c):
        ids = pa.array(np.arange(len(v)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 32, dtype=np.int32)), pa.array(v.ravel()))
        batch = pa.RecordBatch.from_arrays([ids, ids, lists, ids, ids], ["h", "label", "embedding", "mult", "low"])
        out, = near_vectors._keys(near_vectors.TABLES, near_vectors.BITS, 5)(iter([batch]))
        keys.append(out.column("keys").flatten().to_numpy().reshape(len(v), -1))
    assert (keys[0] == keys[1]).any(axis=1).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(200, 201 + k) for k in range(30)]
    comp = {}

    def find(x):
        comp.setdefault(x, x)
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in edges:
        u, v = find(a), find(b)
        comp[max(u, v)] = min(u, v)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got.get(x, x) == find(x) for x in comp)
    label = common.union_find(300, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert all(label[x] == find(x) for x in comp)


# ---------------------------------------------------------------- 3: archive
@pytest.mark.parametrize("least", [0, 6])
def test_archive(spark, tmp_path, least):
    import base64

    rows = [(1, "http://a/\r\nX: y", "same page"), (2, None, "same page"), (5, "http://b", "same page"), (3, "ü", ""), (4, "c", None), (7, "c", "été\r\n\r\nWARC/1.1"), (None, "n", "é"), (9, "n", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    warc.write_archive(df, f"file://{tmp_path}/a", min_bytes=least)
    stored = spark.read.parquet(f"file://{tmp_path}/a/payloads")
    assert stored.count() == len({h or "" for _, _, h in rows})
    got = {r.page: r for r in warc.read_archive(spark, f"file://{tmp_path}/a").collect()}
    for i, url, html in rows:
        body = (html or "").encode()
        same = [order(j) for j, _, h in rows if (h or "") == (html or "")]
        response = order(i) == max(same) or len(body) < least
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit")
        assert r.refers_to == (None if response else max(same)) and r.url == url
        assert bytes(r.record).endswith((body if response else b"") + b"\r\n\r\n") and bytes(r.record).startswith(b"WARC/1.1\r\n")


# ---------------------------------------------------------------- 4: encoding
@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: k for k, t in enumerate(bpe.read_ranks(path))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding(spark, texts, vocabulary):
    path, pattern, ref = vocabulary
    rng = random.Random(9)
    rows = texts + [(70, "<|endoftext|> 's don't  \n\n  x"), (71, "".join(rng.choice("etaoin") for _ in range(3000))), (72, " " * 500), (73, "é" * 333 + "\0\x7f")]
    df = frame(spark, rows)
    expect = Counter()
    for i, t in rows:
        ids = np.array(ref.encode_ordinary(t or ""), "<u4")
        expect[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.round_trip(df, path, pattern).collect())) == expect
    again = bpe.decoded(bpe.encoded(df, path, pattern, ["doc_id", "text"]), path, pattern, ["doc_id", "text"])
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in again.collect())
    assert all(r.round_trip for r in bpe.tokenized(df, path, pattern).collect())


def test_long_pieces(vocabulary):
    path, pattern, ref = vocabulary
    codec = bpe.Codec(bpe.read_ranks(path), pattern)
    for seed in range(25):
        rng = random.Random(seed)
        letters = rng.choice(["ab", "etaoin", "éèabc", "0123456789", "!?.", "abcdefghijklmnopqrstuvwxyz", "日本語の"])
        some = ["".join(rng.choice(letters) for _ in range(rng.randrange(50, 300))) for _ in range(8)]
        ids, n = codec.encode(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [ref.encode_ordinary(s) for s in some]
    with pytest.raises(ValueError):
        codec.decode(np.array([999_999], np.int32), np.array([1]))


# ---------------------------------------------------------------- 5: shards
@pytest.mark.parametrize("per_task", [5_000, 3])
def test_shards(spark, texts, per_task):
    rows = shards.shuffle_into_shards(frame(spark, texts), ["doc_id", "text"], 7, rows_per_task=per_task).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(texts)                    # `shard` was taken: the new one has an underscore
    sizes = Counter(r["_shard"] for r in rows)
    assert set(sizes) <= set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r.slot for r in rows if r["_shard"] == k) == list(range(sizes[k]))
    got = shards.sharded_documents(frame(spark, texts)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for i, t in texts)


def test_matrix():
    counts = [5, 0, 17, 3, 1, 40]
    rows = np.array([shards.communication_matrix(counts, 4, seed) for seed in range(3000)])
    assert (rows.sum(axis=2) == counts).all()
    assert (rows.sum(axis=1).max(axis=1) - rows.sum(axis=1).min(axis=1) <= 1).all()
    # the mean of a hypergeometric count is its share of both sums; shard sizes are 17, 17, 16, 16
    assert np.allclose(rows.mean(axis=0), np.outer(counts, [17, 17, 16, 16]) / 66, atol=0.15)
    n, good, take = 66, 17, 17
    assert abs(rows[:, 2, 0].var() - take * good / n * (1 - good / n) * (n - take) / (n - 1)) < 0.3


# ---------------------------------------------------------------- 6: quality
def test_quality(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["river", "stone", "walks", "under", "the", "of", "light"]) for _ in range(40)) for _ in range(200)]
    junk = [" ".join(rng.choice(["BUY!!", "NOW$$", "the", "win|", "###"]) for _ in range(40)) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate(x for p in zip(good, junk) for x in p)]
    df = frame(spark, rows + [(900, None), (901, ""), (None, "x"), (902, "river " * 20_000)])
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k, _ in rows] + [(900, None, 0), (None, 1, 0), (5, 0, 0), (77_777, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.report(df, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 400)
    blank = quality.report(df, labels.where("false")).collect()
    assert {r.score for r in blank} == {0.5}


def test_quality_reads_no_held_out_label(spark):
    rows = [(k, f"text number {k} " * 5) for k in range(60)]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {tuple(r) for r in quality.report(df, labels).collect()} == {tuple(r) for r in quality.report(df, other).collect()}


# ---------------------------------------------------------------- 8: SimHash
def fingerprint(text, shingle=4):
    from xxhash import xxh64_intdigest

    w = SPACE.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(w[k:k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("tree_rows", [16_384, 2])
def test_simhash(spark, texts, tree_rows):
    rng = random.Random(6)
    long = words(rng, 400).split()
    rows = texts + [(80 + k, " ".join(long[:200 + k] + [f"new{k}"] + long[201 + k:])) for k in range(8)]
    prints = [(order(i), fingerprint(t)) for i, t in rows]
    comp = {i: i for i, _ in prints}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if bin(a ^ b).count("1") <= 4:
                u, v = find(i), find(j)
                comp[max(u, v)] = min(u, v)
    expect = Counter((i, f"{f:016x}", None if find(order(i)) == order(None) else find(order(i))) for (i, _), (_, f) in zip(rows, prints))
    assert Counter(map(tuple, simhash.groups(frame(spark, rows), tree_rows=tree_rows).collect())) == expect


def test_bk_trees():
    rng = np.random.default_rng(8)
    values = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30, 3)).astype(np.uint64), axis=1) for c in rng.integers(0, 2 ** 63, 6).astype(np.uint64)]))
    items = np.arange(len(values))
    keys, children = simhash.bk_build(values, np.array([0]), items, np.zeros(len(values), np.int64))
    found = {(int(a), int(b)) for q, t in simhash.bk_search(values, keys, children, items, np.zeros(len(values), np.int64), 4) for a, b in zip(q, t)}
    assert found == {(a, b) for a in range(len(values)) for b in range(len(values)) if bin(int(values[a] ^ values[b])).count("1") <= 4}


def test_representatives(spark):
    rng = random.Random(12)
    base = words(rng, 300).split()
    rows = [(k, " ".join(base[:100 + k] + ["new"] + base[101 + k:])) for k in range(5)] + [(10 + k, words(rng, 100)) for k in range(5)] + [(30, ""), (31, None)]
    keep = {r.doc_id for r in simhash.distinct_texts(frame(spark, rows)).collect()}
    assert keep == {0, 10, 11, 12, 13, 14, 30}


def pair_at(rng, similarity, n):
    """Two texts of different words whose five-word shingles have the next Jaccard index at or above `similarity`, about n shingles each."""
    tail = max(1, int(n * (1 - similarity) / (1 + similarity)))
    both = next(k for k in range(1, 9 * n) if k / (k + 2 * tail) >= similarity)
    new = lambda k: [f"w{rng.getrandbits(48):x}" for _ in range(k)]
    head = new(both + 4)
    return " ".join(head + new(tail)), " ".join(head + new(tail))


@pytest.mark.parametrize("small", [{}, {"tree_rows": 2, "unit_rows": 1, "unit_hashes": 150, "few": 5}])
def test_representatives_by_similarity(spark, small):
    """Every pair at 0.8 to 0.85 is found, none at 0.5 to 0.79 deleted; texts that share an id are judged row by row."""
    rng = random.Random(14)
    near = [pair_at(rng, rng.choice([0.8, 0.82, 0.85]), rng.choice([9, 40, 150, 400])) for _ in range(150)]
    far = [pair_at(rng, rng.choice([0.5, 0.6, 0.7, 0.77]), rng.choice([40, 150, 400])) for _ in range(150)]
    base = words(rng, 200).split()
    rows = [(2 * k + m, t) for k, pair in enumerate(near + far) for m, t in enumerate(pair)] + [(7000 + k, " ".join(base + [f"new{k}"])) for k in range(30)]
    rows += [(9000, "one text of an id"), (9000, "another text"), (None, "no id, first text"), (None, "no id and a second text")]
    rows += [(9001, "of two rows with equal id and text one stays")] * 2 + [(7003, rows[603][1])] * 3
    docs = frame(spark, rows).withColumn("m", F.create_map(F.lit("a"), F.rand()))
    kept = Counter(order(r.doc_id) for r in simhash.distinct_texts(docs, **small).collect())
    assert kept == Counter([2 * k for k in range(150)] + list(range(300, 600)) + [7000, 9000, 9000, 9001, order(None), order(None)])


@pytest.mark.parametrize("few,bits", [(1_000, 2 ** 28), (10, 2 ** 28), (10, 2 ** 20)])
def test_matched_rows(spark, few, bits):
    """Broadcast keys, a filter, and a full filter give the same rows."""
    df = spark.range(20_000).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("h")).repartition(5)
    keys = spark.range(0, 40_000, 50).select("id", (F.col("id") % 7).alias("k"), (F.col("id") + 1).alias("next"))
    for how in ("inner", "left_semi", "left_anti"):
        expect = df.join(keys if how == "inner" else keys.drop("next"), ["id", "k"], how)
        got = members.matched(df, keys if how == "inner" else keys.drop("next"), ["id", "k"], how, few, bits)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, expect.collect()))


def test_verified_units_against_brute_force():
    rng = np.random.default_rng(3)
    base = [rng.choice(60, 20, replace=False) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(base[k // 2 % 4], 19, replace=False), rng.integers(0, 60, k % 3)])).astype(np.uint64) for k in range(80)]
    edge = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    b = np.arange(80) % 2
    for i, j in ((0, 0), (0, 1), (1, 1)):
        got = simhash._verified(np.zeros(80, np.uint64), np.concatenate(sets), edge, b, i, j, 0)
        links = [(p, q) for p in range(80) for q in range(80) if p != q and b[p] == i and b[q] == j and 5 * len(np.intersect1d(sets[p], sets[q])) >= 4 * len(np.union1d(sets[p], sets[q]))]
        assert links and (got == common.union_find(80, np.array([x for x, _ in links]), np.array([y for _, y in links]))).all()


# ---------------------------------------------------------------- 9: decontamination
@pytest.mark.parametrize("block", [8_000_000, 200])
def test_decontamination(spark, texts, block):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rng = random.Random(10)
    items = [(1, words(rng, 25)), (2, "Short Item"), (10, words(rng, 12)), (3, None), (4, "?!"), (None, "one two three"), (1, "a repeated id"), (5, "x")]
    docs = texts + [(90, f"{words(rng, 5)} {items[0][1].upper()} end"), (91, "a SHORT, item; short item"), (92, " ".join(items[2][1].split()[1:11])), (93, "one two; three x"),
                    (94, "A repeated id"), (95, "shortitem"), (96, "one two"), (96, "one two three"), (96, "one two three")]

    def split(t):
        return pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))

    windows = [(str(i) if i is not None else "null", w[k:k + 10]) for i, t in items for w in [split(t)] for k in range(max(1, len(w) - 9)) if w]
    expect = Counter()
    for i, t in docs:
        w = split(t)
        hit, names = [False] * len(w), set()
        for name, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k:k + len(x)] == x:
                    hit[k:k + len(x)] = [True] * len(x)
                    names.add(name)
        expect[(i, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    assert Counter(map(tuple, decontaminate.report(frame(spark, docs), bench, ).collect())) == expect
    assert Counter((r.doc_id, r.n_words) for r in decontaminate.matches(frame(spark, docs), bench, block_bytes=block).collect()) == Counter((i, len(split(t))) for i, t in docs)
    clean = decontaminate.clean(frame(spark, docs), bench, block_bytes=block)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(k[0] for k, n in expect.items() for _ in range(n) if not k[5])
    assert decontaminate.report(frame(spark, docs), bench.where("false")).where("contaminated").count() == 0


# ---------------------------------------------------------------- 10: lines
@pytest.mark.parametrize("least", [1, 2, 3, 5])
@pytest.mark.parametrize("hot", [1_000, 3])
def test_lines(spark, monkeypatch, least, hot):
    rng = random.Random(11)
    rows = [(k, "\n".join(rng.choice(["a", "b", "c", "", " \t", "d d", "é"]) for _ in range(rng.randrange(0, 14)))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, rows[3][1]), (53, "\n".join(["z"] * 9)), (None, rows[4][1]), (54, rows[7][1]), (54, rows[7][1])]
    real = [[x for x in (t or "").split("\n") if x.strip(" \t\r")] if t else [] for _, t in rows]
    first = {}
    key = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k int, t string").select("k", F.xxhash64(F.coalesce("t", F.lit(""))).alias("h"))
    mark = {r.k: r.h for r in key.collect()}
    for k, (i, _) in enumerate(rows):
        for p in range(len(real[k]) - least + 1):
            w, at = tuple(real[k][p:p + least]), (order(i), mark[k], p)
            first[w] = min(first.get(w, at), at)
    expect = Counter()
    for k, (i, t) in enumerate(rows):
        gone = [False] * len(real[k])
        for p in range(len(gone) - least + 1):
            if first[tuple(real[k][p:p + least])] < (order(i), mark[k], p):
                gone[p:p + least] = [True] * least
        state, kept = iter(gone), []
        for x in (t or "").split("\n") if t is not None else []:
            if not x.strip(" \t\r") or not next(state):
                kept.append(x)
        runs = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        expect[(i, None if t is None else "\n".join(kept), len(gone), sum(gone), runs)] += 1
    monkeypatch.setattr(lines, "HOT_ROWS", hot)
    got = lines.deduplicated(frame(spark, rows), least)
    assert got.columns[:7] == frame(spark, rows).columns and got.columns[7:] == ["n_lines", "_n_removed", "n_runs"]
    assert Counter((r.doc_id, r.text, r.n_lines, r["_n_removed"], r.n_runs) for r in got.collect()) == expect


def test_a_passage_in_one_line(spark):
    """A line alone between unequal neighbours is a run too."""
    line = " ".join(f"w{k}" for k in range(60))
    rows = [(1, line), (2, f"before\n{line}\nafter"), (3, line), (4, "other")]
    got = {r.doc_id: r.text for r in lines.deduplicated(frame(spark, rows)).collect()}
    assert got == {1: line, 2: "before\nafter", 3: "", 4: "other"}


@pytest.mark.parametrize("hot", [1_000, 3])
def test_lengths_of_line_copies(spark, monkeypatch, hot):
    """Runs of every length that also start earlier, by brute force; the lengths of those that no other holds are reported."""
    rng = random.Random(5)
    rows = [(k, "\n".join(rng.choice("aabc") for _ in range(rng.randrange(0, 12)))) for k in range(30)]
    long = [f"line {k}" for k in range(23)]
    rows += [(40, "\n".join(long)), (41, "\n".join(["x", *long[2:21], "y", "", *long[:7]])), (42, "\n".join(["z"] * 9)), (43, "\n".join([*long, *long]))]
    text = {i: [x for x in t.split("\n") if x] for i, t in rows}
    runs, lengths = {}, {}
    for i in sorted(text):
        for p in range(len(text[i])):
            for n in range(1, len(text[i]) - p + 1):
                if runs.setdefault(tuple(text[i][p:p + n]), (i, p)) != (i, p):
                    lengths[i, p] = n
    expect = {}
    for i in text:
        ends = [(p + lengths[i, p], lengths[i, p]) for p in range(len(text[i])) if (i, p) in lengths]
        expect[i] = [n for k, (e, n) in enumerate(ends) if all(e > x for x, _ in ends[:k])]
    monkeypatch.setattr(lines, "HOT_ROWS", hot)
    docs = frame(spark, rows)
    assert {(r["_doc"], r["_pos"]): r.lines for r in lines.later_runs(docs).collect()} == lengths
    got = {r.doc_id: r for r in lines.report(docs).collect()}
    assert {i: [int(n) for n in r.copy_lengths.split(",") if n] for i, r in got.items()} == expect
    assert max(expect[43]) == 23 and expect[42] == [8] and expect[41] == [19, 7]


# ---------------------------------------------------------------- empty tables
def test_empty_tables(spark, vocabulary):
    docs = frame(spark, [(1, "x")]).where("false")
    path, pattern, _ = vocabulary
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int").where("false")
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string").where("false")
    vectors = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int").where("false")
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").where("false")
    for df in (bytes_dedup.report(docs), near_vectors.near_duplicates(vectors), warc.archived_pages(spark, pages), bpe.round_trip(docs, path, pattern), shards.sharded_documents(docs),
               quality.report(docs, labels), substrings.report(docs), simhash.groups(docs), decontaminate.report(docs, bench), lines.report(docs)):
        assert df.count() == 0
