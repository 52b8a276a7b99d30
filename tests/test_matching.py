"""Segment distances by FFT against the plain formula: unknown values, ties, equal records, pieces and blocks of tails."""

import numpy as np
import pyarrow as pa
import pytest

from driftline.operators import matching
from driftline.operators.matching import segment_matches


def plain(test, train, window, top):
    out = {}
    smooth = {o: np.convolve(np.nan_to_num(x), np.ones(5) / 5, mode="same") for o, x in (test | train).items()}
    for o in test:
        m = min(window, len(test[o]))
        q = smooth[o][-m:]
        cand = [(np.sqrt(((smooth[u][s:s + m] - q) ** 2).mean()), f"{u}:{s}", s + m - 1) for u in train for s in range(len(train[u]) - m + 1)]
        out[o] = [(n.split(":")[0], p, d) for d, n, p in sorted(cand, key=lambda c: (round(c[0], 9), c[1]))[:top]]
    return out


@pytest.mark.parametrize("bound,piece,tails", [(10 ** 6, 16_384, 256), (1, 25, 2)])
def test_against_the_plain_formula(spark, monkeypatch, bound, piece, tails):
    monkeypatch.setattr(matching, "PIECE", piece)
    monkeypatch.setattr(matching, "TAILS", tails)
    rng = np.random.default_rng(7)
    train = {"u1": rng.normal(size=90).cumsum() + 1e6, "u2": rng.normal(size=70).cumsum(), "u3": rng.normal(size=6), "u4": np.repeat(3.0, 60)}
    train["u5"] = train["u2"].copy()                                                  # every segment twice
    test = {"a": train["u1"][10:50] + 0.01, "b": rng.normal(size=8).cumsum(), "c": np.repeat(3.0, 40), "d": rng.normal(size=33), "e": rng.normal(size=5)}
    frame = lambda of: spark.createDataFrame([(o, i, float(v), float(len(x) - 1 - i)) for o, x in of.items() for i, v in enumerate(x)], "obj string, i int, v double, rul double")
    found = segment_matches(frame(test), frame(train), "obj", ["i"], ["v"], "rul", window=12, bound=bound)
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r.obj, []).append((r.match_id, r.position, r.distance))
        assert r.rul_at_match == len(train[r.match_id]) - 1 - r.position
    want = plain(test, train, 12, 5)
    assert got.keys() == want.keys()
    for o, rows in want.items():
        assert [d for *_, d in got[o]] == pytest.approx([d for *_, d in rows], abs=1e-6)
        if o != "c":
            assert [x[:2] for x in got[o]] == [x[:2] for x in rows]


def test_unknown_values_match_nothing(spark):
    train = spark.createDataFrame([("u", i, None if i < 8 else float(i), float(i)) for i in range(20)] + [("n", i, None, 0.0) for i in range(20)], "obj string, i int, v double, rul double")
    test = spark.createDataFrame([("a", i, float(i), 0.0) for i in range(20)] + [("b", i, None, 0.0) for i in range(20)], "obj string, i int, v double, rul double")
    rows = segment_matches(test, train, "obj", ["i"], ["v"], "rul", window=6, top=50).collect()
    assert {r.obj for r in rows} == {"a"} and {r.match_id for r in rows} == {"u"}
    assert {r.position for r in rows} == set(range(11, 20))                            # sums of five are known from record 6 on
    none = segment_matches(test.limit(0), train, "obj", ["i"], ["v"], "rul", window=6)
    assert none.count() == 0 and segment_matches(test, train.limit(0), "obj", ["i"], ["v"], "rul", window=6).count() == 0


def test_margin_keeps_near_ties(spark):
    """Large common offsets and steep rows: the rounded distances alone would pick wrong segments."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3_000, 2)) + 1e8
    x[1_000:1_500] *= 1e3
    slide = matching._Slide(x)
    for s in (10, 1_200, 2_500):
        q = x[s:s + 30] + rng.normal(size=(30, 2)) * 1e-3
        want = sorted((float(((x[i:i + 30] - q) ** 2).sum()), i) for i in range(len(x) - 29))[:5]
        got = slide.nearest(q, len(x), 5, str)
        assert [i for _, i in got] == [i for _, i in want]


def test_many_short_histories_by_one_product(monkeypatch):
    """Pieces of many objects are compared with all tails at once, long tails by FFT, and nothing is compared piece by tail in Python."""
    rng = np.random.default_rng(5)
    histories = [rng.normal(size=(int(n), 2)) for n in rng.integers(8, 40, 60)]
    histories[7] = histories[3].copy()
    histories[9][4, 0] = np.nan
    tails = [histories[3][2:14], *[rng.normal(size=(12, 2)) for _ in range(6)], rng.normal(size=(9, 2)), np.full((12, 2), np.nan)]
    piece = [{"first": 5, "v": h.ravel().tolist(), "life": list(range(len(h)))} for h in histories]
    batch = pa.RecordBatch.from_arrays([pa.array([f"u{i}" for i in range(60)]), pa.array(piece, pa.struct({"first": pa.int64(), "v": pa.list_(pa.float64()), "life": pa.list_(pa.float64())}))], ["key", "piece"])
    want = []
    for i, q in enumerate(tails):
        cand = [(float(((h[s:s + len(q)] - q) ** 2).sum()), f"u{u}:{5 + s}", float(s + len(q) - 1)) for u, h in enumerate(histories) for s in range(len(h) - len(q) + 1)]
        want += [(i, n, life, d) for d, n, life in sorted(c for c in cand if c[0] == c[0])[:5]]
    for records, direct in ((4_096, 1_024), (50, 1_024), (50, 1)):
        monkeypatch.setattr(matching, "RECORDS", records)
        monkeypatch.setattr(matching, "DIRECT", direct)
        calls, slide = [], matching._Slide
        monkeypatch.setattr(matching, "_Slide", lambda x: calls.append(1) or slide(x))
        search = matching._Nearest(list(range(len(tails))), tails, 5, 16_384)
        for some in (batch.slice(0, 25), batch.slice(25)):
            search.add(some, 2)
        got = [(t, f"{k}:{w}", life, d) for t, k, w, m, d, life in search.rows()]
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert [g[3] for g in got] == pytest.approx([np.sqrt(w[3] / tails[w[0]].size) for w in want], abs=1e-9)
        assert bool(calls) == (direct == 1)
        monkeypatch.setattr(matching, "_Slide", slide)
