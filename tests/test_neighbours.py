"""The partitioned neighbour search: copies of rows do not grow with the cells, and results equal brute force over many packs."""

import numpy as np
import pytest

from driftline.operators import knn


def brute(q, p, k, exclude):
    d = np.sqrt(((q[:, None, :] - p[None, :, :]) ** 2).sum(axis=2))
    if exclude:
        np.fill_diagonal(d, np.inf)
    out = {}
    for i in range(len(q)):
        order = sorted(range(len(p)), key=lambda j: (d[i, j], j))
        out[i] = [(j, d[i, j]) for j in order if np.isfinite(d[i, j])][:k]
    return out


@pytest.mark.parametrize("send,spread", [(4_000_000, 0.0), (40, 0.0), (40, 30.0)])
@pytest.mark.parametrize("exclude", [False, True])
def test_packs_against_brute_force(spark, monkeypatch, send, spread, exclude):
    """Random, clustered and equal points; tiles below a cell's size."""
    monkeypatch.setattr(knn, "_SEND", send * 4)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 4)) + spread * rng.integers(0, 5, (150, 1)), 3)
    x[100:130] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in knn.neighbours(df, df, 4, exclude_self=exclude, bound=4, tile=7).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbour, r.distance))
    want = brute(x, x, 4, exclude)
    assert got.keys() == want.keys()
    for i, rows in want.items():
        assert [j for j, _ in got[i]] == [j for j, _ in rows]
        assert [d for _, d in got[i]] == pytest.approx([d for _, d in rows], abs=1e-9)


def test_rows_are_sent_to_few_tiles(spark, monkeypatch):
    """1,600 points without structure have 40 cells; a row goes to about `_CUTS` tiles of the other side, not to each cell."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1_600, 24)))], "id long, vec array<double>").cache()
    sent, top = spark.sparkContext.accumulator(0), knn._top

    def counted(q, q_ids, p, *rest):
        sent.add(len(q) + len(p))
        return top(q, q_ids, p, *rest)

    monkeypatch.setattr(knn, "_top", counted)
    assert knn.neighbours(df, df, 3, bound=24, tile=10).count() == 3 * 1_600
    assert sent.value <= 2 * 1_600 * (knn._CUTS + 5)


def test_packs_share_cells_evenly():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 50, 400)
    pack = knn._packs(rng.normal(size=(400, 6)), sizes, -(-int(sizes.sum()) // 8))
    assert sorted(set(pack.tolist())) == list(range(8)) and np.bincount(pack, sizes).max() < sizes.sum() / 6
