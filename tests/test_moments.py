"""Moments in slices: wide fits, many groups, unknown keys, and the driver's share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.models import folds, lda, moments


def wide(spark, n, d, seed=1):
    rng = np.random.default_rng(seed)
    y, fold = rng.integers(0, 3, n), rng.integers(0, 4, n)
    x = rng.normal(size=(n, d)) + y[:, None] * rng.normal(size=d)
    df = spark.createDataFrame([(int(f), int(c), v.tolist()) for f, c, v in zip(fold, y, x)], "fold int, y int, v array<double>").repartition(5)
    names = [f"x{i}" for i in range(d)]
    return df.select("fold", "y", *[F.col("v")[i].alias(c) for i, c in enumerate(names)]), names, fold, y, x


@pytest.mark.parametrize("piece,fan,held", [(4_096, 64, 64 << 20), (37, 2, 1)])
def test_class_moments_of_many_features(spark, monkeypatch, piece, fan, held):
    for name, v in (("SLICE", piece), ("FAN", fan), ("HELD", held)):
        monkeypatch.setattr(moments, name, v)
    df, names, _, y, x = wide(spark, 900, 120)
    got = lda.class_moments(df, names, "y")
    assert sorted(got) == [0, 1, 2]
    for c, m in got.items():
        assert m.n == (y == c).sum() and m.mean == pytest.approx(x[y == c].mean(axis=0))
        assert np.allclose(m.cov, np.cov(x[y == c].T, bias=True))


def test_unknown_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "a", 2.0), (None, None, 5.0), (3, "a", 7.0)], "k int, s string, x double")
    got = {(r.k, r.s): (r._n, list(r._s)) for r in moments.packed_sums(df, ["k", "s"], ["x"]).collect()}
    assert got == {(None, "a"): (2, [3.0, 5.0]), (None, None): (1, [5.0, 25.0]), (3, "a"): (1, [7.0, 49.0])}
    assert moments.packed_sums(df.limit(0), ["k", "s"], ["x"]).count() == 0 and lda.class_moments(df.limit(0), ["x"], "k") == {}


def test_fold_fits_of_many_features(spark):
    df, names, fold, y, x = wide(spark, 1_200, 60)
    df, keep = df.where("y < 2"), y < 2
    fold, y, x = fold[keep], y[keep], x[keep]
    table = folds.fold_moments(df, "fold", F.col("y"), names)

    def want(use):
        a, b = x[use & (y == 0)], x[use & (y == 1)]
        within = (len(a) * np.cov(a.T, bias=True) + len(b) * np.cov(b.T, bias=True)) / (len(a) + len(b))
        w = np.linalg.solve(within, b.mean(axis=0) - a.mean(axis=0))
        w /= np.linalg.norm(w)
        return w, w @ (a.mean(axis=0) + b.mean(axis=0)) / 2

    left = {r.fold: r for r in folds.leave_one_out_fits(table, "fold", 60).collect()}
    groups = {r.fit: r for r in folds.group_fits(table, "fold", {"low": [0, 1], "high": [2, 3]}, 60).collect()}
    assert sorted(left) == [0, 1, 2, 3] and sorted(groups) == ["high", "low"]
    for row, use in [*[(left[f], fold != f) for f in range(4)], (groups["low"], fold < 2), (groups["high"], fold >= 2)]:
        w, cut = want(use)
        assert np.allclose(row.w, w, atol=1e-8) and row.cut == pytest.approx(cut, abs=1e-8)


def test_264_features_of_six_classes_reach_the_driver_as_one_triangle_each(spark):
    names = [f"x{i}" for i in range(264)]
    df = spark.range(3_000).select((F.col("id") % 6).cast("int").alias("y"), *[F.sin(F.col("id") * (i + 1)).alias(c) for i, c in enumerate(names)])
    table = moments.packed_sums(df, ["y"], names).toArrow()
    assert table.nbytes < 6 * (264 * 267 // 2) * 8 * 1.2 and table.num_rows == 6 * 9
