"""Wide window vectors: arrays against built-in aggregates, over small batches, unknown values, short objects and NULL keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import features as Ft
from driftline.operators import windows as W
from driftline.plans import domains as D

CHANNELS = ["x", "y", "z"]


def histories(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for o, n in enumerate([40, 13, 12, 3, 2, 31, 1, 25]):
        for i in range(n):
            x, y = (None if rng.random() < 0.15 else float(rng.normal() * 10 ** rng.integers(0, 4)) for _ in range(2))
            rows.append((None if o == 5 else o % 3, f"o{o}", i, float(i + rng.random() / 2), x, y if o != 7 else None, 0.1))
    return spark.createDataFrame(rows, "a int, b string, i int, t double, x double, y double, z double").repartition(5)


def vector(s):
    return {**Ft.monitoring_vector(s, CHANNELS), **{f"{c}_slope": Ft.slope(s, c) for c in CHANNELS}, **{f"{c}_ratio": Ft.late_early(s, c) for c in CHANNELS}}


@pytest.mark.parametrize("width,stride,shrink", [(12, 5, False), (12, 4, True), (7, 3, True), (3, 2, False)])
def test_arrays_equal_groups(spark, width, stride, shrink):
    df = histories(spark, width)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got, want = ({(r.a, r.b, r.win): r.asDict() for r in W.window_features(df, ["a", "b"], ["t"], width, stride, vector, stages=Ft.difference_stages(CHANNELS),
                                                                             last=["t", "i"], shrink=shrink, form=form).collect()} for form in ("arrays", "groups"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and len(got) > 10
    for k, row in want.items():
        assert list(got[k]) == list(row)
        for name, v in row.items():
            assert got[k][name] == (pytest.approx(v, rel=1e-8, abs=1e-7) if isinstance(v, float) else v), (k, name)


def test_wide_vectors_do_not_copy_rows(spark):
    df = histories(spark, 1)
    plan = lambda **kw: W.window_features(df, ["a", "b"], ["t"], 12, 5, vector, stages=Ft.difference_stages(CHANNELS), **kw)._jdf.queryExecution().toString()
    assert "Generate" not in plan() and "Generate" in plan(form="groups")
    # cut objects and aggregates without an array form stay with built-in ones
    assert "Generate" in plan(limit=20)
    wide = lambda s: {**vector(s), "at": s.agg(F.max_by, F.col("x"), F.col("pos"))}
    assert "Generate" in W.window_features(df, ["a", "b"], ["t"], 12, 5, wide, stages=Ft.difference_stages(CHANNELS))._jdf.queryExecution().toString()


@pytest.mark.parametrize("width,stride,limit", [(12, 5, 10_000), (8, 1, 10_000), (3, 2, 10_000), (12, 5, 20)])
def test_vectors_equal_columns(spark, width, stride, limit):
    """The monitoring vector as one array: unknown values, NULL keys, small batches, cut objects."""
    df, key, setting = histories(spark, width + stride), ["a", "b"], D.Setting(width, stride, 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got, names = D.monitoring_vectors(df, key, ["t"], CHANNELS, setting, {"i": F.col("i"), "left": F.col("n") - 1 - F.col("pos")}, limit=limit)
        want, same = D.monitoring_windows(df, key, ["t"], CHANNELS, setting, ["i"])
        found, plain = ({(r.a, r.b, r.win): r for r in x.collect()} for x in (got, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = {(r.a, r.b): r["count"] for r in df.groupBy(*key).count().collect()}
    assert names == same and got.columns == ["a", "b", "win", "i", "left", "features"] and found.keys() == plain.keys() and len(found) > 10
    for k, row in plain.items():
        assert found[k].i == row.i and found[k].left == sizes[k[:2]] - width - k[2] and len(found[k].features) == len(names)
        for name, v in zip(names, found[k].features):
            assert v == pytest.approx(np.nan if row[name] is None else row[name], rel=1e-8, abs=1e-7, nan_ok=True), (k, name)
    assert any(np.isnan(r.features).any() for r in found.values())
