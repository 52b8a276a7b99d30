"""Sliced ordering gives what one plain window gives, with one object holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.models import evaluate
from driftline.operators import ordering as O
from driftline.operators import windows as W
from driftline.functions import features as Ft


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({
        "obj": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n)), "t": rng.integers(0, 900, n).astype(float),
        "id": np.arange(n), "x": rng.normal(size=n).round(2), "y": rng.normal(size=n).round(1)})
    pdf.loc[pdf.id % 7 == 0, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    return df.repartition(6).cache()


SMALL = {"limit": 100}


def same(a, b, by, digits=9):
    x, y = a.toPandas(), b.toPandas()
    assert sorted(x.columns) == sorted(y.columns)
    x = x.sort_values(by).reset_index(drop=True)[sorted(x.columns)]
    y = y.sort_values(by).reset_index(drop=True)[sorted(x.columns)]
    assert len(x) > 0
    pd.testing.assert_frame_equal(x, y, check_dtype=False, atol=10 ** -digits, rtol=1e-9)


def test_layout_is_chosen_by_size(skewed):
    assert not O.layout_of(skewed, ["obj"], ["t"]).sliced
    cut = O.layout_of(skewed, ["obj"], ["t"], limit=100)
    assert cut.sliced
    pieces = O.with_slice(skewed, cut, ["t"]).groupBy("obj", "_slice").count().agg(F.max("count")).first()[0]
    assert pieces <= 150


def test_position(skewed):
    same(O.with_position(skewed, ["obj"], ["t", "id"]), O.with_position(skewed, ["obj"], ["t", "id"], **SMALL), "id")


def test_position_without_key(skewed):
    same(O.with_position(skewed, [], ["x", "id"]), O.with_position(skewed, [], ["x", "id"], **SMALL), "id")


def test_running(skewed):
    m = {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x")), "last": ("last", F.col("y"))}
    same(O.running(skewed, ["obj"], ["t", "id"], m), O.running(skewed, ["obj"], ["t", "id"], m, **SMALL), "id", 7)


@pytest.fixture(scope="module")
def rough(spark):
    """NULL keys, NULL and NaN values, NULL and text orders, one date that most rows share."""
    rng = np.random.default_rng(5)
    rows = [(None if k % 5 == 0 else int(rng.integers(0, 3)), None if k % 11 == 0 else ("2020" if k % 4 else f"20{k % 90:02d}"), k,
             None if k % 3 == 0 else float("nan") if k % 17 == 0 else float(rng.integers(0, 9)), float(k % 7)) for k in range(900)]
    return spark.createDataFrame(rows, "obj int, day string, id int, x double, y double").repartition(5).cache()


@pytest.mark.parametrize("limit", [10, 120])
def test_missing_keys_and_values(rough, limit):
    small = {"limit": limit}
    m = {"s": ("sum", F.col("y")), "sx": ("sum", F.when(~F.isnan("x"), F.col("x"))), "hi": ("max", F.col("x")), "last": ("last", F.col("x"))}
    for f in (lambda **k: O.with_position(rough, ["obj"], ["day", "id"], **k),
              lambda **k: O.running(rough, ["obj"], ["day", "id"], m, **k),
              lambda **k: O.per_group(rough, ["obj"], {"n": F.count("x"), "top": F.max("y")}, **k),
              lambda **k: O.average_ranks(rough, ["obj"], ["x", "y"], **k),
              lambda **k: W.fill_gaps(rough, ["obj"], ["day", "id"], "x", "filled", **k),
              lambda **k: W.smooth(rough, ["obj"], ["day", "id"], ["y"], 5, **k)):
        same(f(), f(**small), "id")
    same(O.quantiles(rough, "x", {"a": 0.3, "b": 0.9}, ["obj"]), O.quantiles(rough, "x", {"a": 0.3, "b": 0.9}, ["obj"], **small), ["obj"])


def test_equal_order_values_are_divided(rough):
    one = rough.withColumn("obj", F.lit(1)).withColumn("day", F.lit("2020"))
    cut = O.with_slice(one, O.layout_of(one, ["obj"], ["day"], limit=50), ["day"])
    assert cut.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 100


def test_frames_cross_chunk_borders(skewed):
    for f in (lambda **k: W.smooth(skewed, ["obj"], ["t", "id"], ["x"], 5, **k),
              lambda **k: W.rolling_std(skewed, ["obj"], ["t", "id"], "x", 50, **k)):
        same(f(), f(**SMALL), "id")


@pytest.mark.parametrize("form", ["frames", "groups"])
def test_windows_cross_chunk_borders(skewed, form):
    feats = lambda s: {**Ft.time_domain(s, "x"), **Ft.rate(s, "x"), **Ft.spectrum(s, "x"), "sl": Ft.slope(s, "x"), "le": Ft.late_early(s, "x")}
    run = lambda f, **k: W.window_features(skewed, ["obj"], ["t", "id"], 12, 5, feats, stages=Ft.difference_stages(["x"]), last=["t"], form=f, **k)
    same(run("groups"), run(form, **SMALL), ["obj", "win"])


def test_fill_gaps(skewed):
    f = lambda **k: W.fill_gaps(skewed, ["obj"], ["t", "id"], "y", "filled", **k)
    same(f(), f(**SMALL), "id")
    assert f().where("filled IS NULL").count() == 0


def test_prefix_stats(skewed):
    f = lambda **k: W.prefix_stats(skewed, ["obj"], ["t", "id"], ["x", "y"], **k)
    same(f(), f(**SMALL), "id", 7)


def test_average_ranks(skewed):
    f = lambda **k: O.average_ranks(skewed, ["obj"], ["x"], **k)
    a, b = f().toPandas(), f(**SMALL).toPandas()
    want = skewed.toPandas().set_index("id").groupby("obj")["x"].rank()
    for got in (a, b):
        got = got.set_index("id")["rank_x"]
        assert np.allclose(got.sort_index(), want.sort_index())


def test_quantiles(skewed):
    probs = {"a": 0.05, "m": 0.5, "z": 0.95, "lo": 0.0, "hi": 1.0}
    pdf = skewed.toPandas()
    for kw in ({}, SMALL):
        got = O.quantiles(skewed, "x", probs, **kw).first()
        for name, p in probs.items():
            assert got[name] == pytest.approx(np.quantile(pdf.x, p), abs=1e-12)
        per = O.quantiles(skewed, "x", probs, ["obj"], **kw).toPandas().set_index("obj")
        for obj, g in pdf.groupby("obj"):
            for name, p in probs.items():
                assert per.loc[obj, name] == pytest.approx(np.quantile(g.x, p), abs=1e-12)


def test_order_statistic(skewed):
    xs = np.sort(skewed.toPandas().x)
    want = xs[int(np.ceil(0.9 * len(xs))) - 1]
    for kw in ({}, SMALL):
        assert O.quantiles(skewed, "x", {"q": 0.9}, discrete=True, **kw).first()["q"] == want


def test_spearman_both_ways(skewed):
    f = lambda **k: evaluate.spearman(skewed, "x", "y", ["obj"], **k)
    same(f(), f(**SMALL), "obj")
    g = lambda **k: evaluate.spearman(skewed, "x", "y", **k)
    same(g(), g(**SMALL), "n")
    pdf = skewed.toPandas().dropna()
    assert g().first()["rho"] == pytest.approx(pdf.x.rank().corr(pdf.y.rank()))


def test_mann_whitney_counts_pairs(skewed):
    pdf = skewed.toPandas()
    a, b = pdf.x[pdf.obj == 0].to_numpy(), pdf.x[pdf.obj != 0].to_numpy()
    want = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    for kw in ({}, SMALL):
        got = evaluate.mann_whitney(skewed, "x", F.col("obj") == 0, **kw).first()
        assert (got["u"], got["n1"], got["n2"]) == (want, len(a), len(b))


def test_ks_both_ways(skewed):
    pdf = skewed.toPandas()
    a, b = np.sort(pdf.x[pdf.obj == 0]), np.sort(pdf.x[pdf.obj != 0])
    grid = np.unique(pdf.x)
    want = np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)).max()
    for kw in ({}, SMALL):
        assert evaluate.two_sample_ks(skewed, ["x"], F.col("obj") == 0, **kw).first()["ks"] == pytest.approx(want)


def test_tasks_do_not_grow_with_the_pieces(spark):
    """Many small pieces come from few ranges, rise in order, and hold at most half the limit."""
    rows = spark.range(6_000).select((F.col("id") % 2).alias("obj"), F.floor(F.col("id") / 7).alias("t"), F.col("id").alias("x"))
    layout = O.layout_of(rows, ["obj"], ["t"], limit=20)
    cut = O.with_slice(rows, layout, ["t"])
    assert layout.pieces == 600 and len(cut.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = sorted(map(tuple, cut.select("obj", "t", "_tie", "_slice").collect()))
    assert [g[3] for g in got] == sorted(g[3] for g in got)
    assert max(cut.groupBy("_slice").count().toPandas()["count"]) <= 10
    placed = O.with_position(rows, ["obj"], ["t", "x"], limit=20).collect()
    want = {r.x: i for o in (0, 1) for i, r in enumerate(sorted((p for p in placed if p.obj == o), key=lambda p: (p.t, p.x)))}
    assert all(p.pos == want[p.x] and p.n == 3_000 for p in placed)
