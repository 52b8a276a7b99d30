"""Window features against a plain per-window evaluation."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from driftline.functions import features as Ft
from driftline.functions.spectral import top_eigenvalues
from driftline.operators import windows as W
from driftline.plans import orbits


def naive(x, y):
    d1, d2 = np.diff(x), np.diff(np.diff(x))
    i = np.arange(len(x))
    fft = np.abs(np.fft.rfft(x))
    corr = 0.0 if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1]
    return {"x_mean": x.mean(), "x_std": x.std(), "x_min": x.min(), "x_max": x.max(), "x_d1_mean": d1.mean(), "x_d1_std": d1.std(),
            "x_d2_mean": d2.mean() if len(d2) else 0.0, "x_slope": np.polyfit(i, x, 1)[0],
            "x_ratio": x[len(x) // 2:].mean() / (abs(x[:len(x) // 2].mean()) + 1e-10),
            **{f"x_fft{k}": fft[k] if k < len(fft) else 0.0 for k in range(1, 6)}, "corr_x_y": corr}


def feats(s):
    return {**Ft.time_domain(s, "x"), **Ft.rate(s, "x"), **Ft.spectrum(s, "x"), "x_slope": Ft.slope(s, "x"),
            "x_ratio": Ft.late_early(s, "x"), **Ft.correlations(s, ["x", "y"])}


def run(spark, pdf, width, stride, **kw):
    df = spark.createDataFrame(pdf)
    return W.window_features(df, ["obj"], ["t"], width, stride, feats, stages=Ft.difference_stages(["x"]), last=["t"], **kw).toPandas()


@pytest.mark.parametrize("form", ["frames", "groups"])
@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), width=st.integers(4, 13), stride=st.integers(1, 5))
def test_features_equal_naive(spark, form, seed, width, stride):
    rng = np.random.default_rng(seed)
    sizes = {0: 30, 1: width, 2: width - 1, 3: width + 1, 4: 1}
    pdf = pd.concat([pd.DataFrame({"obj": o, "t": np.arange(n) * 1.5, "x": rng.normal(size=n), "y": rng.normal(size=n)}) for o, n in sizes.items()])
    got = run(spark, pdf, width, stride, form=form).set_index(["obj", "win"])
    want = {}
    for o, g in pdf.groupby("obj"):
        for s in range(0, len(g) - width + 1, stride):
            want[(o, s)] = {**naive(g.x.to_numpy()[s:s + width], g.y.to_numpy()[s:s + width]), "t": g.t.to_numpy()[s + width - 1]}
    assert set(got.index) == set(want)
    for k, row in want.items():
        for name, v in row.items():
            assert got.loc[k, name] == pytest.approx(v, abs=1e-8), (k, name)


def test_short_objects_get_one_window(spark):
    sizes = {2: 2, 3: 3, 25: 25, 29: 29, 30: 30, 31: 31}
    pdf = pd.concat([pd.DataFrame({"obj": o, "t": np.arange(n) * 1.0, "x": np.arange(n) ** 2 * 1.0, "y": 1.0}) for o, n in sizes.items()])
    got = run(spark, pdf, 30, 1, shrink=True).set_index(["obj", "win"]).sort_index()
    assert list(got.index) == [(3, 0), (25, 0), (29, 0), (30, 0), (31, 0), (31, 1)]
    for (o, s), row in got.iterrows():
        x = np.arange(sizes[o])[s:s + min(30, sizes[o])] ** 2 * 1.0
        for name, v in naive(x, np.ones(len(x))).items():
            assert row[name] == pytest.approx(v, abs=1e-6), (o, name)


def test_constant_channel(spark):
    pdf = pd.DataFrame({"obj": 1, "t": np.arange(40.0), "x": 5.0, "y": np.arange(40.0)})
    got = run(spark, pdf, 30, 5)
    assert (got.corr_x_y == 0).all() and (got.x_std == 0).all() and (got.x_fft1.abs() < 1e-9).all()


def test_rates_with_repeated_times(spark):
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.choice([0.0, 0.5, 2.0], 40))
    pdf = pd.DataFrame({"obj": 1, "t": t, "i": np.arange(40), "x": rng.normal(size=40), "z": rng.normal(size=40)})
    got = orbits.decay_windows(spark.createDataFrame(pdf), "obj", ["t", "i"], time="t", channels=["x", "z"], stride=5).toPandas().set_index("win")
    for s in range(0, 11, 5):
        x, tt = pdf.x.to_numpy()[s:s + 30], t[s:s + 30]
        dt = np.maximum(np.diff(tt), 1e-6)
        d1 = np.diff(x) / dt
        d2 = np.diff(d1) / dt[:-1]
        for name, v in {"x_r1_mean": d1.mean(), "x_r1_std": d1.std(), "x_r2_mean": d2.mean()}.items():
            assert got.loc[s, name] == pytest.approx(v, rel=1e-9)


def test_covariance_eigenvalues(spark):
    rng = np.random.default_rng(2)
    chans = ["a", "b", "c"]
    pdf = pd.DataFrame(rng.normal(size=(25, 3)), columns=chans).assign(obj=1, t=np.arange(25.0))
    w = W.window_features(spark.createDataFrame(pdf), ["obj"], ["t"], 10, 5, lambda s: Ft.covariances(s, chans))
    cells = [f"cov_{a}_{b}" for i, a in enumerate(chans) for b in chans[i:]]
    got = w.select("win", top_eigenvalues(cells, 3).alias("e")).toPandas().set_index("win")["e"]
    for s, e in got.items():
        want = np.sort(np.linalg.eigvalsh(np.cov(pdf[chans].to_numpy()[s:s + 10], rowvar=False)))[::-1]
        assert np.allclose(e, [*want, 0, 0])


def test_vector_sizes():
    from driftline.catalog import features as C
    assert len(C.monitoring_catalogue(C.TURBOFAN_SENSORS)) == 264
    assert len(C.decay_catalogue()) == 63
    assert len(C.CONJUNCTION_FEATURES) == 35 and len(C.CONJUNCTION_CONSISTENT) == 15
    assert len(C.ASTEROID_WEIGHTS) == 28 == len(C.ASTEROID_WEIGHTS_BY_POSITION)


def test_baseline_of_constant_start(spark):
    pdf = pd.DataFrame({"obj": 1, "t": np.arange(15.0), "x": [2.0] * 10 + [5.0] * 5})
    got = W.baseline_scaled(spark.createDataFrame(pdf), ["obj"], ["t"], ["x"]).orderBy("t").toPandas()
    assert list(got.x_scaled) == [0.0] * 10 + [3.0] * 5


def test_smoothing_is_zero_padded(spark):
    x = np.array([1.0, 2.0, 4.0])
    got = W.smooth(spark.createDataFrame(pd.DataFrame({"obj": 1, "t": range(3), "x": x})), ["obj"], ["t"], ["x"]).orderBy("t").toPandas()
    assert np.allclose(got.x_smooth, [7 / 5, 7 / 5, 7 / 5])
