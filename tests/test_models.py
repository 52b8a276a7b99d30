"""Neighbours, projections, thresholds, detection against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.models import calibrate, evaluate, lda, scale
from driftline.operators import detect, knn
from driftline.operators.matching import match_remaining_life
from driftline.plans.orbits import tightened_basin


@pytest.mark.parametrize("ex", [False, True])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_neighbours_both_ways(spark, k, ex):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(300, 4)).round(1)
    x[:100] = x[0]                                     # a third of the points are copies of one
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    pts = df if ex else df.where("id % 2 = 0")
    p = x if ex else x[::2]
    ids = np.arange(300) if ex else np.arange(0, 300, 2)
    d = np.sqrt(((x[:, None] - p[None]) ** 2).sum(-1))
    want = {}
    for q in range(300):
        order = sorted((d[q, j], ids[j]) for j in range(len(p)) if not (ex and ids[j] == q))[:k]
        want[q] = order
    for kw in ({}, {"bound": 40, "tile": 64, "pivots": 8}):
        got = knn.neighbours(df, pts, k, exclude_self=ex, **kw).toPandas().sort_values(["id", "rank"])
        assert len(got) == 300 * k
        for q, g in got.groupby("id"):
            assert [n for _, n in want[q]] == list(g.neighbour)
            assert np.allclose([v for v, _ in want[q]], g.distance, atol=1e-9)


@pytest.mark.parametrize("ex", [False, True])
def test_line_distances_both_ways(spark, ex):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000).round(2)
    x[:1300] = 0.5
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(4000), "p": x}))
    pts = df if ex else df.where("id % 2 = 0")
    ref = np.sort(x if ex else x[::2])
    for k in (1, 5, 3000):
        for kw in ({}, {"bound": 10, "limit": 300}):
            got = knn.distance_on_line(df, pts, "p", k=k, exclude_self=ex, **kw).toPandas().set_index("id").sort_index()
            for q in range(0, 4000, 997):
                near = np.sort(np.abs(ref - x[q]))[1 if ex else 0:][:k]
                assert got.loc[q, "d_mean"] == pytest.approx(near.mean())
                assert got.loc[q, "d_kth"] == pytest.approx(near[-1])


def test_basin_smaller_than_k(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 5.0)], "id long, p double")
    pts = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "p double")
    for kw in ({}, {"bound": 1}):
        got = {r["id"]: r["d_mean"] for r in knn.distance_on_line(df, pts, "p", k=5, **kw).collect()}
        assert got == {1: pytest.approx(7 / 3), 2: pytest.approx(8 / 3)}


def _classes(spark, n=400, classes=2, d=4):
    rng = np.random.default_rng(9)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + y[:, None] * np.linspace(0.2, 1.0, d)
    cols = [f"f{i}" for i in range(d)]
    return x, y, cols, spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(label=y))


def test_two_class_projection(spark):
    x, y, cols, df = _classes(spark)
    w = {"f1": 2.0}
    model = lda.fit_two_class(df, cols, "label", w)
    z = (x - x.mean(0)) / x.std(0) * np.array([1.0, 2.0, 1.0, 1.0])
    sw = sum(((z[y == c] - z[y == c].mean(0)).T @ (z[y == c] - z[y == c].mean(0))) for c in (0, 1)) / (len(y) - 2)
    coef = np.linalg.solve(sw, z[y == 1].mean(0) - z[y == 0].mean(0))
    coef /= np.sqrt(coef @ sw @ coef)
    assert np.allclose([model.coef[c] for c in cols], coef, atol=1e-8)
    proj = model.score(df).toPandas().proj.to_numpy()
    assert np.allclose(np.sort(proj), np.sort((z - z.mean(0)) @ coef), atol=1e-8)
    assert proj[y == 1].mean() > proj[y == 0].mean()


def test_bucket_projection_with_shrinkage(spark):
    x, y, cols, df = _classes(spark, 300, 4, 5)
    model = lda.fit_buckets(df, cols, "label")
    z = (x - x.mean(0)) / x.std(0)
    within, grand = np.zeros((5, 5)), z.mean(0)
    between = np.zeros((5, 5))
    for c in range(4):
        g = z[y == c]
        s = g.std(0)
        u = (g - g.mean(0)) / s
        n, p = u.shape
        emp = u.T @ u / n
        mu = np.trace(emp) / p
        delta = ((emp - mu * np.eye(p)) ** 2).sum() / p
        beta = sum(((np.outer(r, r) - emp) ** 2).sum() for r in u) / (n * n * p)
        a = min(beta, delta) / delta
        within += len(g) / len(z) * ((1 - a) * emp + a * mu * np.eye(p)) * np.outer(s, s)
        between += len(g) / len(z) * np.outer(g.mean(0) - grand, g.mean(0) - grand)
    vals, vecs = np.linalg.eig(np.linalg.solve(within, between))
    want = np.real(vecs[:, np.argmax(np.real(vals))])
    got = np.array([model.coef[c] for c in cols])
    assert abs(got @ want) / np.linalg.norm(got) / np.linalg.norm(want) == pytest.approx(1.0, abs=1e-8)
    proj = model.score(df).toPandas()
    assert proj.proj[proj.label == 0].mean() > proj.proj.mean()


def test_bucket_with_one_row(spark):
    df = spark.createDataFrame([(float(i % 7), float((i * 3) % 5), 0 if i < 20 else 1 if i < 40 else 2) for i in range(41)], "a double, b double, label int")
    model = lda.fit_buckets(df, ["a", "b"], "label")
    assert all(math.isfinite(v) for v in model.coef.values())


def test_principal_components(spark):
    x, _, cols, df = _classes(spark)
    model, means = lda.fit_pca(df, cols, 2)
    got = np.stack(lda.project_pca(df, model, means).toPandas().embedding)
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.sort(np.abs(got), axis=0), np.sort(np.abs((x - x.mean(0)) @ vt[:2].T), axis=0), atol=1e-7)


def test_scaling_leaves_constants_alone(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0)], "a double, b double")
    out = scale.scale(df, scale.fit_stats(df, ["a", "b"])).toPandas()
    assert list(out.a) == [-1.0, 1.0] and list(out.b) == [0.0, 0.0]
    assert scale.varying(df, ["a", "b"]) == ["a"]


def test_dominant_regime_tie_takes_smallest(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate([3, 1, 3, 1, 2])], "t int, r int")
    assert df.agg(F.mode("r", True)).first()[0] == 1


def test_threshold_counts_are_strict(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (2.0, True), (3.0, False)], "d double, due boolean")
    rows = calibrate.threshold_counts(df, "d", F.col("due"), [2.0, 0.5, 2.0, 9.0]).orderBy("idx").collect()
    assert [(r["tp"], r["fp"], r["fn"], r["tn"]) for r in rows] == [(1, 0, 1, 2), (0, 0, 2, 2), (1, 0, 1, 2), (2, 2, 0, 0)]


def test_sweep_precision_is_one_when_silent(spark):
    df = spark.createDataFrame([(4.0, True), (8.0, False)], "d double, due boolean")
    rows = calibrate.precision_recall_sweep(df, "d", F.col("due")).orderBy("idx").collect()
    assert len(rows) == 200 and rows[0]["precision"] == 1.0 and rows[0]["recall"] == 0.0
    assert calibrate.best_row(calibrate.precision_recall_sweep(df, "d", F.col("due"))).first()["f1"] == 1.0


def test_conformal_sides(spark):
    d = np.arange(1.0, 100.0)
    df = spark.createDataFrame(pd.DataFrame({"d": d}))
    up = calibrate.conformal(df, "d", 0.1).first()
    assert up["eps"] == pytest.approx(np.quantile(d, 0.9 * 100 / 99)) and up["bound"] == pytest.approx(0.11)
    low = calibrate.conformal(df, "d", 0.1, side="lower").first()
    assert low["eps"] == 10.0 and (d < low["eps"]).mean() <= 0.1
    assert calibrate.conformal(df, "d", 0.001, side="lower").first()["eps"] is None


def test_approach_zone_falls_back_to_basin(spark):
    df = spark.createDataFrame(pd.DataFrame({"d": np.arange(10.0), "rul": [5.0] * 10}))
    assert calibrate.approach_zone(df, "d", "rul", 25).first()["eps"] == 8.0


def test_sustained_alert_restarts(spark):
    df = spark.createDataFrame([(1, i, f, 10.0 - i) for i, f in enumerate([1, 1, 0, 1, 1, 1, 1])], "obj int, t int, f int, rul double")
    row = detect.sustained_fire(df, ["obj"], ["t"], "rul", F.col("f") == 1).first()
    assert (row["fire_pos"], row["lead"]) == (5, 5.0)
    runs = detect.runs(df, ["obj"], ["t"], F.col("f") == 1, "t").first()
    assert runs["max_consecutive"] == 4 and runs["first_excursion"] == 0


def test_first_fire_needs_positive_lead(spark):
    df = spark.createDataFrame([(1, 0, 9.0, 3.0), (1, 1, 1.0, 0.0), (2, 0, 1.0, 4.0)], "obj int, t int, d double, rul double")
    rows = {r["obj"]: r for r in detect.first_fire(df, ["obj"], "t", "rul", detect.fire("d", 2.0)).collect()}
    assert not rows[1]["detected"] and rows[2]["detected"] and rows[2]["lead"] == 4.0


def test_segment_matching(spark):
    rng = np.random.default_rng(4)
    series = {o: rng.normal(size=(n, 2)).cumsum(0) for o, n in {1: 40, 2: 55, 3: 33, 10: 36, 11: 20}.items()}
    pdf = pd.concat([pd.DataFrame({"obj": o, "t": np.arange(len(s)), "a": s[:, 0], "b": s[:, 1], "rul": np.arange(len(s))[::-1] * 1.0}) for o, s in series.items()])
    df = spark.createDataFrame(pdf)
    smooth = {o: np.stack([np.convolve(s[:, j], np.ones(5) / 5, mode="same") for j in (0, 1)], 1) for o, s in series.items()}
    want = {}
    for o in (10, 11):
        m = min(30, len(smooth[o]))
        cand = sorted((np.sqrt(((smooth[o][-m:] - smooth[u][s:s + m]) ** 2).mean()), len(series[u]) - 1 - (s + m - 1))
                      for u in (1, 2, 3) for s in range(len(series[u]) - m + 1))[:5]
        w = [1 / (d + 1e-10) for d, _ in cand]
        want[o] = sum(a * r for a, (_, r) in zip(w, cand)) / sum(w)
    for kw in ({}, {"bound": 10, "limit": 20}):
        got = {r["obj"]: r["predicted_rul"] for r in match_remaining_life(
            df.where("obj >= 10"), df.where("obj < 10"), "obj", ["t"], ["a", "b"], "rul", **kw).collect()}
        assert got == {o: pytest.approx(v) for o, v in want.items()}


def test_tightened_basin(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(10)] + [(99.0, 0)], "proj double, label int")
    kept = sorted(r["proj"] for r in tightened_basin(df, F.col("label") == 1).collect())
    assert kept == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]


def test_summary_and_confusion(spark):
    df = spark.createDataFrame([(0.5,), (-0.1,), (0.2,)], "rho double")
    row = evaluate.summary_of(df, "rho").first()
    assert row["mean"] == pytest.approx(0.2) and row["median"] == 0.2 and row["n_positive"] == 2


def test_fits_without_one_fold(spark):
    """Fits from additive moments equal fits on the rows themselves."""
    from driftline.models import folds

    rng = np.random.default_rng(4)
    n, d = 600, 5
    y, fold = rng.integers(0, 2, n), rng.integers(0, 6, n)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 1000.0 + y[:, None] * rng.normal(size=d)
    df = spark.createDataFrame([(int(f), int(c), *map(float, v)) for f, c, v in zip(fold, y, x)], "fold int, y int, " + ", ".join(f"x{i} double" for i in range(d)))
    names = [f"x{i}" for i in range(d)]
    got = {r["fold"]: r for r in folds.leave_one_out_fits(folds.fold_moments(df, "fold", F.col("y"), names), "fold", d).collect()}
    for f in range(6):
        a, b = x[(fold != f) & (y == 0)], x[(fold != f) & (y == 1)]
        within = (len(a) * np.cov(a.T, bias=True) + len(b) * np.cov(b.T, bias=True)) / (len(a) + len(b))
        w = np.linalg.solve(within, b.mean(axis=0) - a.mean(axis=0))
        w /= np.linalg.norm(w)
        np.testing.assert_allclose(got[f]["w"], w, atol=1e-8)
        assert abs(got[f]["cut"] - w @ (a.mean(axis=0) + b.mean(axis=0)) / 2) < 1e-6


def test_p_values_as_columns(spark):
    """The column forms equal the plain numbers, in the middle and far out."""
    from driftline.functions import stats

    rhos = [(r, n) for r in (-1.0, -0.999, -0.6, -0.05, 0.0, 1e-6, 0.3, 0.81, 0.9999, 1.0) for n in (2, 3, 4, 5, 12, 80, 1_500, 200_000)]
    df = spark.createDataFrame(rhos, "rho double, n long")
    for row in df.withColumn("p", stats.spearman_p_of(F.col("rho"), F.col("n"))).collect():
        assert row["p"] == pytest.approx(stats.spearman_p(row["rho"], row["n"]), rel=1e-7, abs=1e-9), row
    tests = [(float(u), n1, n2, t) for n1, n2, t in ((1, 1, 0.0), (5, 9, 0.0), (40, 60, 120.0), (3_000, 7_000, 0.0), (0, 4, 0.0), (3, 3, 210.0)) for u in (0, n1 * n2 // 3, n1 * n2 / 2, n1 * n2)]
    df = spark.createDataFrame(tests, "u double, n1 long, n2 long, ties double")
    for less in (True, False):
        for row in df.withColumn("p", stats.mann_whitney_p_of(*(F.col(c) for c in ("u", "n1", "n2", "ties")), less=less)).collect():
            assert row["p"] == pytest.approx(stats.mann_whitney_p(row["u"], row["n1"], row["n2"], row["ties"], less=less), rel=1e-9, abs=1e-12), row


def test_set_points(spark):
    """Six noisy set points are found in order, whatever the order of rows; missing settings and few settings are defined."""
    rng = np.random.default_rng(6)
    true = [(0.0, 5.0), (0.0, 9.0), (4.0, 1.0), (10.0, 1.0), (10.0, 6.0), (20.0, 0.0)]
    rows = [(i % 6, float(true[i % 6][0] + rng.uniform(0, 0.2)), float(true[i % 6][1] + rng.uniform(0, 0.2))) for i in range(600)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(600)] + [(9, None, 1.0), (9, float("nan"), 1.0)], "g int, a double, b double")
    centres = scale.fit_set_points(df, ["a", "b"], 6)
    want = sorted(tuple(np.mean([[round(x[1], 3), round(x[2], 3)] for x in rows if x[0] == g], axis=0)) for g in range(6))
    np.testing.assert_allclose(centres, want, atol=1e-9)
    got = {(r["g"], r["regime"]) for r in scale.assign_set_points(df, centres, ["a", "b"]).collect()}
    order = sorted(range(6), key=lambda g: tuple(np.mean([[x[1], x[2]] for x in rows if x[0] == g], axis=0)))
    assert got == {(g, i) for i, g in enumerate(order)} | {(9, None)}
    assert scale.fit_set_points(df.where("g = 9"), ["a", "b"], 6) == []
    assert len(scale.fit_set_points(df.where("g < 2").withColumn("a", F.lit(1.0)).withColumn("b", F.col("g") * 1.0), ["a", "b"], 6)) == 2
    empty = scale.assign_set_points(df, [], ["a", "b"])
    assert empty.where("regime IS NOT NULL").count() == 0
