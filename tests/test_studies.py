"""Cross-validated studies against fits on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.plans import domains as D, studies

SETTING = D.Setting(4, 1, 3, clip=8.0, basin=3.0, warning=2.0)


def _discriminant(x, y):
    a, b = x[y == 0], x[y == 1]
    within = (len(a) * np.cov(a.T, bias=True) + len(b) * np.cov(b.T, bias=True)) / (len(a) + len(b))
    w = np.linalg.solve(within, b.mean(axis=0) - a.mean(axis=0))
    w /= np.linalg.norm(w)
    return w, w @ (a.mean(axis=0) + b.mean(axis=0)) / 2


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(8)
    rows = []
    for cell in range(6):
        for cycle in range(12 + cell):
            fade = 2.0 - 0.05 * cycle * (1 + 0.1 * cell)
            for s in range(6):
                rows.append((cell, cycle, s, fade * (4.2 - 0.2 * s) + float(rng.normal(0, 0.02)), 2.0 + float(rng.normal(0, 0.01)), 24.0 + s * 0.5, 10.0 * s))
    points = spark.createDataFrame(rows, "cell int, cycle int, s int, voltage double, current double, temperature double, time_s double")
    w, names = studies.battery_windows(points, "cell", "cycle", ["s"], F.max("voltage"), setting=SETTING)
    return w.cache(), names


def test_battery_vector(windows):
    w, names = windows
    assert len(names) == 3 * 20 + 5 and set(names) <= set(w.columns)
    rows = w.where("cell = 2").orderBy("win").collect()
    assert [r["win"] for r in rows] == list(range(14 - 4 + 1))
    assert [r["rul"] for r in rows] == [min(8.0, float(10 - i)) for i in range(11)]
    assert all(r["cap_slope"] < 0 for r in rows)


def test_held_out_reports(windows):
    w, _ = windows
    features, due = ["cap_slope", "cap_last", "energy_mean"], F.col("rul") <= SETTING.warning
    moments = studies.fit_folds(w, "cell", features, due)
    report = {r["cell"]: r for r in studies.object_report(studies.apply_held_out(w, moments, "cell", features), ["cell"], due).collect()}
    rows = w.select("cell", "rul", *features).toPandas()
    x, y, cell = rows[features].to_numpy(), (rows["rul"] <= SETTING.warning).to_numpy().astype(int), rows["cell"].to_numpy()
    assert set(report) == set(range(6))
    for c in range(6):
        coefficients, cut = _discriminant(x[cell != c], y[cell != c])
        hit, own = x[cell == c] @ coefficients > cut, y[cell == c]
        got = report[c]
        assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (int((hit & (own == 1)).sum()), int((hit & (own == 0)).sum()), int((~hit & (own == 1)).sum()), int((~hit & (own == 0)).sum()))
        lead = rows["rul"].to_numpy()[cell == c][hit & (own == 1)]
        assert got["detected"] == (len(lead) > 0) and got["first_detection_rul"] == (lead.max() if len(lead) else None)


def test_pooled_rates(spark):
    report = spark.createDataFrame([(1, 3, 1, 0, 6, True), (2, 0, 0, 2, 5, False)], "cell int, tp long, fp long, fn long, tn long, detected boolean")
    row = studies.pooled(report).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["n_detected"], row["n_objects"]) == (3, 1, 2, 11, 1, 2)
    assert row["precision"] == pytest.approx(0.75) and row["recall"] == pytest.approx(0.6)


def test_cross_dataset(windows):
    w, _ = windows
    w = w.withColumn("dataset", F.col("cell") % 2)
    features, due = ["cap_slope", "cap_last"], F.col("rul") <= SETTING.warning
    dev, test = w.where("cell < 4"), w.where("cell >= 4")
    got = {(r["fit"], r["dataset"]): r for r in studies.cross_dataset(dev, test, "dataset", features, due).collect()}
    frame = w.select("cell", "dataset", "rul", *features).toPandas()
    for how in ("own", "others"):
        for d in (0, 1):
            fit = frame[(frame.cell < 4) & ((frame.dataset == d) == (how == "own"))]
            coefficients, cut = _discriminant(fit[features].to_numpy(), (fit.rul <= 2).to_numpy().astype(int))
            held = frame[(frame.cell >= 4) & (frame.dataset == d)]
            hit, own = held[features].to_numpy() @ coefficients > cut, (held.rul <= 2).to_numpy()
            assert (got[how, d]["tp"], got[how, d]["fp"]) == (int((hit & own).sum()), int((hit & ~own).sum()))


def test_one_class_and_empty(spark):
    """A fit that has seen one class gives no report; an empty table gives none either."""
    w = spark.createDataFrame([(1, 0.0, 1.0, 2.0), (1, 5.0, 1.5, 2.5), (2, 5.0, 0.5, 1.0), (2, 5.0, 0.7, 1.2)], "cell int, rul double, a double, b double")
    due = F.col("rul") <= 2
    for df, left in ((w, {2}), (w.where("cell > 9"), set())):
        held = studies.apply_held_out(df, studies.fit_folds(df, "cell", ["a", "b"], due), "cell", ["a", "b"])
        assert {r["cell"] for r in studies.object_report(held, ["cell"], due).collect()} == left
