"""Operators on published inputs give the published results."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftline.functions.stats import mann_whitney_p, spearman_p
from driftline.models import calibrate, evaluate
from driftline.operators import matching

DATA = Path(__file__).parent / "data"


def read(spark, name):
    return spark.read.option("header", True).schema("true_rul double, x double").csv(str(DATA / name))


def test_sweep_of_final_distances(spark):
    df = read(spark, "final_distances.csv")
    best = calibrate.best_row(calibrate.precision_recall_sweep(df, "x", F.col("true_rul") <= 50)).first()
    assert (best["tp"], best["fp"], best["fn"]) == (32, 5, 1)
    assert best["f1"] == pytest.approx(0.914286, abs=1e-6)
    assert best["precision"] == pytest.approx(0.864865, abs=1e-6)
    assert best["recall"] == pytest.approx(0.969697, abs=1e-6)
    assert best["eps"] == pytest.approx(18.69769, abs=1e-5)


def test_prediction_errors(spark):
    row = matching.errors(read(spark, "predicted_life.csv"), "x", "true_rul").first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (28, 1, 5, 66)
    assert row["rmse"] == pytest.approx(22.1664, abs=1e-4)
    assert row["mae"] == pytest.approx(16.5033, abs=1e-4)
    assert row["score"] == pytest.approx(2201.078, abs=1e-3)


def test_detection_intervals(spark):
    df = spark.createDataFrame([("all", 795, 0, 0, 0), ("few", 31, 1476, 7, 169)], "n string, tp long, fp long, fn long, tn long")
    rows = {r["n"]: r for r in evaluate.with_intervals(evaluate.with_rates(df)).collect()}
    a, b = rows["all"], rows["few"]
    assert (round(a["recall_lo"], 4), round(a["recall_hi"], 9)) == (0.9952, 1.0)
    only = evaluate.with_intervals(evaluate.with_rates(df.where("n = 'all'")), "recall").first()
    assert (round(only["f1_lo"], 4), round(only["f1_hi"], 9)) == (0.9976, 1.0)          # as published
    assert round(b["precision"], 5) == 0.02057 and round(b["recall"], 5) == 0.81579 and round(b["f1"], 5) == 0.04013
    assert [round(b[c], 4) for c in ("precision_lo", "precision_hi", "recall_lo", "recall_hi", "f1_lo", "f1_hi")] == [
        0.0145, 0.0291, 0.6658, 0.9078, 0.0284, 0.0563]


def test_no_trials(spark):
    row = evaluate.with_intervals(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).first()
    assert [row[c] for c in ("precision_lo", "precision_hi", "recall_lo", "recall_hi", "f1_lo", "f1_hi")] == [0.0] * 6


# fixed values: ten held-out batteries (tp, fp, fn, tn, rank correlation)
BATTERIES = [(13, 0, 18, 123, 0.9328292), (16, 0, 15, 123, 0.8355051), (31, 7, 0, 116, 0.9737396), (6, 31, 25, 56, 0.6826738),
             (15, 5, 16, 62, 0.1314321), (30, 31, 1, 36, 0.6142660), (17, 0, 14, 67, 0.4292728), (19, 13, 12, 14, 0.6351164),
             (31, 19, 0, 8, 0.7051893), (25, 15, 6, 12, 0.6549878)]
# fixed values: eleven held-out bearings (rank correlation, windows, published p)
BEARINGS = [(0.28458514670224516, 2356, 3.875701138960135e-45), (-0.13963287850074577, 1409, 1.4211070345844375e-07),
            (0.051052253541228165, 2444, 0.011595652669331089), (-0.36588597002810863, 2429, 7.950372098679317e-78),
            (0.4883888873277654, 2240, 1.2914486450965791e-134), (0.0580891696314102, 1936, 0.010575188803285498),
            (0.5584455820961536, 732, 2.9753943003217177e-61), (-0.3878189965286406, 2292, 3.808876414343313e-83),
            (-0.39319397447889864, 682, 1.225757099835014e-26), (-0.19724454209833803, 211, 0.004021948042335023),
            (0.6327065209309495, 415, 8.544837116999177e-48)]


def test_summed_folds(spark):
    df = spark.createDataFrame(BATTERIES, "tp long, fp long, fn long, tn long, rho double")
    total = df.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], F.avg("rho").alias("rho"))
    row = evaluate.with_rates(total).first()
    assert row["precision"] == pytest.approx(0.626543, abs=1e-6) and row["recall"] == pytest.approx(0.654839, abs=1e-6)
    assert row["f1"] == pytest.approx(0.640379, abs=1e-6) and row["rho"] == pytest.approx(0.659501, abs=1e-6)


def test_bearing_summary(spark):
    df = spark.createDataFrame([(r,) for r, _, _ in BEARINGS], "rho double")
    row = evaluate.summary_of(df, "rho").first()
    assert row["mean"] == pytest.approx(0.053590, abs=1e-6) and row["n_positive"] == 6


@pytest.mark.parametrize("rho,n,p", BEARINGS)
def test_rank_correlation_p(rho, n, p):
    assert spearman_p(rho, n) == pytest.approx(p, rel=1e-6)


def test_mann_whitney_p_direction():
    assert mann_whitney_p(0, 20, 20) < 1e-6 < 0.5 < mann_whitney_p(400, 20, 20)
    assert mann_whitney_p(200, 20, 20) == pytest.approx(0.5, abs=0.01)


# fixed values: rank correlation of distance and time for each of 26 held-out events
EVENT_RHO = [
    -0.4, 0.4, 0.8, 0.4, 1.0, 0.8, -0.028571, -0.4, 0.657143, -0.2,
    0.6, -0.657143, 0.6, 0.9, 0.5, 0.1, 0.3, 0.7, 1.0, 0.1,
    0.8, 0.6, 0.0, -0.314286, -1.0, 0.8,
]
# fixed values: first excursions per year, 2020 to 2025
ONSETS = [(2020, 4), (2021, 6), (2022, 17), (2023, 23), (2024, 21), (2025, 37)]


def test_prefix_walk_summary(spark):
    df = spark.createDataFrame([(x,) for x in EVENT_RHO], "rho double")
    row = evaluate.summary_of(df, "rho").first()
    assert (round(row["mean"], 4), round(row["median"], 2), row["n_positive"], row["n_objects"]) == (0.3099, 0.45, 18, 26)
    assert round(row["share_positive"], 4) == 0.6923


def test_yearly_onset_correlation(spark):
    row = evaluate.spearman(spark.createDataFrame(ONSETS, "year int, n int"), "year", "n").first()
    assert (round(row["rho"], 6), row["n"]) == (0.942857, 6)
