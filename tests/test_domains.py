"""Domain fits: undefined values inside the tasks, and how often a search makes its windows read again."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.models import lda, moments, scale
from driftline.plans import domains as D
from driftline.registry import flows
from driftline.registry.base import Tables


def test_scores_and_moments_equal_the_prepared_columns(spark):
    """NULL, NaN, infinity, a constant and a whole-number column, in the tasks and as built-in expressions."""
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, 1.5, 2, 7.0), (0, None, 3, 7.0), (1, nan, 5, 7.0), (1, inf, None, 7.0), (1, 0.25, -4, None), (0, -2.0, 9, 7.0)], "y int, a double, b int, c double")
    names, stats, weights = ["a", "b", "c"], {"a": (0.3, 1.7), "b": (2.0, 0.9), "c": (7.0, 0.0)}, {"a": 2.0, "c": 0.5}
    model = lda.Projection(names, stats, weights, {"a": 0.4, "b": -1.1, "c": 3.0}, 0.2)
    z = lda.prepare(df, names, stats, {})
    want = z.select(sum((F.col(f) * F.lit(weights.get(f, 1.0) * model.coef[f]) for f in names), F.lit(-0.2)).alias("p"))
    assert [r.proj for r in model.score(df).collect()] == [r.p for r in want.collect()]
    got, plain = lda.class_moments(df, names, "y", lda.preparing(names, stats, weights)), lda.class_moments(lda.prepare(df, names, stats, weights), names, "y")
    for c in (0, 1):
        assert got[c].n == plain[c].n and np.array_equal(got[c].mean, plain[c].mean) and np.array_equal(got[c].cov, plain[c].cov)


def test_windows_are_scored_once(spark):
    """The search and whatever reads the distances take written scores."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x

    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3 == 0), float(rng.normal() + (i % 3 == 0)), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label int, a double, b double")
    fitted = D.fit_labelled_monitor(df, ["a", "b"], {}, 5, D.self_distance_threshold())
    d = fitted.distances(df.withColumn("a", counted("a")))
    assert d.count() == 300 and d.where(F.col("d_mean") < fitted.epsilon).count() > 0
    assert {"id", "label", "proj", "d_mean"} == set(d.columns) and seen.value == 300


def test_packed_features_fit_as_columns(spark):
    """Features in one array column: unknown values, a constant that has no exact binary form, tasks without rows."""
    rng, names = np.random.default_rng(5), ["a", "b", "c", "flat", "none"]
    rows = [(int(i % 3), float(rng.normal() + i % 3), None if i % 7 == 0 else float(rng.normal() * 1e4 + 1e6), float("nan") if i % 11 == 0 else float(rng.random()), 0.1, None)
            for i in range(500)]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double, flat double, none double").repartition(6)
    packed = moments.Packed("x", names)
    one = df.select("y", F.array(*names).alias("x"))
    got, want = moments.packed_stats(one, packed), scale.fit_stats(df, names)
    for f in names:
        assert got[f] == (pytest.approx(want[f][0], rel=1e-12, abs=1e-12), pytest.approx(want[f][1], rel=1e-10))
    assert got["flat"][1] == 0 and [f for f in names if got[f][1] > 0] == scale.varying(df, names)
    kept = ["c", "a", "b"]
    first, other = lda.fit_buckets(one, kept, "y", stats=got, packed=packed), lda.fit_buckets(df, kept, "y")
    assert [first.coef[f] for f in kept] == pytest.approx([other.coef[f] for f in kept], rel=1e-7)
    scores = [r.proj for r in first.score(one).collect()]
    assert sorted(scores) == pytest.approx(sorted(r.proj for r in other.score(df).collect()), rel=1e-6, abs=1e-7)
    assert first.score(one).columns == ["y", "x", "proj"] and first.written(one).columns == ["y", "proj"]
    assert moments.packed_stats(one.limit(0), packed) == {f: (0.0, 0.0) for f in names}


def test_life_windows_hold_one_vector_and_are_read_four_times(spark):
    """Deviations, class moments, fourth moments, scores; neither a pass nor a shuffle handles dozens of columns."""
    w, names = flows.life_windows(Tables(spark, "/root/testdata/sf0.001"))
    assert dict(w.dtypes)["features"] == "array<double>" and w.columns == ["l_suppkey", "win", "rul", "features"] and len(w.first().features) == len(names) == 44
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("long")
    def counted(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x

    some = w.withColumn("rul", counted(F.col("win")) * 0 + F.col("rul"))
    fitted = D.fit_life_monitor(some, names, flows.LIFE)
    count = w.count()
    assert fitted.train.count() == count and fitted.train.columns == ["l_suppkey", "win", "rul", "proj", "d_mean"]
    assert seen.value <= 4 * count
