"""Alert thresholds from distances. Thresholds come back as plain numbers or small tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.stats import precision_recall_f1
from driftline.operators.ordering import quantiles


def quantile_threshold(df: DataFrame, d: str, p: float, **kw) -> float:
    """The p-quantile of the distances (operational class, basin self-distances, corpus distances)."""
    return quantiles(df, d, {"q": p}, **kw).first()["q"]


def threshold_counts(df: DataFrame, d: str, due: Column, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts of `d < eps` at each threshold.

    Rows are counted once by the threshold interval they fall into; the counts
    of all thresholds are running totals over that small table.
    """
    spark = df.sparkSession
    edges = sorted({float(t) for t in thresholds})
    splits = [-math.inf, *edges, math.inf]
    data = df.select(F.col(d).cast("double").alias("_d"), due.alias("_due")).where("_d IS NOT NULL AND NOT isnan(_d)")
    placed = Bucketizer(splits=splits, inputCol="_d", outputCol="_b").transform(data)
    # bucket b holds edges[b-1] <= d < edges[b]: it fires from edge b on
    counts = placed.groupBy(F.col("_b").cast("int").alias("_b")).agg(
        F.count_if("_due").alias("_pos"), F.count_if(~F.col("_due")).alias("_neg"))
    grid = spark.createDataFrame([(i, e) for i, e in enumerate(edges)] + [(len(edges), None)], "_b int, eps double")
    upto, every = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("_b").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    full = grid.join(F.broadcast(counts), "_b", "left").na.fill(0, ["_pos", "_neg"])
    full = full.withColumns({"tp": F.sum("_pos").over(upto), "fp": F.sum("_neg").over(upto),
                             "_p": F.sum("_pos").over(every), "_n": F.sum("_neg").over(every)})
    full = full.where("eps IS NOT NULL").select(
        "eps", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"))
    wanted = spark.createDataFrame(list(enumerate(float(t) for t in thresholds)), "idx int, eps double")
    return wanted.join(F.broadcast(full), "eps").select("idx", "eps", "tp", "fp", "fn", "tn")


def best_row(scored: DataFrame) -> DataFrame:
    """Largest F1, the first threshold winning ties."""
    return scored.orderBy(F.desc("f1"), "idx").limit(1)


def percentile_grid(n: int = 40, low: float = 5.0, high: float = 95.0) -> list[float]:
    return [(low + (high - low) * i / (n - 1)) / 100.0 for i in range(n)]


def f1_percentile_sweep(df: DataFrame, d: str, due: Column, **kw) -> DataFrame:
    """F1 at 40 percentiles (5 to 95) of the distances."""
    probs = {f"p{i}": p for i, p in enumerate(percentile_grid())}
    row = quantiles(df, d, probs, **kw).first()
    scored = threshold_counts(df, d, due, [row[p] for p in probs])
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p = tp / F.greatest(F.lit(1.0), tp + fp)
    r = tp / F.greatest(F.lit(1.0), tp + fn)
    return scored.withColumns({"precision": p, "recall": r, "f1": 2 * p * r / F.greatest(F.lit(1e-10), p + r)})


def precision_recall_sweep(df: DataFrame, d: str, due: Column, n: int = 200) -> DataFrame:
    """F1 on an even grid from half the smallest to 1.1 times the largest distance; precision is 1 when nothing fires."""
    ends = df.agg(F.min(d).alias("a"), F.max(d).alias("b")).first()
    low, high = ends["a"] * 0.5, ends["b"] * 1.1
    step = (high - low) / (n - 1)
    scored = threshold_counts(df, d, due, [low + step * i for i in range(n - 1)] + [high])
    p, r, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"), none_fired=1.0)
    return scored.withColumns({"precision": p, "recall": r, "f1": f1})


def approach_zone(df: DataFrame, d: str, rul: str, basin: float, recall: float = 0.9, margin: float = 20.0,
                  **kw) -> DataFrame:
    """Order statistic of the distances just outside the basin; of the basin when that zone is empty."""
    r = F.col(rul)
    zone = F.when((r > basin) & (r <= basin + margin), "approach").when(r <= basin, "basin")
    q = quantiles(df.withColumn("_zone", zone).where("_zone IS NOT NULL"), d, {"_q": recall}, ["_zone"],
                  discrete=True, **kw)
    pick = lambda z: F.max(F.when(F.col("_zone") == z, F.col("_q")))
    return q.agg(F.coalesce(pick("approach"), pick("basin")).alias("eps"))


def conformal(df: DataFrame, d: str, alpha: float, *, side: str = "upper", **kw) -> DataFrame:
    """Conformal quantile of nominal distances with finite-sample correction.

    `upper` is the (1 − α)(n + 1)/n quantile with the bound α + 1/(n + 1). An
    alert fires *below* its threshold, so the rate it limits is the one of
    `lower`, the largest order statistic with at most α(n + 1) values under it.
    """
    known = df.where(F.col(d).isNotNull())
    n = known.count()
    if side == "upper":
        q = quantiles(known, d, {"eps": min(1.0, (1.0 - alpha) * (n + 1) / n)}, **kw)
        return q.select("eps", F.lit(alpha + 1.0 / (n + 1)).alias("bound"))
    rank = math.floor(alpha * (n + 1))
    if rank < 1:
        return known.sparkSession.createDataFrame([(None, 0.0)], "eps double, bound double")
    q = quantiles(known, d, {"eps": (rank - 0.5) / n}, discrete=True, **kw)
    return q.select("eps", F.lit(rank / (n + 1)).alias("bound"))


def calibration_curve(calibration: DataFrame, test: DataFrame, d: str, failure: Column,
                      alphas: Sequence[float] = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20), **kw) -> DataFrame:
    """Confusion and rates of the test distances at each conformal threshold."""
    known = calibration.where(F.col(d).isNotNull())
    n = known.count()
    probs = {f"a{i}": min(1.0, (1.0 - a) * (n + 1) / n) for i, a in enumerate(alphas)}
    row = quantiles(known, d, probs, **kw).first()
    scored = threshold_counts(test, d, failure, [row[c] for c in probs])
    targets = calibration.sparkSession.createDataFrame(
        [(i, float(a), a + 1.0 / (n + 1)) for i, a in enumerate(alphas)], "idx int, target double, bound double")
    p, r, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    fpr = F.coalesce(F.try_divide(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double")), F.lit(0.0))
    return scored.join(F.broadcast(targets), "idx").withColumns(
        {"precision": p, "recall": r, "f1": f1, "actual_fpr": fpr})


def midpoint(df: DataFrame, d: str, due: Column) -> DataFrame:
    """Half way between the farthest positive and the nearest negative object."""
    top, low = F.max(F.when(due, F.col(d))), F.min(F.when(~due, F.col(d)))
    return df.agg(((top + low) / 2.0).alias("eps"), top.alias("max_positive"), low.alias("min_negative"))


def data_thresholds(df: DataFrame, rul: str, **kw) -> DataFrame:
    """Clip at the 95th percentile, basin and warning at 20 % and 40 % of it (half-even rounding)."""
    q = quantiles(df, rul, {"_q": 0.95}, **kw)
    clip = F.floor("_q").cast("int")
    return q.select(clip.alias("clip"), F.bround(clip * F.lit(0.2), 0).cast("int").alias("basin"),
                    F.bround(clip * F.lit(0.4), 0).cast("int").alias("warning"))
