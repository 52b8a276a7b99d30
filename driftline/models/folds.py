"""Fits per fold from additive class moments: one pass over the data, whatever the number of folds.

Every (fold, class) is reduced to its count, sums and products around common centres. A leave-one-out fit uses the total less
the fold's own moments, a fit on several data sets the sum of theirs; no fit reads the data again. Coefficients are the
two-class discriminant w = Sw⁻¹ (m₁ − m₀) of length one with the cut half way between the class means.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.models.moments import add_arrays, packed_sums

MOST_FEATURES = 40                    # up to here the d (d + 3) / 2 sums per fold and class are columns, beyond that packed slices


def fold_moments(df: DataFrame, fold: str, label: Column, features: Sequence[str], centre: Mapping[str, float] | None = None) -> DataFrame:
    """(fold, label, n, m): m holds the sums and products of the centred features. Rows with a missing value are left out."""
    whole = df.select(fold, label.cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=["label", *features])
    if centre is None:
        centre = whole.agg(*[F.avg(f).alias(f) for f in features]).first().asDict()
    x = [F.col(f) - F.lit(float(centre[f] or 0.0)) for f in features]
    middle = F.array(*[F.lit(float(centre[f] or 0.0)) for f in features])
    if len(features) > MOST_FEATURES:
        shifted = whole.select(fold, "label", *[v.alias(f) for v, f in zip(x, features)])
        slices = packed_sums(shifted, [fold, "label"], features)
        joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_s"))), lambda s: s["_s"]))
        return slices.groupBy(fold, "label").agg(F.max("_n").alias("n"), joined.alias("m")).withColumn("centre", middle)
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    out = whole.groupBy(fold, "label").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("m"))
    return out.withColumn("centre", middle)


def _solve(d: int):
    @F.pandas_udf("struct<w array<double>, cut double>")
    def solve(n0: pd.Series, m0: pd.Series, n1: pd.Series, m1: pd.Series, centre: pd.Series) -> pd.DataFrame:
        upper = np.triu_indices(d)
        ws, cuts = [], []
        for a, x, b, y, c in zip(n0, m0, n1, m1, centre):
            if x is None or y is None or not a > 0 or not b > 0:
                ws.append(None)
                cuts.append(None)
                continue
            within, means = np.zeros((d, d)), []
            for n, m in ((a, np.asarray(x)), (b, np.asarray(y))):
                mean, q = m[:d] / n, np.zeros((d, d))
                q[upper] = m[d:]
                within += q + np.triu(q, 1).T - n * np.outer(mean, mean)
                means.append(mean)
            w = np.linalg.lstsq(within / (a + b), means[1] - means[0], rcond=None)[0]
            size = np.linalg.norm(w)
            w = w / size if size > 0 else w
            ws.append(w.tolist())
            cuts.append(float(w @ ((means[0] + means[1]) / 2 + np.asarray(c))))
        return pd.DataFrame({"w": ws, "cut": cuts})
    return solve


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _total(df: DataFrame, by: Sequence[str], d: int, fold: str) -> DataFrame:
    size = d + d * (d + 1) // 2
    if d > MOST_FEATURES:
        whole = add_arrays(df.select(*by, fold, F.col("n").alias("_n"), F.col("m").alias("_s")), by, fold).withColumnsRenamed({"_n": "n", "_s": "m"})
        return whole.join(F.broadcast(df.select("centre").limit(1)))                  # one row: all rows share it
    return df.groupBy(*by).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("m", F.lit(i))) for i in range(size)]).alias("m"), F.first("centre").alias("centre"))


def _fits(sides: DataFrame, by: str, d: int) -> DataFrame:
    of = lambda c, k: F.max(F.when(F.col("label") == k, F.col(c)))
    wide = sides.groupBy(by).agg(of("n", 0).alias("n0"), of("m", 0).alias("m0"), of("n", 1).alias("n1"), of("m", 1).alias("m1"), F.max("centre").alias("centre"))
    return wide.select(by, _solve(d)("n0", "m0", "n1", "m1", "centre").alias("s")).select(by, "s.w", "s.cut")


def leave_one_out_fits(moments: DataFrame, fold: str, d: int) -> DataFrame:
    """(fold, w, cut) of the fit on all other folds; NULL where they hold one class only."""
    total = _total(moments, ["label"], d, fold).select(F.col("label"), F.col("n").alias("_tn"), F.col("m").alias("_tm"), F.col("centre").alias("_tc"))    # one row per class
    sides = moments.select(fold).distinct().crossJoin(F.broadcast(total)).alias("t").join(
        moments.alias("o"), F.col(f"t.{fold}").eqNullSafe(F.col(f"o.{fold}")) & (F.col("t.label") == F.col("o.label")), "left")
    less = F.when(F.col("o.n").isNull(), F.col("_tm")).otherwise(F.zip_with("_tm", "o.m", lambda x, y: x - y))
    return _fits(sides.select(F.col(f"t.{fold}").alias(fold), F.col("t.label").alias("label"), (F.col("_tn") - F.coalesce("o.n", F.lit(0))).alias("n"), less.alias("m"), F.col("_tc").alias("centre")), fold, d)


def own_fits(moments: DataFrame, fold: str, d: int) -> DataFrame:
    """(fold, w, cut) of the fit on each fold alone."""
    return _fits(moments, fold, d)


def group_fits(moments: DataFrame, fold: str, groups: Mapping[str, Sequence], d: int) -> DataFrame:
    """(fit, w, cut) of the fits on the folds that each group names."""
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("fit"), F.lit(f).alias("of")) for g, fs in groups.items() for f in fs]))
    chosen = moments.withColumn("p", pairs).where(F.col("p.of") == F.col(fold)).select(F.col("p.fit").alias("fit"), F.col(fold).alias("_of"), "label", "n", "m", "centre")
    return _fits(_total(chosen, ["fit", "label"], d, "_of"), "fit", d)


def fired(features: Sequence[str]) -> Column:
    """Whether a row joined with its fold's `w` and `cut` lies on the side of class 1."""
    terms = [F.get("w", F.lit(i)) * F.col(f).cast("double") for i, f in enumerate(features)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total > F.col("cut")
