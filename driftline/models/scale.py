"""Standardising: globally, per operating regime, and after windowing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import materialise

Stats = dict[str, tuple[float, float]]


def fit_stats(df: DataFrame, columns: Sequence[str], *, sample: bool = False) -> Stats:
    """Mean and deviation (population unless `sample`) per column, NULLs and NaN left out, in one pass."""
    dev = F.stddev_samp if sample else F.stddev_pop
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    row = df.agg(*[x for c in columns for x in (F.avg(clean[c]).alias(f"m_{c}"), dev(clean[c]).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in columns}


def zscore(column: Column | str, mean: float, std: float) -> Column:
    """(x − mean) / std; a constant column is only centred."""
    c = F.col(column) if isinstance(column, str) else column
    return (c - F.lit(float(mean))) / F.lit(float(std) if std else 1.0)


def scale(df: DataFrame, stats: Stats, suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": zscore(c, m, s) for c, (m, s) in stats.items()})


def weighted_score(df: DataFrame, stats: Stats, weights: Mapping[str, float], out: str = "score") -> DataFrame:
    """`out`: the sum of the standardised features of `stats`, each times its weight by name; a missing feature adds nothing."""
    units = [(float(m), float(s) if s else 1.0, float(weights[c])) for c, (m, s) in stats.items()]
    if not units:
        return df.withColumn(out, F.lit(0.0))

    @F.pandas_udf("double")
    def total(*columns: pd.Series) -> pd.Series:
        # as arrays: one built-in expression of dozens of features is too long a method for the JVM to compile
        found = np.zeros(len(columns[0]))
        for c, (mean, std, weight) in zip(columns, units):
            z = (c.to_numpy(dtype=float, na_value=np.nan) - mean) / std
            found += weight * np.where(np.isnan(z), 0.0, z)
        return pd.Series(found)

    return df.withColumn(out, total(*[F.col(c).cast("double") for c in stats]))


def varying(df: DataFrame, columns: Sequence[str], threshold: float = 1e-8) -> list[str]:
    """Columns that still vary after standardising (constant ones are left out)."""
    stats = fit_stats(df, columns)
    scaled = fit_stats(scale(df.select(*columns), stats), columns)
    return [c for c in columns if scaled[c][1] > threshold]


# ---- operating regimes --------------------------------------------------------

def fit_regimes(df: DataFrame, settings: Sequence[str], k: int = 6, seed: int = 42, digits: int | None = 3) -> KMeansModel:
    """k-means on the operating settings (rounded so that set points coincide)."""
    return KMeans(k=k, seed=seed, featuresCol="_settings", predictionCol="regime", maxIter=50).fit(
        _settings(df, settings, digits))


def _settings(df: DataFrame, settings: Sequence[str], digits: int | None) -> DataFrame:
    tmp = df.withColumns({f"_s_{c}": (F.round(F.col(c), digits) if digits is not None else F.col(c)) for c in settings})
    out = VectorAssembler(inputCols=[f"_s_{c}" for c in settings], outputCol="_settings").transform(tmp)
    return out.drop(*[f"_s_{c}" for c in settings])


def assign_regimes(df: DataFrame, model: KMeansModel, settings: Sequence[str], digits: int | None = 3) -> DataFrame:
    return model.transform(_settings(df, settings, digits)).drop("_settings")


def regime_stats(train: DataFrame, regime: str, columns: Sequence[str], pad: float = 0.0) -> DataFrame:
    """Mean and deviation per regime: one row per regime (a handful)."""
    return train.groupBy(regime).agg(*[x for c in columns for x in (
        F.avg(c).alias(f"m_{c}"), (F.stddev_pop(c) + F.lit(pad)).alias(f"s_{c}"))])


def scale_by_regime(df: DataFrame, stats: DataFrame, regime: str, columns: Sequence[str]) -> DataFrame:
    """Standardise with the regime's training statistics; rows of an unseen regime stay as they are."""
    joined = df.join(stats, regime, "left")
    out = {}
    for c in columns:
        s = F.when(F.col(f"s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"s_{c}"))
        out[c] = F.when(F.col(f"m_{c}").isNull(), F.col(c)).otherwise((F.col(c) - F.col(f"m_{c}")) / s)
    return joined.withColumns(out).drop(*[f"{p}_{c}" for c in columns for p in "ms"])


# how each window feature reacts to x -> (x − m) / s
_SHIFTED = ("mean", "min", "max")
_SCALED = ("std", "d1_mean", "d1_std", "d2_mean", "slope")


def rescale_windows(windows: DataFrame, channels: Sequence[str], mean: str = "m_{}", std: str = "s_{}") -> DataFrame:
    """Standardise finished window features by the window's own mean/std columns.

    The features are affine in the channel, so a window of mixed regimes can be
    standardised by its dominant regime after aggregation.
    """
    known = set(windows.columns)
    out = {}
    for c in channels:
        m, s = F.col(mean.format(c)), F.col(std.format(c))
        for f in _SHIFTED:
            if f"{c}_{f}" in known:
                out[f"{c}_{f}"] = (F.col(f"{c}_{f}") - m) / s
        for f in [*_SCALED, *[f"fft{i}" for i in range(1, 33)]]:
            if f"{c}_{f}" in known:
                out[f"{c}_{f}"] = F.col(f"{c}_{f}") / s
        for b in channels:
            if f"cov_{c}_{b}" in known:
                out[f"cov_{c}_{b}"] = F.col(f"cov_{c}_{b}") / (s * F.col(std.format(b)))
        left = [n for n in known if n.startswith(f"{c}_") and n not in out and n not in (mean.format(c), std.format(c))]
        if left:
            raise ValueError(f"features that cannot be standardised after aggregation: {sorted(left)}")
    return windows.withColumns(out)


def dominant_regime_scaled(windows: DataFrame, stats: DataFrame, regime: str, channels: Sequence[str],
                           own_pad: float = 1e-10) -> DataFrame:
    """Apply the dominant regime's statistics; windows of an unseen regime use their own mean and deviation."""
    joined = windows.join(stats, regime, "left")
    fixed = {}
    for c in channels:
        fixed[f"m_{c}"] = F.coalesce(F.col(f"m_{c}"), F.col(f"{c}_mean"))
        fixed[f"s_{c}"] = F.coalesce(F.col(f"s_{c}"), F.col(f"{c}_std") + F.lit(own_pad))
    return rescale_windows(joined.withColumns(fixed), channels).drop(*[f"{p}_{c}" for c in channels for p in "ms"])


# ---- set points -----------------------------------------------------------------

def _nearest(settings: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """(distance², index) of the nearest centre, the first of equals."""
    def distance(c: Sequence[float]) -> Column:
        total = F.lit(0.0)
        for name, v in zip(settings, c):
            total = total + (F.col(name) - F.lit(float(v))) * (F.col(name) - F.lit(float(v)))
        return total
    return F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))


def fit_set_points(df: DataFrame, settings: Sequence[str], k: int = 6, digits: int = 3, rounds: int = 50, tolerance: float = 1e-9) -> list[tuple[float, ...]]:
    """At most `k` set points of the operating settings, in ascending order: Lloyd's iterations on distinct rounded settings, by weight.

    The start is fixed: the smallest setting, then always the one farthest from all before it. Rows with a missing setting
    take no part. A round is one aggregate; only its `k` sums reach the driver.
    """
    rounded = df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) for c in settings]).dropna()
    points = materialise(rounded.groupBy(*settings).agg(F.count(F.lit(1)).cast("double").alias("_w")))
    here = F.struct(*settings)
    first = points.agg(F.min(here)).first()[0]
    centres = [] if first is None else [tuple(first)]
    while centres and len(centres) < k:
        far = points.agg(F.max(F.struct(_nearest(settings, centres)["d"].alias("d"), here.alias("p")))).first()[0]
        if not far["d"] > 0:
            break
        centres.append(tuple(far["p"]))
    for _ in range(rounds if centres else 0):
        means = [(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c) for c in settings]
        moved = {row["_i"]: tuple(row[c] for c in settings) for row in points.groupBy(_nearest(settings, centres)["i"].alias("_i")).agg(*means).collect()}
        new = [moved.get(i, c) for i, c in enumerate(centres)]
        still = all(abs(a - b) <= tolerance for x, y in zip(new, centres) for a, b in zip(x, y))
        centres = new
        if still:
            break
    return sorted(centres)


def assign_set_points(df: DataFrame, centres: Sequence[Sequence[float]], settings: Sequence[str], digits: int = 3, out: str = "regime") -> DataFrame:
    """`out`: the number of the nearest set point in their order; NULL where a setting is missing or NaN."""
    rounded = [f"_s_{c}" for c in settings]
    placed = df.withColumns({s: F.round(F.col(c).cast("double"), digits) for s, c in zip(rounded, settings)})
    known = F.lit(bool(centres))
    for s in rounded:
        known = known & F.col(s).isNotNull() & ~F.isnan(s)
    return placed.withColumn(out, F.when(known, _nearest(rounded, centres)["i"]) if centres else F.lit(None).cast("int")).drop(*rounded)
