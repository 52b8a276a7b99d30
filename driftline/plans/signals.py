"""Summaries of raw signals: vibration snapshots and battery discharge curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.spectral import BANDS, band_energies
from driftline.operators.ordering import ROWS_PER_TASK, framed


# ---- vibration ----------------------------------------------------------------

def vibration_summary(x: Column | str) -> dict[str, Column]:
    """RMS, peak, crest factor, excess kurtosis (population)."""
    x = F.col(x) if isinstance(x, str) else x
    rms, peak = F.sqrt(F.avg(x * x)), F.max(F.abs(x))
    return {"rms": rms, "peak": peak, "crest": peak / F.greatest(rms, F.lit(1e-12)), "kurtosis": F.kurtosis(x)}


def snapshot_features(df: DataFrame, key: Sequence[str], channels: tuple[str, str], order: str) -> DataFrame:
    """25 features per snapshot: 4 summaries and 8 band energies per channel, and their correlation.

    A snapshot has a fixed sample count, so its signal fits one array.
    """
    aggs: dict[str, Column] = {}
    for c in channels:
        aggs.update({f"{c}_{n}": v for n, v in vibration_summary(c).items()})
    a, b = channels
    scale = F.stddev_pop(a) * F.stddev_pop(b)
    aggs["cross_corr"] = F.coalesce(F.try_divide(F.covar_pop(a, b), scale), F.lit(0.0))
    signal = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), *[F.col(c) for c in channels]))).alias("_sig")
    out = df.groupBy(*key).agg(*[v.alias(n) for n, v in aggs.items()], signal)
    for c in channels:
        bands = band_energies(F.transform("_sig", lambda s: s[c]))
        out = out.withColumn(f"_b_{c}", bands)
    named = [F.col(f"_b_{c}")[i].alias(f"{c}_band{i + 1}") for c in channels for i in range(BANDS)]
    return out.select(*key, *aggs, *named)


# ---- battery ------------------------------------------------------------------

CURVE_FEATURES = ["v_mean", "v_std", "v_min", "v_max", "v_range", "v_end", "v_q25", "v_q50", "v_q75", "i_mean", "i_std",
                  "t_max", "t_rise", "t_mean", "energy", "duration", "v_curvature", "v_slope", "v_rate", "power"]


def quadratic_fit(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Least-squares c2·x² + c1·x + c0 as aggregates, by the closed 3×3 normal equations."""
    s0 = F.count(y).cast("double")
    s1, s2, s3, s4 = (F.sum(F.pow(x, F.lit(float(k)))) for k in (1, 2, 3, 4))
    t0, t1, t2 = F.sum(y), F.sum(x * y), F.sum(x * x * y)
    det = s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    c2 = t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0)
    c1 = s4 * (t1 * s0 - t0 * s1) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - s2 * t1)
    c0 = s4 * (s2 * t0 - s1 * t1) - s3 * (s3 * t0 - s2 * t1) + t2 * (s3 * s1 - s2 * s2)
    return F.try_divide(c2, det), F.try_divide(c1, det), F.try_divide(c0, det)


def discharge_features(df: DataFrame, key: Sequence[str], order: Sequence[str], *, v: str = "voltage", i: str = "current",
                       temp: str = "temperature", t: str = "time_s", limit: int = ROWS_PER_TASK,
                       rows: int | None = None) -> DataFrame:
    """20 curve features per discharge; discharges with fewer than 4 samples give zeros."""
    frames = framed(df, key, order, 1, limit=limit, rows=rows)
    base = frames.finish(frames.df.withColumn("_dt", F.col(t) - F.lag(t).over(frames.ordered)))
    base = base.withColumn("_x", F.when(F.col("n") > 1, F.col("pos") / (F.col("n") - 1)).otherwise(F.lit(0.0)))
    at = lambda c, p: F.max(F.when(F.col("pos") == p, F.col(c)))
    n = F.col("n")
    c2, c1, _ = quadratic_fit(F.col("_x"), F.col(v))
    v_range = F.max(v) - F.min(v)
    duration = at(t, n - 1) - at(t, F.lit(0))
    energy = F.coalesce(F.sum(F.abs(F.col(v) * F.col(i)) * F.col("_dt")), F.lit(0.0))
    per_second = F.greatest(duration, F.lit(1.0))
    values = [F.avg(v), F.stddev_pop(v), F.min(v), F.max(v), v_range, at(v, n - 1), at(v, F.floor(n / 4)),
              at(v, F.floor(n / 2)), at(v, F.floor(3 * n / 4)), F.avg(F.abs(F.col(i))), F.stddev_pop(i), F.max(temp),
              F.max(temp) - at(temp, F.lit(0)), F.avg(temp), energy, duration, c2, c1, v_range / per_second,
              energy / per_second]
    short = F.max("n") < 4
    return base.groupBy(*key).agg(*[F.when(short, F.lit(0.0)).otherwise(val).alias(name)
                                    for name, val in zip(CURVE_FEATURES, values)])
