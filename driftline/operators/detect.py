"""Alerts per window and per object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.ordering import ROWS_PER_TASK, framed, running


def fire(d: Column | str, eps: Column | float) -> Column:
    """Strictly below the threshold."""
    d = F.col(d) if isinstance(d, str) else d
    return F.coalesce(d < (eps if isinstance(eps, Column) else F.lit(eps)), F.lit(False))


def first_fire(df: DataFrame, key: Sequence[str], order: str, lead: str, fired: Column) -> DataFrame:
    """Earliest alert per object; `lead` is the time to the event there. Only positive leads count as detections."""
    at = F.when(fired, F.col(order))
    out = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(fired).alias("n_fired"),
        F.min(at).alias("first_fire"), F.min_by(lead, at).alias("lead"))
    return out.withColumn("detected", F.coalesce(F.col("lead") > 0, F.lit(False)))


def sustained_fire(df: DataFrame, key: Sequence[str], order: Sequence[str], lead: str, fired: Column, k: int = 3, *,
                   limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """First alert that completes `k` consecutive firing windows; the run restarts after every quiet window."""
    frames = framed(df.withColumn("_fire", fired.cast("int")), key, order, k - 1, limit=limit, rows=rows)
    run = frames.finish(frames.df.withColumn("_run", F.sum("_fire").over(frames.rows(-(k - 1), 0))))
    at = F.when(F.col("_run") == k, F.col("pos"))
    return run.groupBy(*key).agg(F.count(F.lit(1)).alias("n_windows"), F.min(at).alias("fire_pos"),
                                 F.min_by(lead, at).alias("lead"))


def runs(df: DataFrame, key: Sequence[str], order: Sequence[str], fired: Column, first: str, *,
         limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Longest run of alerts, share of alerts, and `first` value at the first alert."""
    flagged = df.withColumn("_fire", fired)
    island = running(flagged, key, order, {"_gap": ("sum", F.when(F.col("_fire"), 0).otherwise(1))},
                     limit=limit, rows=rows)
    per_run = island.groupBy(*key, "_gap").agg(
        F.count_if("_fire").alias("_len"), F.count(F.lit(1)).alias("_rows"),
        F.min(F.when(F.col("_fire"), F.col(first))).alias("_first"))
    out = per_run.groupBy(*key).agg(
        F.max("_len").alias("max_consecutive"), F.sum("_len").alias("_f"), F.sum("_rows").alias("n_windows"),
        F.min("_first").alias("first_excursion"))
    return out.withColumn("pct_below", F.lit(100.0) * F.col("_f") / F.col("n_windows")).drop("_f")


def sigma_crossing(df: DataFrame, key: Sequence[str], order: str, channels: Sequence[str],
                   stats: dict[str, tuple[float, float]], n_sigma: float) -> DataFrame:
    """First record where any channel leaves mean ± n·σ; `stats` holds (mean, sample σ) per channel."""
    far = [F.abs(F.col(c) - F.lit(stats[c][0])) / F.lit(max(stats[c][1], 1e-10)) for c in channels]
    worst = F.greatest(*far) if len(far) > 1 else far[0]
    return df.groupBy(*key).agg(F.min(F.when(worst > n_sigma, F.col(order))).alias("crossing"))


def intervention_window(df: DataFrame, total: str, alert: str, crossing: str) -> DataFrame:
    """Lead of both detectors (0 when silent) and the time won."""
    lead = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.col(total) - F.col(c))
    return df.withColumns({"alert_lead": lead(alert), "threshold_lead": lead(crossing),
                           "alert_fired": F.col(alert).isNotNull(), "threshold_fired": F.col(crossing).isNotNull()}
                          ).withColumn("recovered", F.col("alert_lead") - F.col("threshold_lead"))


def distance_profile(df: DataFrame, key: Sequence[str], order: str, d: str) -> DataFrame:
    """Final, smallest and mean distance per object."""
    return df.groupBy(*key).agg(F.max_by(d, order).alias("d_final"), F.min(d).alias("d_min"), F.avg(d).alias("d_avg"),
                                F.count(F.lit(1)).alias("n_windows"))


def ood_objects(df: DataFrame, key: Sequence[str], d: str, eps: float) -> DataFrame:
    """An object is out of distribution when any of its windows is."""
    out = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_windows"), F.max(d).alias("d_max"), F.avg(d).alias("d_avg"),
                               F.avg(F.when(F.col(d) > eps, 1.0).otherwise(0.0)).alias("share_ood"))
    return out.withColumn("is_ood", F.col("d_max") > eps)


def compare_lookbacks(short: DataFrame, long: DataFrame, key: Sequence[str], lead: str = "lead",
                      tolerance: float = 7.0) -> DataFrame:
    """Whether a longer history fires earlier, later, or within the tolerance."""
    a = short.select(*key, F.col(lead).alias("lead_short"))
    b = long.select(*key, F.col(lead).alias("lead_long"))
    both = a.join(b, list(key))
    verdict = (F.when(F.col("lead_short").isNull() | F.col("lead_long").isNull(), "undetected")
               .when(F.col("lead_long") > F.col("lead_short") + tolerance, "gained")
               .when(F.col("lead_short") > F.col("lead_long") + tolerance, "lost").otherwise("same"))
    return both.withColumn("verdict", verdict)
