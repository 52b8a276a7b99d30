"""Cross-validated studies of batteries, bearings and flights: windows over per-cycle summaries, fits per fold, held-out reports.

A study reads its windows twice, whatever the number of folds: once for the class moments of every fold, once to apply to each
window the fit that has not seen it. `windows` should be a written table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.models import evaluate, folds
from driftline.operators.ordering import with_position
from driftline.plans import domains as D, flights, signals
from driftline.session import materialise


def with_remaining(cycles: DataFrame, key: Sequence[str], order: Sequence[str], clip: float, **kw) -> DataFrame:
    """`rul`: the cycles an object has left after each, its last one has none."""
    placed = with_position(cycles, list(key), list(order), **kw)
    return placed.withColumn("rul", F.least((F.col("n") - 1 - F.col("pos")).cast("double"), F.lit(clip))).drop("pos", "n")


# ---- windows of the three kinds of histories ------------------------------------

def battery_windows(points: DataFrame, key: str, cycle: str, order: Sequence[str], capacity: Column, *, setting: D.Setting = D.BATTERY,
                    v: str = "voltage", i: str = "current", temp: str = "temperature", t: str = "time_s", **kw) -> tuple[DataFrame, list[str]]:
    """Discharge points to windows: 20 curve features per cycle, their means, deviations and steps, and the capacity's trend."""
    curves = signals.discharge_features(points, [key, cycle], order, v=v, i=i, temp=temp, t=t, **kw)
    fade = points.groupBy(key, cycle).agg(capacity.alias("capacity"))
    cycles = with_remaining(curves.join(fade, [key, cycle]), [key], [cycle], setting.clip, **kw)
    return D.second_level_windows(cycles, [key], [cycle], signals.CURVE_FEATURES, setting, capacity="capacity", **kw)


def bearing_windows(samples: DataFrame, key: str, snapshot: str, channels: tuple[str, str], order: str, *,
                    setting: D.Setting = D.BEARING, **kw) -> tuple[DataFrame, list[str]]:
    """Vibration samples to windows: 25 features per snapshot, their means, deviations and steps."""
    rows = signals.snapshot_features(samples, [key, snapshot], channels, order)
    columns = [c for c in rows.columns if c not in (key, snapshot)]
    return D.second_level_windows(with_remaining(rows, [key], [snapshot], setting.clip, **kw), [key], [snapshot], columns, setting, **kw)


def flight_windows(samples: DataFrame, key: str, flight: str, order: Sequence[str], channels: Sequence[str], *, setting: D.Setting,
                   cruise: dict | None = None, **kw) -> tuple[DataFrame, list[str]]:
    """Flight samples to windows: cruise means per flight, their means, deviations and steps over flights."""
    marked = flights.cruise_mask(samples, [key, flight], order, **(cruise or {}), **kw)
    cycles = flights.per_cycle(marked, [key, flight], order[0], channels, [])
    return D.second_level_windows(with_remaining(cycles, [key], [flight], setting.clip, **kw), [key], [flight], channels, setting, **kw)


# ---- fits and reports -------------------------------------------------------------

def fit_folds(windows: DataFrame, fold: str, features: Sequence[str], due: Column) -> DataFrame:
    """Class moments of every fold as a written table; all fits come from it."""
    return materialise(folds.fold_moments(windows, fold, due.cast("int"), features))


def apply_held_out(windows: DataFrame, moments: DataFrame, fold: str, features: Sequence[str]) -> DataFrame:
    """`fired` of each window by the fit on all other folds. Windows whose fit has one class only are left out."""
    fits = folds.leave_one_out_fits(moments, fold, len(features)).select(F.col(fold).alias("_fold"), "w", "cut")
    held = windows.join(fits, F.col(fold).eqNullSafe(F.col("_fold"))).withColumn("fired", folds.fired(features))
    return held.where("fired IS NOT NULL").drop("_fold", "w", "cut")


def object_report(held: DataFrame, key: Sequence[str], due: Column, rul: str = "rul") -> DataFrame:
    """Per object: confusion counts of its windows, whether it was detected in time, and the life left at the first such alert."""
    hit = F.col("fired") & due
    return held.groupBy(*key).agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("fired") & ~due).alias("fp"), F.count_if(~F.col("fired") & due).alias("fn"),
        F.count_if(~F.col("fired") & ~due).alias("tn"), F.max(F.when(hit, F.col(rul))).alias("first_detection_rul"),
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("detected"))


def pooled(report: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Counts over the objects of a report, with rates."""
    sums = report.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], F.count_if("detected").alias("n_detected"), F.count(F.lit(1)).alias("n_objects"))
    return evaluate.with_rates(sums)


def cross_dataset(dev: DataFrame, test: DataFrame, dataset: str, features: Sequence[str], due: Column) -> DataFrame:
    """Counts on each data set's test windows by two fits: on its own development windows, and on those of all other sets."""
    moments, d = fit_folds(dev, dataset, features, due), len(features)
    own = folds.own_fits(moments, dataset, d).withColumn("fit", F.lit("own"))
    others = folds.leave_one_out_fits(moments, dataset, d).withColumn("fit", F.lit("others"))
    fits = own.unionByName(others).select(F.col(dataset).alias("_set"), "w", "cut", "fit")
    both = test.join(fits, F.col(dataset).eqNullSafe(F.col("_set")))
    return evaluate.with_rates(evaluate.confusion(both, folds.fired(features), due, ["fit", dataset]))
