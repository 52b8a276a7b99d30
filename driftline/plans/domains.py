"""The seven monitored domains as short compositions: only loading, features and labels differ."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.catalog import features as C
from driftline.functions import features as Ft
from driftline.functions.scalar import width_bucket_clipped
from driftline.functions.spectral import top_eigenvalues
from driftline.models import calibrate, evaluate
from driftline.models.lda import Projection, fit_buckets, fit_two_class
from driftline.models.moments import Packed, packed_stats
from driftline.operators import detect
from driftline.operators.knn import distance_on_line
from driftline.operators.ordering import ROWS_PER_TASK, layout_of, with_position
from driftline.operators.window_arrays import window_vectors
from driftline.operators.windows import window_features
from driftline.plans.orbits import tightened_basin
from driftline.session import materialise


@dataclass(frozen=True)
class Setting:
    """Window, remaining-life and neighbour parameters of a domain."""

    window: int
    stride: int
    k: int
    clip: float = 0.0
    basin: float = 0.0
    warning: float = 0.0
    buckets: int = 6


# fixed values
TURBOFAN = Setting(30, 1, 5, 125.0, 25.0, 50.0)
BATTERY = Setting(15, 1, 5, 100.0, 15.0, 30.0)
BEARING = Setting(20, 1, 3, 275.0, 30.0, 30.0)
ASTEROID = Setting(30, 7, 5, warning=90.0)
REENTRY = Setting(30, 5, 5, warning=30.0)


def monitoring_windows(df: DataFrame, key: Sequence[str], order: Sequence[str], channels: Sequence[str], setting: Setting,
                       last: Sequence[str] = ("rul",), **kw) -> tuple[DataFrame, list[str]]:
    """The full monitoring vector per window, with the covariance eigenvalues, and its feature names."""
    out = window_features(df, key, order, setting.window, setting.stride, lambda s: Ft.monitoring_vector(s, channels),
                          stages=Ft.difference_stages(channels), last=last, **kw)
    cells = [f"cov_{a}_{b}" for i, a in enumerate(channels) for b in channels[i:]]
    out = out.withColumn("_eig", top_eigenvalues(cells, len(channels))).drop(*cells)
    names = [f for f, _, _ in C.monitoring_catalogue(channels)]
    eig = [F.col("_eig")[i].alias(f"eig{i + 1}") for i in range(5)]
    return out.select("*", *eig).drop("_eig"), names


def monitoring_vectors(df: DataFrame, key: Sequence[str], order: Sequence[str], channels: Sequence[str], setting: Setting,
                       last: Mapping[str, Column], *, limit: int = ROWS_PER_TASK, rows: int | None = None,
                       out: str = "features") -> tuple[DataFrame, list[str]]:
    """`monitoring_windows` with the features in one array column, unknown ones NaN. `last` may use `pos` and `n`."""
    layout = layout_of(df, key, order, limit, rows)
    base = with_position(df, key, order, layout=layout).withColumns(dict(last))
    if layout.sliced:
        windows, names = monitoring_windows(base.drop("pos", "n"), key, order, channels, setting, list(last), limit=limit, rows=rows)
        values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(math.nan)) for f in names])
        return windows.select(*key, "win", *last, values.alias(out)), names
    names = [f for f, _, _ in C.monitoring_catalogue(channels)]
    return window_vectors(base, key, list(last), channels, setting.window, setting.stride, Ft.monitoring_matrix(channels, setting.window), out), names


def second_level_windows(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], setting: Setting,
                         last: Sequence[str] = ("rul",), capacity: str | None = None, **kw) -> tuple[DataFrame, list[str]]:
    """Windows over per-cycle or per-snapshot features; with `capacity` also its trend."""
    def vector(s):
        out = Ft.second_level(s, columns)
        if capacity:
            out.update({"cap_slope": Ft.slope(s, capacity), "cap_mean": s.agg(F.avg, capacity),
                        "cap_std": s.agg(F.stddev_pop, capacity), "cap_min": s.agg(F.min, capacity),
                        "cap_last": Ft.last_value(s, capacity)})
        return out
    names = [f"{c}_{x}" for x in ("mean", "std", "step") for c in columns]
    names += [f"cap_{x}" for x in ("slope", "mean", "std", "min", "last")] if capacity else []
    return window_features(df, key, order, setting.window, setting.stride, vector,
                           stages=Ft.difference_stages(columns, second=False), last=last, **kw), names


@dataclass
class Fitted:
    """A fitted domain model and its training distances; tables of distances leave the features out."""

    model: Projection
    basin: DataFrame
    epsilon: float
    k: int
    train: DataFrame

    def distances(self, windows: DataFrame) -> DataFrame:
        return self.near(self.model.written(windows))

    def near(self, scored: DataFrame) -> DataFrame:
        """`distances` of windows that `model.written` has scored."""
        return distance_on_line(scored, self.basin, "proj", k=self.k, kth=None)


def _fitted(windows: DataFrame, model: Projection, basin: Callable[[DataFrame], DataFrame], k: int,
            threshold: Callable[[DataFrame], float]) -> Fitted:
    scored = model.written(windows)
    ref = basin(scored).select("proj")
    near = materialise(distance_on_line(scored, ref, "proj", k=k, kth=None))
    return Fitted(model, ref, threshold(near), k, near)


def fit_life_monitor(windows: DataFrame, features: Sequence[str], setting: Setting, rul: str = "rul", column: str = "features", **kw) -> Fitted:
    """Turbofan, battery and bearing: life buckets, shrunk discriminant, basin of low remaining life.

    `windows` holds the features in the array `column` (`monitoring_vectors`); it is read several times and should be
    a written table. Constant features are left out. The threshold is the approach-zone order statistic.
    """
    clipped = windows.withColumn("_bucket", width_bucket_clipped(F.least(F.col(rul), F.lit(setting.clip)), setting.clip, setting.buckets))
    packed = Packed(column, list(features))
    stats = packed_stats(clipped, packed)
    kept = [f for f in features if 0 < stats[f][1] < math.inf]
    model = fit_buckets(clipped, kept, "_bucket", stats=stats, packed=packed)
    return _fitted(clipped.drop("_bucket"), model, lambda s: s.where(F.col(rul) <= setting.basin), setting.k,
                   lambda near: calibrate.approach_zone(near, "d_mean", rul, setting.basin, **kw).first()["eps"])


def fit_labelled_monitor(windows: DataFrame, features: Sequence[str], weights: Mapping[str, float], k: int,
                         threshold: Callable[[DataFrame], float], *, label: str = "label", tightened: bool = False) -> Fitted:
    """Asteroids, reentry and conjunctions: two-class discriminant on weighted features, basin of label 1.

    Windows with another label (−1: ambiguous) take no part in the fit.
    """
    used = windows.where(F.col(label).isin(0, 1))
    model = fit_two_class(used, list(features), label, weights)
    inside = F.col(label) == 1
    basin = (lambda s: tightened_basin(s, inside)) if tightened else (lambda s: s.where(inside))
    return _fitted(used, model, basin, k, threshold)


def best_f1_threshold(label: str = "label", **kw) -> Callable[[DataFrame], float]:
    """Asteroids: the percentile with the best training F1."""
    return lambda near: calibrate.best_row(calibrate.f1_percentile_sweep(near, "d_mean", F.col(label) == 1, **kw)).first()["eps"]


def operational_threshold(label: str = "label", p: float = 0.05, **kw) -> Callable[[DataFrame], float]:
    """Reentry: the 5th percentile of the operational distances."""
    return lambda near: calibrate.quantile_threshold(near.where(F.col(label) == 0), "d_mean", p, **kw)


def self_distance_threshold(k: int = 5, label: str = "label", p: float = 0.95, **kw) -> Callable[[DataFrame], float]:
    """Conjunctions: the 95th percentile of the basin's distances to itself, each point left out of its own."""
    def pick(near: DataFrame) -> float:
        basin = near.where(F.col(label) == 1).select("proj")
        own = distance_on_line(basin, basin, "proj", k=k, exclude_self=True, kth=None)
        return calibrate.quantile_threshold(own, "d_mean", p, **kw)
    return pick


def life_report(fitted: Fitted, setting: Setting, margin: float, rul: str = "rul", **kw) -> DataFrame:
    """Separation and rank correlation of the training distances, in one row."""
    sep = evaluate.separation(fitted.train, "d_mean", F.col(rul) <= setting.basin, F.col(rul) > setting.basin + margin,
                              guard="max", **kw)
    rho = evaluate.spearman(fitted.train, "d_mean", rul, **kw)
    return evaluate._beside(sep, rho).withColumn("epsilon", F.lit(fitted.epsilon))


def held_out_sweep(fitted: Fitted, test: DataFrame, key: str, order: str, truth: DataFrame, warning: float) -> DataFrame:
    """Final distance per test object of the scored windows `test`, joined with the true remaining life, swept over thresholds; the best row."""
    final = detect.distance_profile(fitted.near(test), [key], order, "d_mean").select(key, "d_final")
    joined = materialise(final.join(truth, key))
    return calibrate.best_row(calibrate.precision_recall_sweep(joined, "d_final", F.col("true_rul") <= warning))


def validate_sustained(fitted: Fitted, windows: DataFrame, key: str, order: Sequence[str], lead: str, has_event: Column,
                       k: int = 3, **kw) -> DataFrame:
    """Reentry study: objects with `k` alerts in a row against objects with an event."""
    d = fitted.distances(windows)
    alerts = detect.sustained_fire(d, [key], order, lead, detect.fire("d_mean", fitted.epsilon), k, **kw)
    events = d.groupBy(key).agg(F.max(has_event).alias("has_event"))
    return evaluate.confusion(alerts.join(events, key), F.col("fire_pos").isNotNull(), F.col("has_event"))
