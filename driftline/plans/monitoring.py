"""The standard monitoring flow: window features, label, standardise, weigh, project, measure, calibrate, detect."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import features as Ft
from driftline.models import calibrate
from driftline.models.lda import Projection, fit_two_class
from driftline.models.scale import fit_stats
from driftline.operators import detect
from driftline.operators.knn import distance_on_line
from driftline.operators.ordering import ROWS_PER_TASK
from driftline.operators.windows import Span, window_features
from driftline.plans.orbits import remaining
from driftline.session import materialise


@dataclass(frozen=True)
class Flow:
    """What changes between domains: keys, channels, window, horizon, neighbours."""

    key: str
    order: tuple[str, ...]
    time: str
    channels: tuple[str, ...]
    width: int = 30
    stride: int = 7
    warning: float = 7.0
    k: int = 5
    limit: int = ROWS_PER_TASK
    rows: int | None = None

    def vector(self, s: Span) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c in self.channels:
            out.update(Ft.time_domain(s, c))
            out.update(Ft.rate(s, c))
            out[f"{c}_slope"] = Ft.slope(s, c)
            out[f"{c}_ratio"] = Ft.late_early(s, c)
        return out

    def windows(self, df: DataFrame) -> DataFrame:
        """Features, remaining time to the object's last record, and the precursor label."""
        ends = df.groupBy(self.key).agg(F.max(self.time).alias("event_time"))
        feats = window_features(df, [self.key], list(self.order), self.width, self.stride, self.vector,
                                stages=Ft.difference_stages(self.channels), last=[self.time],
                                limit=self.limit, rows=self.rows)
        out = remaining(feats.join(ends, self.key), "event_time", self.time).drop("event_time")
        return out.withColumn("label", F.when(F.col("rul") <= self.warning, 1).otherwise(0))

    @property
    def features(self) -> list[str]:
        names = ("mean", "std", "min", "max", "d1_mean", "d1_std", "d2_mean", "slope", "ratio")
        return [f"{c}_{n}" for c in self.channels for n in names]


def frozen(df: DataFrame, coef: Mapping[str, float], weights: Mapping[str, float] | None = None) -> Projection:
    """A projection with given coefficients; only mean and deviation come from the training windows."""
    return Projection(list(coef), fit_stats(df, list(coef)), dict(weights or {}), dict(coef))


def measure(windows: DataFrame, model: Projection, basin: Column, k: int, *, corpus: bool = False, **kw) -> DataFrame:
    """Projection and distance to the basin; with `corpus` also the k-th distance to all windows."""
    scored = model.score(windows)
    near = distance_on_line(scored, scored.where(basin), "proj", k=k, kth=None, **kw)
    if corpus:
        near = distance_on_line(near, scored, "proj", k=k, mean=None, kth="d_corpus", **kw)
    return near


@dataclass
class Monitor:
    """A fitted monitor: projection, basin, threshold."""

    flow: Flow
    model: Projection
    basin: DataFrame
    epsilon: float

    def distances(self, windows: DataFrame) -> DataFrame:
        return distance_on_line(self.model.score(windows), self.basin, "proj", k=self.flow.k, kth=None)

    def detections(self, windows: DataFrame) -> DataFrame:
        d = self.distances(windows)
        return detect.first_fire(d, [self.flow.key], "win", "rul", detect.fire("d_mean", self.epsilon))


def fit_monitor(df: DataFrame, flow: Flow, *, coef: Mapping[str, float] | None = None,
                weights: Mapping[str, float] | None = None, p: float = 0.05) -> tuple[Monitor, DataFrame]:
    """Fit on training histories; the threshold is the p-quantile of the nominal distances.

    The window table is written to the shared folder once: standardising, basin,
    calibration and scoring all read it.
    """
    windows = materialise(flow.windows(df))
    model = frozen(windows, coef, weights) if coef else fit_two_class(windows, flow.features, "label", weights)
    scored = model.score(windows)
    basin = scored.where("label = 1").select("proj")
    monitor = Monitor(flow, model, basin, 0.0)
    near = monitor.distances(windows)
    eps = calibrate.quantile_threshold(near.where("label = 0"), "d_mean", p, limit=flow.limit, rows=flow.rows)
    return replace(monitor, epsilon=eps), near
