"""Asteroid and satellite histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.catalog.features import ASTEROID_WEIGHTS, DECAY_CHANNELS
from driftline.functions.features import correlation, decay_vector, difference_stages, late_early, rate_stages, slope
from driftline.operators.windows import Span, window_features

_TINY = 1e-10           # added to the deviations of the asteroid vector

# fixed values: corpus filter, windows and labels
MAX_DISTANCE_AU, MAX_V_INF = 0.02, 15.0
ASTEROID_WINDOW, ASTEROID_STRIDE, WARNING_DAYS = 30, 7, 90.0
DECAY_WINDOW, DECAY_STRIDE_TRAIN, DECAY_STRIDE_EVAL, PRECURSOR_DAYS = 30, 5, 1, 30.0


def corpus_filter(df: DataFrame, first: str = "2000-01-01", last: str = "2024-01-01", *, dist: str = "dist_au",
                  date: str = "date", v_inf: str = "v_inf") -> DataFrame:
    return df.where((F.col(dist) <= MAX_DISTANCE_AU) & (F.col(v_inf) <= MAX_V_INF)
                    & (F.col(date) >= F.lit(first)) & (F.col(date) <= F.lit(last)))


def asteroid_columns(df: DataFrame) -> DataFrame:
    """Distance of the perihelion from 1 au, and time to perihelion."""
    return df.withColumns({"gap": F.abs(F.col("q") - 1.0), "to_tp": F.abs(F.col("tp") - F.col("jd"))})


ASTEROID_STAGES = difference_stages(["q", "a", "e", "gap"], second=False) + [difference_stages(["q"])[1]]


def asteroid_vector(s: Span) -> dict[str, Column]:
    """28 features of a window of orbital elements."""
    dev = lambda c, skip=0: s.agg(F.stddev_pop, c, skip=skip) + F.lit(_TINY)
    mean = lambda c, skip=0: s.agg(F.avg, c, skip=skip)
    values = {
        "q_mean": mean("q"), "q_std": dev("q"), "q_min": s.agg(F.min, "q"), "q_max": s.agg(F.max, "q"),
        "a_mean": mean("a"), "a_std": dev("a"), "e_mean": mean("e"), "e_std": dev("e"),
        "dq_mean": mean("d1_q", 1), "dq_std": dev("d1_q", 1), "da_mean": mean("d1_a", 1), "da_std": dev("d1_a", 1),
        "de_mean": mean("d1_e", 1), "de_std": dev("d1_e", 1), "gap_mean": mean("gap"), "gap_min": s.agg(F.min, "gap"),
        "dgap_mean": mean("d1_gap", 1), "dgap_std": dev("d1_gap", 1), "d2q_mean": mean("d2_q", 2),
        "d2q_std": dev("d2_q", 2), "corr_e_q": correlation(s, "e", "q"), "corr_a_q": correlation(s, "a", "q"),
        "q_slope": slope(s, "q"), "gap_ratio": late_early(s, "gap", absolute=False), "i_mean": mean("i"),
        "n_mean": mean("nm"), "tp_mean": mean("to_tp"), "tp_min": s.agg(F.min, "to_tp"),
    }
    return {f: values[f] for f in ASTEROID_WEIGHTS}


def asteroid_windows(elements: DataFrame, key: str = "designation", order: list[str] | None = None, *,
                     window: int = ASTEROID_WINDOW, stride: int = ASTEROID_STRIDE, last: list[str] | None = None,
                     **kw) -> DataFrame:
    """Window features of orbital elements; the mean motion column is `nm`."""
    return window_features(asteroid_columns(elements), [key], order or ["jd"], window, stride, asteroid_vector,
                           stages=ASTEROID_STAGES, last=last or ["jd"], **kw)


def decay_windows(records: DataFrame, key: str = "norad_id", order: list[str] | None = None, *, time: str = "epoch_days",
                  channels: list[str] | None = None, window: int = DECAY_WINDOW, stride: int = DECAY_STRIDE_TRAIN,
                  last: list[str] | None = None, **kw) -> DataFrame:
    """63 features per window; objects shorter than the window get one window over all their records."""
    channels = channels or DECAY_CHANNELS
    return window_features(records, [key], order or [time], window, stride, lambda s: decay_vector(s, channels),
                           stages=rate_stages(channels, time), last=last or [time], shrink=True, **kw)


def remaining(df: DataFrame, event_time: str, end_time: str, name: str = "rul") -> DataFrame:
    """Time from the window end to the event; windows after the event are dropped, objects without one keep NULL."""
    left = F.col(event_time) - F.col(end_time)
    return df.withColumn(name, left).where(F.col(name).isNull() | (F.col(name) >= 0))


def two_population_label(has_event: Column, rul: Column, precursor: float = PRECURSOR_DAYS) -> Column:
    """1 close to the event, −1 for other windows of objects with an event, 0 for objects without one."""
    return F.when(~has_event, 0).when(rul <= precursor, 1).otherwise(-1)


def tightened_basin(scored: DataFrame, label: Column, proj: str = "proj", sigmas: float = 1.0) -> DataFrame:
    """Precursor projections not more than `sigmas` deviations below their mean."""
    inside = scored.where(label)
    row = inside.agg(F.avg(proj).alias("m"), F.stddev_pop(proj).alias("s")).first()
    return inside if row["m"] is None else inside.where(F.col(proj) >= F.lit(row["m"] - sigmas * row["s"]))
