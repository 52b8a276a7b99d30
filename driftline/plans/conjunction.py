"""Conjunction messages: one feature row per event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.catalog.features import CONJUNCTION_CONSISTENT, CONJUNCTION_FEATURES
from driftline.functions.scalar import is_valid, log10_magnitude
from driftline.models.evaluate import spearman
from driftline.models.lda import Projection
from driftline.operators.knn import distance_on_line
from driftline.operators.ordering import ROWS_PER_TASK, Layout, framed, layout_of, per_group, running
from driftline.operators.prefix_ranks import prefix_correlation
from driftline.operators.windows import fill_gaps
from driftline.session import materialise

HIGH_RISK = -5.0            # log10 probability of the screening threshold
EVENT_HORIZON_DAYS = 2.0
_MIN_STEP = 1e-8


def near_event(df: DataFrame, days: float = EVENT_HORIZON_DAYS, time: str = "time_to_tca") -> DataFrame:
    return df.where(F.col(time) <= days)


def excluded_events(df: DataFrame, key: str = "event_id", days: float = EVENT_HORIZON_DAYS) -> DataFrame:
    """Events without a single message inside the horizon."""
    return df.select(key).distinct().join(near_event(df, days).select(key).distinct(), key, "left_anti")


def final_values(df: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Values of the last record of each object."""
    place = F.struct(*order)
    return df.groupBy(key).agg(*[F.max_by(c, place).alias(c) for c in columns])


def step_rates(df: DataFrame, key: Sequence[str], order: Sequence[str], time: str, columns: Sequence[str], *,
               limit: int = ROWS_PER_TASK, rows: int | None = None, layout: Layout | None = None) -> DataFrame:
    """`rate_<x>`: change per time between neighbouring records; NULL where a side is unknown or time stands still.

    Also `gap`: time since the record before.
    """
    frames = framed(df, key, order, 1, limit=limit, rows=rows, layout=layout)
    w = frames.ordered
    out = frames.df.withColumn("gap", F.col(time) - F.lag(time).over(w))
    moved = F.abs(F.col("gap")) >= _MIN_STEP
    rates = {}
    for c in columns:
        now = F.when(is_valid(c), F.col(c))
        rates[f"rate_{c}"] = F.when(moved, (now - F.lag(now).over(w)) / F.col("gap"))
    return frames.finish(out.withColumns(rates))


def mean_rate(c: str) -> Column:
    return F.coalesce(F.avg(f"rate_{c}"), F.lit(0.0))


def last_rate(c: str) -> Column:
    r = F.col(f"rate_{c}")
    return F.coalesce(F.max_by(r, F.when(r.isNotNull(), F.col("pos"))), F.lit(0.0))


def late_early(c: str) -> Column:
    """Mean of the later half over the mean of the earlier half of an event; 1 when a half is empty."""
    early, late = F.col("pos") < F.floor(F.col("n") / 2), F.col("pos") >= F.floor(F.col("n") / 2)
    val = F.when(is_valid(c), F.col(c))
    first, second = F.avg(F.when(early, val)), F.avg(F.when(late, val))
    return F.coalesce(second / (F.abs(first) + F.lit(1e-10)), F.lit(1.0))


def mean_acceleration(rated: DataFrame, key: Sequence[str], time: str, column: str, name: str, *,
                      limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Mean change of the known rates per time, over neighbouring known rates; 0 when there are fewer than two."""
    kept = rated.where(F.col(f"rate_{column}").isNotNull()).select(
        *key, F.col("pos").alias("at"), F.col(time).alias("_t"), F.col(f"rate_{column}").alias("_r"))
    frames = framed(kept, key, ["at"], 1, limit=limit, rows=rows)
    w = frames.ordered
    step = F.col("_t") - F.lag("_t").over(w)
    acc = frames.finish(frames.df.withColumn("_step", step).withColumn("_dr", F.col("_r") - F.lag("_r").over(w)))
    acc = acc.withColumn("_a", F.when(F.abs("_step") >= _MIN_STEP, F.col("_dr") / F.col("_step")))
    found = acc.groupBy(*key).agg(F.avg("_a").alias(name))
    return rated.select(*key).distinct().join(found, list(key), "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def event_features(messages: DataFrame, *, key: str = "event_id", tie: Sequence[str] = (), labels: DataFrame | None = None,
                   days: float = EVENT_HORIZON_DAYS, limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """35 features per event, its label and whether it has a single message.

    Messages run towards the event: time is counted from the first one on.
    `labels(event_id, true_risk)` overrides the risk of the last message.
    """
    opts = {"limit": limit, "rows": rows}
    near = near_event(messages, days).withColumn("_order", -F.col("time_to_tca"))
    near = near.withColumns({"t_det": log10_magnitude("t_position_covariance_det"),
                             "c_det": log10_magnitude("c_position_covariance_det")})
    order = ["_order", *tie]
    layout = layout_of(near, [key], order, limit, rows)         # one look at the group sizes
    if not layout.sliced:
        opts["rows"] = limit
    near = fill_gaps(near, [key], order, "c_sigma_r", "c_sigma", layout=layout)
    moving = ["miss_distance", "mahalanobis_distance", "t_sigma_r", "c_sigma", "t_det", "c_det", "c_obs_used"]
    rated = step_rates(near, [key], order, "_order", moving, layout=layout)
    last = lambda c: F.max_by(c, "pos")
    t_rms, c_rms = last("t_weighted_rms"), last("c_weighted_rms")
    aggs = {
        "miss_dist_final": last("miss_distance"), "d_miss_dist_dt_mean": mean_rate("miss_distance"),
        "d_miss_dist_dt_last": last_rate("miss_distance"), "mahal_dist_final": last("mahalanobis_distance"),
        "d_mahal_dt_mean": mean_rate("mahalanobis_distance"), "rel_pos_r_final": last("relative_position_r"),
        "rel_pos_t_final": last("relative_position_t"), "rel_pos_n_final": last("relative_position_n"),
        "miss_dist_late_early_ratio": late_early("miss_distance"),
        "mahal_late_early_ratio": late_early("mahalanobis_distance"),
        "t_sigma_r_final": last("t_sigma_r"), "c_sigma_r_final": last("c_sigma"),
        "d_t_sigma_r_dt": mean_rate("t_sigma_r"), "d_c_sigma_r_dt": mean_rate("c_sigma"),
        "t_cov_det_final": last("t_det"), "c_cov_det_final": last("c_det"),
        "d_t_cov_det_dt": mean_rate("t_det"), "d_c_cov_det_dt": mean_rate("c_det"),
        "cov_det_ratio_tc": F.coalesce(last("t_det"), F.lit(0.0)) - F.coalesce(last("c_det"), F.lit(0.0)),
        "sigma_r_ratio_tc": last("t_sigma_r") / (F.coalesce(last("c_sigma"), F.lit(1.0)) + F.lit(1e-10)),
        "t_cov_late_early_ratio": late_early("t_det"), "c_cov_late_early_ratio": late_early("c_det"),
        "t_obs_used_final": last("t_obs_used"), "c_obs_used_final": last("c_obs_used"),
        "d_c_obs_used_dt": mean_rate("c_obs_used"), "c_weighted_rms_final": c_rms,
        "c_actual_od_span_final": last("c_actual_od_span"), "t_time_lastob_end_final": last("t_time_lastob_end"),
        "c_time_lastob_end_final": last("c_time_lastob_end"),
        "od_quality_ratio": F.when(t_rms != 0, t_rms).otherwise(F.lit(1e-10)) / (c_rms + F.lit(1e-10)),
        "inter_cdm_dt_mean": F.coalesce(F.avg("gap"), F.lit(0.0)),
        "inter_cdm_dt_std": F.coalesce(F.stddev_pop("gap"), F.lit(0.0)),
        "inter_cdm_dt_last": F.coalesce(last("gap"), F.lit(0.0)),
        "n_cdms": F.max("n").cast("double"),
        "_risk": last("risk"),
    }
    wide = rated.groupBy(key).agg(*[v.alias(k) for k, v in aggs.items()])
    coupled = spearman(near, "miss_distance", "c_det", [key], **opts).select(key, F.col("rho").alias("corr_miss_c_cov_det"))
    out = wide.join(coupled, key, "left").withColumn(
        "corr_miss_c_cov_det", F.coalesce("corr_miss_c_cov_det", F.lit(0.0)))
    final = F.col("_risk")
    if labels is not None:
        out = out.join(labels.select(key, "true_risk"), key, "left")
        final = F.coalesce("true_risk", "_risk")
    return out.select(key, *CONJUNCTION_FEATURES, F.when(final >= HIGH_RISK, 1).otherwise(0).alias("label"),
                      final.alias("final_risk"), F.when(F.col("n_cdms") < 2, 1).otherwise(0).alias("single_cdm"))


def _first_halves(df: DataFrame, key: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """`early_<x>`: the running value `x` at the last record of the earlier half of the prefix that ends here.

    The value at place j belongs to the prefixes that end at 2j + 1 and 2j + 2: rows are sent there, and stay within their object's shuffle."""
    pos = F.col("pos")
    places = F.array(F.struct(pos.alias("to"), F.lit(True).alias("own")), *[F.struct((2 * pos + k).alias("to"), F.lit(False).alias("own")) for k in (1, 2)])
    sent = df.withColumn("_at", F.explode(places)).where(F.col("_at.own") | (F.col("_at.to") < F.col("n")))
    w = Window.partitionBy(*key, F.col("_at.to"))
    out = sent.withColumns({f"early_{c}": F.max(F.when(~F.col("_at.own"), F.col(c))).over(w) for c in sums})
    return out.where("_at.own").drop("_at")


def prefix_features(messages: DataFrame, *, key: str = "event_id", tie: Sequence[str] = (), days: float = EVENT_HORIZON_DAYS, at_least: int = 5,
                    limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """The 15 consistent features of every growing prefix (2 to n messages) of the events with `at_least` messages.

    One row per message from the second on: key, step (messages in the prefix), n, time_to_tca of the last one, and the features as
    `event_features` has them for whole events. Rates, gaps and halves come from running sums, the rank correlation from
    `prefix_correlation`; no prefix is gathered.
    """
    near = near_event(messages, days).withColumn("_order", -F.col("time_to_tca"))
    near = near.withColumns({"t_det": log10_magnitude("t_position_covariance_det"), "c_det": log10_magnitude("c_position_covariance_det")})
    order = ["_order", *tie]
    layout = layout_of(near, [key], order, limit, rows)
    moving = ["miss_distance", "t_sigma_r", "t_det", "c_obs_used"]
    used = [key, *order, "time_to_tca", *moving, "c_det", "t_obs_used", "t_time_lastob_end"]
    rated = step_rates(near.select(*dict.fromkeys(used)), [key], order, "_order", moving, layout=layout).where(F.col("n") >= at_least)
    rated = per_group(rated, [key], {"_mean_gap": F.avg("gap")}, layout=layout)
    if layout.sliced:
        rated = materialise(rated)
    coupled = prefix_correlation(rated, [key], "pos", "miss_distance", "c_det", "_rho", rows=rows)
    coupled = coupled.withColumnsRenamed({key: "_event", "pos": "_pos"})
    rated = rated.join(coupled, F.col(key).eqNullSafe(F.col("_event")) & (F.col("pos") == F.col("_pos")), "left").drop("_event", "_pos")
    known, off = F.when(is_valid("t_det"), F.col("t_det")), F.col("gap") - F.col("_mean_gap")
    measures = {f"_{k}_{c}": ("sum", e) for c in moving for k, e in (("sum", F.col(f"rate_{c}")), ("n", F.col(f"rate_{c}").isNotNull().cast("int")))}
    measures |= {"_last_rate": ("last", F.col("rate_miss_distance")), "_last_rho": ("last", F.col("_rho")), "_det": ("sum", known), "_n_det": ("sum", known.isNotNull().cast("int")),
                 "_gap": ("sum", off), "_gap2": ("sum", off * off), "_n_gap": ("sum", F.col("gap").isNotNull().cast("int"))}
    run = running(rated, [key], order if not layout.sliced else ["pos"], measures, layout=layout)
    run = _first_halves(run.withColumn("_det", F.coalesce("_det", F.lit(0.0))), [key], ["_det", "_n_det"])
    mean = lambda c: F.coalesce(F.try_divide(F.col(f"_sum_{c}"), F.col(f"_n_{c}")), F.lit(0.0))
    early = F.try_divide(F.col("early__det"), F.col("early__n_det"))
    late = F.try_divide(F.col("_det") - F.col("early__det"), F.col("_n_det") - F.col("early__n_det"))
    shift = F.try_divide(F.col("_gap"), F.col("_n_gap"))
    zero = F.lit(0.0)
    features = {
        "d_miss_dist_dt_mean": mean("miss_distance"), "d_miss_dist_dt_last": F.coalesce("_last_rate", zero), "t_sigma_r_final": F.col("t_sigma_r"), "d_t_sigma_r_dt": mean("t_sigma_r"),
        "t_cov_det_final": F.col("t_det"), "d_t_cov_det_dt": mean("t_det"), "t_cov_late_early_ratio": F.coalesce(late / (F.abs(early) + F.lit(1e-10)), F.lit(1.0)),
        "t_obs_used_final": F.col("t_obs_used"), "d_c_obs_used_dt": mean("c_obs_used"), "t_time_lastob_end_final": F.col("t_time_lastob_end"),
        "inter_cdm_dt_mean": F.coalesce(F.col("_mean_gap") + shift, zero),
        "inter_cdm_dt_std": F.coalesce(F.sqrt(F.greatest(F.try_divide(F.col("_gap2"), F.col("_n_gap")) - shift * shift, zero)), zero),
        "inter_cdm_dt_last": F.coalesce("gap", zero), "n_cdms": (F.col("pos") + 1).cast("double"), "corr_miss_c_cov_det": F.coalesce("_last_rho", zero),
    }
    return run.where("pos >= 1").select(key, (F.col("pos") + 1).alias("step"), "n", "time_to_tca", *[features[c].alias(c) for c in CONJUNCTION_CONSISTENT])


def prefix_approach(prefixes: DataFrame, model: Projection, basin: DataFrame, *, key: str = "event_id", k: int = 5, digits: int | None = None, rows: int | None = None) -> DataFrame:
    """Rank correlation of the time left with the distance to the basin, over the prefixes of every event (three or more): positive where it is approached.

    The frozen model only transforms. `digits` rounds distances before they are ranked. The prefixes are written once: a projection
    names every feature several times, and the window plan below it would be planned with each."""
    near = distance_on_line(model.score(materialise(prefixes)), basin, "proj", k=k, kth=None)
    d = F.round("d_mean", digits) if digits is not None else F.col("d_mean")
    return spearman(near.select(key, "time_to_tca", d.alias("d")), "time_to_tca", "d", [key], rows=rows).where("n >= 3")
