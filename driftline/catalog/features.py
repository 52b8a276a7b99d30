"""Which feature belongs to which class and channel, and the weights by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: turbofan channels without information, and channel groups
FLAT_SENSORS = ["sensor_1", "sensor_5", "sensor_6", "sensor_10", "sensor_16", "sensor_18", "sensor_19"]
TURBOFAN_GROUPS = {
    "high": ["sensor_8", "sensor_9", "sensor_13", "sensor_14"],
    "medium_high": ["sensor_7", "sensor_11", "sensor_12", "sensor_15"],
    "medium": ["sensor_2", "sensor_3", "sensor_4", "sensor_17"],
    "low": ["sensor_20", "sensor_21"],
}
FLIGHT_GROUPS = {
    "high": ["Nf", "Nc"],
    "medium_high": ["Wf", "P21", "P24", "Ps30", "P40"],
    "medium": ["T24", "T30", "T48", "T50", "P50"],
    "low": ["P2", "P15"],
}
GROUP_WEIGHTS = {"high": 2.0, "medium_high": 1.5, "medium": 1.0, "low": 0.7}
CLASS_WEIGHTS = {"time_domain": 1.0, "rate": 1.5, "frequency": 1.3, "covariance": 1.2}

TURBOFAN_SENSORS = [s for s in (f"sensor_{i}" for i in range(1, 22)) if s not in FLAT_SENSORS]

# fixed values: asteroid window features with the weights meant for them
ASTEROID_WEIGHTS = {
    "q_mean": 0.5, "q_std": 0.5, "q_min": 0.5, "q_max": 0.5,
    "a_mean": 0.3, "a_std": 0.3, "e_mean": 0.3, "e_std": 0.3,
    "dq_mean": 3.0, "dq_std": 3.0, "da_mean": 2.0, "da_std": 2.0, "de_mean": 2.0, "de_std": 2.0,
    "gap_mean": 3.0, "gap_min": 3.0, "dgap_mean": 3.0, "dgap_std": 3.0,
    "d2q_mean": 2.0, "d2q_std": 2.0, "corr_e_q": 2.0, "corr_a_q": 2.0,
    "q_slope": 3.0, "gap_ratio": 4.0, "i_mean": 0.2, "n_mean": 1.0, "tp_mean": 2.0, "tp_min": 2.0,
}
# fixed values: the same features with the weights the published numbers used (by position)
ASTEROID_WEIGHTS_BY_POSITION = {
    "q_mean": 0.5, "q_std": 0.5, "q_min": 0.5, "q_max": 0.5,
    "a_mean": 0.3, "a_std": 0.3, "e_mean": 0.3, "e_std": 0.3,
    "dq_mean": 3.0, "dq_std": 3.0, "da_mean": 1.0, "da_std": 1.0, "de_mean": 2.0, "de_std": 2.0,
    "gap_mean": 2.0, "gap_min": 2.0, "dgap_mean": 3.0, "dgap_std": 3.0,
    "d2q_mean": 3.0, "d2q_std": 3.0, "corr_e_q": 2.0, "corr_a_q": 2.0,
    "q_slope": 2.0, "gap_ratio": 2.0, "i_mean": 3.0, "n_mean": 4.0, "tp_mean": 0.2, "tp_min": 1.0,
}

# fixed values: reentry channels, channel weights and class multipliers
DECAY_CHANNELS = ["periapsis", "mean_motion", "mean_motion_dot", "bstar", "eccentricity", "apoapsis"]
DECAY_CHANNEL_WEIGHTS = {"periapsis": 2.0, "mean_motion": 1.5, "mean_motion_dot": 3.0, "bstar": 1.5,
                         "eccentricity": 0.8, "apoapsis": 1.0}
DECAY_CLASS_WEIGHTS = {"time_domain": 1.0, "rate": 2.0, "ratio": 2.5, "cross": 1.2}

# fixed values: conjunction event features with the weights of the full model
CONJUNCTION_WEIGHTS = {
    "miss_dist_final": 1.0, "d_miss_dist_dt_mean": 2.5, "d_miss_dist_dt_last": 2.5, "mahal_dist_final": 1.5,
    "d_mahal_dt_mean": 3.0, "rel_pos_r_final": 0.8, "rel_pos_t_final": 0.8, "rel_pos_n_final": 0.8,
    "miss_dist_late_early_ratio": 2.0, "mahal_late_early_ratio": 2.5,
    "t_sigma_r_final": 1.0, "c_sigma_r_final": 1.0, "d_t_sigma_r_dt": 2.0, "d_c_sigma_r_dt": 2.0,
    "t_cov_det_final": 1.0, "c_cov_det_final": 1.0, "d_t_cov_det_dt": 2.5, "d_c_cov_det_dt": 2.5,
    "cov_det_ratio_tc": 1.5, "sigma_r_ratio_tc": 1.5, "t_cov_late_early_ratio": 2.0, "c_cov_late_early_ratio": 2.0,
    "t_obs_used_final": 1.0, "c_obs_used_final": 1.5, "d_c_obs_used_dt": 1.5, "c_weighted_rms_final": 1.5,
    "c_actual_od_span_final": 1.0, "t_time_lastob_end_final": 1.0, "c_time_lastob_end_final": 1.5,
    "od_quality_ratio": 1.2,
    "inter_cdm_dt_mean": 1.5, "inter_cdm_dt_std": 1.0, "inter_cdm_dt_last": 1.5, "n_cdms": 0.5,
    "corr_miss_c_cov_det": 1.5,
}
CONJUNCTION_FEATURES = list(CONJUNCTION_WEIGHTS)
# fixed values: the features whose distribution agrees between both sources
CONJUNCTION_CONSISTENT = [
    "d_miss_dist_dt_mean", "d_miss_dist_dt_last", "t_sigma_r_final", "d_t_sigma_r_dt", "t_cov_det_final",
    "d_t_cov_det_dt", "t_cov_late_early_ratio", "t_obs_used_final", "d_c_obs_used_dt", "t_time_lastob_end_final",
    "inter_cdm_dt_mean", "inter_cdm_dt_std", "inter_cdm_dt_last", "n_cdms", "corr_miss_c_cov_det",
]


def monitoring_catalogue(channels: Sequence[str], bins: int = 5, eigenvalues: int = 5) -> list[tuple[str, str, str | None]]:
    """(feature, class, channel) of the monitoring vector; cross-channel features have no channel."""
    rows: list[tuple[str, str, str | None]] = []
    for cls, names in (("time_domain", ("mean", "std", "min", "max")), ("rate", ("d1_mean", "d1_std", "d2_mean")),
                       ("frequency", tuple(f"fft{k}" for k in range(1, bins + 1)))):
        rows += [(f"{c}_{n}", cls, c) for c in channels for n in names]
    rows += [(f"corr_{a}_{b}", "covariance", None) for a, b in combinations(channels, 2)]
    rows += [(f"eig{i}", "covariance", None) for i in range(1, eigenvalues + 1)]
    return rows


def decay_catalogue(channels: Sequence[str] = DECAY_CHANNELS) -> list[tuple[str, str, str | None]]:
    rows: list[tuple[str, str, str | None]] = []
    for cls, names in (("time_domain", ("mean", "std", "min", "max")), ("rate", ("r1_mean", "r1_std", "r2_mean")),
                       ("ratio", ("ratio",))):
        rows += [(f"{c}_{n}", cls, c) for c in channels for n in names]
    return rows + [(f"corr_{a}_{b}", "cross", None) for a, b in combinations(channels, 2)]


def catalogue_table(spark: SparkSession, rows: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "feature string, class string, channel string")


def weight_table(catalogue: DataFrame, channel_weights: Mapping[str, float], class_weights: Mapping[str, float],
                 cross: float) -> DataFrame:
    """weight = channel weight (`cross` where there is no channel) × class multiplier."""
    spark = catalogue.sparkSession
    chan = spark.createDataFrame(list(channel_weights.items()), "channel string, _cw double")
    cls = spark.createDataFrame(list(class_weights.items()), "class string, _kw double")
    out = catalogue.join(F.broadcast(chan), "channel", "left").join(F.broadcast(cls), "class", "left")
    base = F.when(F.col("channel").isNull(), F.lit(cross)).otherwise(F.coalesce("_cw", F.lit(1.0)))
    return out.select("feature", "class", "channel", (base * F.coalesce("_kw", F.lit(1.0))).alias("weight"))


def group_weights(groups: Mapping[str, Sequence[str]], values: Mapping[str, float] = GROUP_WEIGHTS) -> dict[str, float]:
    return {c: values[g] for g, members in groups.items() for c in members}


def decay_weights() -> dict[str, float]:
    """Reentry weights by name: channel weight × class multiplier, cross features 1.2."""
    out = {}
    for f, cls, c in decay_catalogue():
        out[f] = (DECAY_CHANNEL_WEIGHTS[c] if c else 1.0) * DECAY_CLASS_WEIGHTS[cls]
    return out
