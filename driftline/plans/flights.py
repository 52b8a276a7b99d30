"""Per-second flight samples to per-cycle records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.ordering import ROWS_PER_TASK, framed, layout_of, per_group

# fixed values
TRA_WINDOW = 50
TRA_STD_MAX = 5.0
ALTITUDE_MIN = 10_000.0
MIN_SAMPLES = 100


def cruise_mask(df: DataFrame, key: Sequence[str], order: Sequence[str], *, altitude: str = "alt", throttle: str = "tra",
                window: int = TRA_WINDOW, std_max: float = TRA_STD_MAX, alt_min: float = ALTITUDE_MIN,
                least: int = MIN_SAMPLES, limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Mark cruise samples: steady throttle and high altitude, with two fallbacks.

    The throttle deviation trails over `window` samples; the first `window`
    samples take the first full value after them. Flights of at most `window`
    samples use their overall deviation. With fewer than `least` samples left,
    altitude alone decides, then the whole flight is kept.
    """
    layout = layout_of(df, key, order, limit, rows)             # one look at the group sizes
    frames = framed(df, key, order, window - 1, layout=layout)
    rolled = frames.df.withColumn("_roll", F.stddev_pop(throttle).over(frames.rows(-(window - 1), 0)))
    rolled = frames.finish(rolled)
    head = F.max(F.when(F.col("pos") == window, F.col("_roll")))
    rolled = per_group(rolled, key, {"_head": head, "_all": F.stddev_pop(throttle)}, layout=layout)
    spread = (F.when(F.col("n") <= window, F.col("_all")).when(F.col("pos") < window, F.col("_head"))
              .otherwise(F.col("_roll")))
    marked = rolled.withColumn("_high", F.col(altitude) > alt_min)
    marked = marked.withColumn("_steady", (spread < std_max) & F.col("_high"))
    marked = per_group(marked, key, {"_n_steady": F.count_if("_steady"), "_n_high": F.count_if("_high")}, layout=layout)
    mask = (F.when(F.col("_n_steady") >= least, F.col("_steady")).when(F.col("_n_high") >= least, F.col("_high"))
            .otherwise(F.lit(True)))
    return marked.withColumn("cruise", mask).drop("_roll", "_head", "_all", "_high", "_steady", "_n_steady", "_n_high")


def per_cycle(df: DataFrame, key: Sequence[str], order: str, channels: Sequence[str], constants: Sequence[str]) -> DataFrame:
    """Cruise means per flight; constant columns take their first value."""
    return df.groupBy(*key).agg(*[F.avg(F.when(F.col("cruise"), F.col(c))).alias(c) for c in channels],
                                *[F.min_by(c, order).alias(c) for c in constants])
