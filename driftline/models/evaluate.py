"""Evaluation statistics over scored windows and detected objects."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.stats import f1_interval, f1_interval_from_recall, precision_recall_f1, wilson
from driftline.operators.knn import distance_on_line
from driftline.operators.ordering import ROWS_PER_TASK, average_ranks, layout_of, per_group, quantiles, running, same_key


def separation(df: DataFrame, d: str, precursor: Column, nominal: Column, *, guard: str = "add",
               limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Median distance of nominal over median distance of precursor windows."""
    side = F.when(precursor, "p").when(nominal, "n")
    data = df.withColumn("_side", side).where("_side IS NOT NULL")
    med = quantiles(data, d, {"_med": 0.5}, ["_side"], limit=limit, rows=rows)
    row = med.agg(F.max(F.when(F.col("_side") == "p", F.col("_med"))).alias("median_precursor"),
                  F.max(F.when(F.col("_side") == "n", F.col("_med"))).alias("median_nominal"))
    base = F.col("median_precursor")
    base = base + F.lit(1e-10) if guard == "add" else F.greatest(base, F.lit(1e-10))
    return row.withColumn("separation", F.col("median_nominal") / base)


def mann_whitney(df: DataFrame, d: str, first: Column, key: Sequence[str] = (), *, limit: int = ROWS_PER_TASK,
                 rows: int | None = None) -> DataFrame:
    """U of the rows where `first` holds against the others, pair counts and the tie term."""
    key = list(key)
    tally = df.groupBy(*key, d).agg(F.count_if(first).alias("_a"), F.count_if(~first).alias("_b"))
    cum = running(tally, key, [d], {"_below": ("sum", F.col("_b"))}, limit=limit, rows=rows)
    won = F.col("_a") * (F.col("_below") - F.col("_b") / F.lit(2.0))
    size = F.col("_a") + F.col("_b")
    return cum.groupBy(*key).agg(F.sum(won).alias("u"), F.sum("_a").alias("n1"), F.sum("_b").alias("n2"),
                                 F.sum((size * size * size - size).cast("double")).alias("ties"))


def guarded_corr(x: str, y: str) -> Column:
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), scale), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, key: Sequence[str] = (), *, min_rows: int = 3,
             limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Rank correlation per group, pairs with a missing side left out; degenerate groups give 0."""
    key = list(key)
    pairs = df.select(*key, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()
                                        & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    if layout_of(pairs, key, [x], limit, rows).sliced:
        # equal pairs are counted once before ranking
        once = pairs.groupBy(*key, x, y).agg(F.count(F.lit(1)).alias("_w"))
        ranked = once
        for c in (x, y):
            tally = pairs.groupBy(*key, c).agg(F.count(F.lit(1)).alias("_m"))
            cum = running(tally, key, [c], {"_cum": ("sum", F.col("_m"))}, limit=limit)
            rank = (F.col("_cum") - (F.col("_m") - 1) / F.lit(2.0)).alias(f"rank_{c}")
            ranked = same_key(ranked, cum.select(*key, c, rank), [*key, c])
        w, rx, ry = F.col("_w"), F.col(f"rank_{x}"), F.col(f"rank_{y}")
        # centred around the known mean rank
        sums = ranked.groupBy(*key).agg(
            F.sum(w).alias("n"), F.sum(w * rx * ry).alias("_xy"), F.sum(w * rx * rx).alias("_xx"),
            F.sum(w * ry * ry).alias("_yy"))
        m = F.col("n") * (F.col("n") + 1.0) * (F.col("n") + 1.0) / 4.0
        rho = F.try_divide(F.col("_xy") - m, F.sqrt((F.col("_xx") - m) * (F.col("_yy") - m)))
        out = sums.select(*key, F.coalesce(rho, F.lit(0.0)).alias("rho"), "n")
    else:
        ranked = average_ranks(pairs, key, [x, y], rows=0)
        out = ranked.groupBy(*key).agg(guarded_corr(f"rank_{x}", f"rank_{y}").alias("rho"),
                                       F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= min_rows) if min_rows > 3 else out.withColumn(
        "rho", F.when(F.col("n") < 3, 0.0).otherwise(F.col("rho")))


def summary_of(df: DataFrame, value: str, **kw) -> DataFrame:
    """Mean, median, share of positive values of a per-object statistic."""
    med = quantiles(df, value, {"median": 0.5}, **kw)
    agg = df.where(F.col(value).isNotNull()).agg(
        F.avg(value).alias("mean"), F.count_if(F.col(value) > 0).alias("n_positive"),
        F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("share_positive"), F.count(value).alias("n_objects"))
    return _beside(agg, med.select("median"))


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row results in one row."""
    return a.withColumn("_one", F.lit(1)).join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one").drop("_one")


def five_numbers(df: DataFrame, value: str, key: Sequence[str] = (), **kw) -> DataFrame:
    """Mean, median, extremes and quartiles (lead times)."""
    probs = {"median": 0.5, "p25": 0.25, "p75": 0.75}
    key = list(key)
    q = quantiles(df, value, probs, key, **kw)
    a = df.where(F.col(value).isNotNull()).groupBy(*key).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return a.join(q, key) if key else _beside(a, q)


def confusion(df: DataFrame, fired: Column, due: Column, key: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*key).agg(F.count_if(fired & due).alias("tp"), F.count_if(fired & ~due).alias("fp"),
                                F.count_if(~fired & due).alias("fn"), F.count_if(~fired & ~due).alias("tn"))


def with_rates(df: DataFrame, none_fired: float = 0.0) -> DataFrame:
    """Precision, recall, F1, specificity from confusion counts."""
    p, r, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"), none_fired)
    spec = F.coalesce(F.try_divide(F.col("tn").cast("double"), (F.col("tn") + F.col("fp")).cast("double")), F.lit(0.0))
    return df.withColumns({"precision": p, "recall": r, "f1": f1, "specificity": spec})


def with_intervals(df: DataFrame, form: str = "both") -> DataFrame:
    """Intervals of precision, recall and F1; `form` is "both" (F1 from both intervals) or "recall" (precision 1, fp = 0)."""
    if form not in ("both", "recall"):
        raise ValueError(form)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p_lo, p_hi = wilson(tp, tp + fp)
    r_lo, r_hi = wilson(tp, tp + fn)
    f_lo, f_hi = f1_interval(tp, fp, fn) if form == "both" else f1_interval_from_recall(tp, fn)
    return df.withColumns({"precision_lo": p_lo, "precision_hi": p_hi, "recall_lo": r_lo, "recall_hi": r_hi,
                           "f1_lo": f_lo, "f1_hi": f_hi})


def ablation(df: DataFrame, classes: Mapping[str, Sequence[str]], project: Callable[[Sequence[str]], Column],
             basin: Column, k: int = 5) -> DataFrame:
    """Relative change of the mean basin distance when one feature class is left out.

    `project(dropped)` is the projection with the weights of `dropped` set to 0.
    Query and basin are both re-projected.
    """
    def mean_distance(name: str, dropped: Sequence[str]) -> DataFrame:
        scored = df.select(basin.alias("_in"), project(dropped).alias("_p"))
        near = distance_on_line(scored, scored.where("_in"), "_p", k=k, kth=None)
        return near.agg(F.avg("d_mean").alias("mean_distance")).select(F.lit(name).alias("feature_class"), "mean_distance")

    base = mean_distance("none", []).first()["mean_distance"]
    out = None
    for name, dropped in classes.items():
        one = mean_distance(name, dropped)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("change", (F.col("mean_distance") - F.lit(base)) / (F.lit(base) + F.lit(1e-10)))


def two_sample_ks(df: DataFrame, features: Sequence[str], in_first: Column, *, limit: int = ROWS_PER_TASK,
                  rows: int | None = None) -> DataFrame:
    """Largest gap between the two samples' distribution functions, per feature."""
    long = (df.withColumn("_a", in_first)
            .unpivot(["_a"], [F.col(f).cast("double").alias(f) for f in features], "feature", "_v")
            .where("_v IS NOT NULL"))
    tally = long.groupBy("feature", "_v").agg(F.count_if("_a").alias("_x"), F.count_if(~F.col("_a")).alias("_y"))
    most = None if rows is None else rows * len(features)
    cum = running(tally, ["feature"], ["_v"], {"_cx": ("sum", F.col("_x")), "_cy": ("sum", F.col("_y"))},
                  limit=limit, rows=most)
    cum = per_group(cum, ["feature"], {"_nx": F.sum("_x"), "_ny": F.sum("_y")}, limit=limit, rows=most)
    gap = F.abs(F.col("_cx") / F.col("_nx") - F.col("_cy") / F.col("_ny"))
    return cum.groupBy("feature").agg(F.max(gap).alias("ks"))


def profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing count, smallest and largest value of each feature, in one pass."""
    one = df.agg(*[c for f in features for c in (
        F.count_if(F.col(f).isNull()).alias(f"{f}__missing"),
        F.min(F.col(f).cast("double")).alias(f"{f}__min"), F.max(F.col(f).cast("double")).alias(f"{f}__max"))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}__missing").alias("missing"),
                              F.col(f"{f}__min").alias("min"), F.col(f"{f}__max").alias("max")) for f in features])
    return one.select(F.inline(rows))


def log_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal steps of log10(value)."""
    b = F.width_bucket(F.log10(F.col(value)), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.where(F.col(value) > 0).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    b = F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
