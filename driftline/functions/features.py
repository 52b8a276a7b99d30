"""Window features as named columns. Deviations are population deviations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from driftline.functions.spectral import eigenvalues
from driftline.operators.windows import Span, Stage


# ---- row-level helper columns -------------------------------------------------

def _lag(c: str):
    return lambda w: F.col(c) - F.lag(c).over(w)


def difference_stages(channels: Sequence[str], second: bool = True) -> list[Stage]:
    """d1_<x>, then d2_<x>: differences between neighbouring records."""
    first = {f"d1_{c}": _lag(c) for c in channels}
    if not second:
        return [first]
    return [first, {f"d2_{c}": _lag(f"d1_{c}") for c in channels}]


def rate_stages(channels: Sequence[str], time: str, floor: float = 1e-6) -> list[Stage]:
    """Differences per unit of time; steps shorter than `floor` count as `floor`.

    The second rate divides by the step before, not by the current one.
    """
    def step(w: WindowSpec) -> Column:
        return F.greatest(F.col(time) - F.lag(time).over(w), F.lit(floor))

    def rate(c):
        return lambda w: (F.col(c) - F.lag(c).over(w)) / F.col("_dt")

    def second(c):
        return lambda w: (F.col(f"r1_{c}") - F.lag(f"r1_{c}").over(w)) / F.lag("_dt").over(w)

    return [{"_dt": step}, {f"r1_{c}": rate(c) for c in channels}, {f"r2_{c}": second(c) for c in channels}]


# ---- window features ----------------------------------------------------------

def time_domain(s: Span, c: str) -> dict[str, Column]:
    return {f"{c}_mean": s.agg(F.avg, c), f"{c}_std": s.agg(F.stddev_pop, c),
            f"{c}_min": s.agg(F.min, c), f"{c}_max": s.agg(F.max, c)}


def rate(s: Span, c: str, prefix: str = "d") -> dict[str, Column]:
    """Mean and deviation of the first rate, mean of the second (`d` per record, `r` per time)."""
    one, two = f"{prefix}1", f"{prefix}2"
    return {f"{c}_{one}_mean": s.agg(F.avg, f"{one}_{c}", skip=1),
            f"{c}_{one}_std": s.agg(F.stddev_pop, f"{one}_{c}", skip=1),
            f"{c}_{two}_mean": F.coalesce(s.agg(F.avg, f"{two}_{c}", skip=2), F.lit(0.0))}


def spectrum(s: Span, c: str, bins: int = 5) -> dict[str, Column]:
    """Magnitudes of the lowest Fourier bins (without the constant one), zero beyond the half width."""
    out = {}
    for k in range(1, bins + 1):
        out[f"{c}_fft{k}"] = F.when(F.lit(k) <= F.floor(s.size / 2), s.fourier(c, k)).otherwise(F.lit(0.0))
    return out


def correlation(s: Span, a: str, b: str) -> Column:
    """Pearson correlation; 0 where a channel is constant."""
    scale = s.agg(F.stddev_pop, a) * s.agg(F.stddev_pop, b)
    return F.coalesce(F.try_divide(s.agg(F.covar_pop, a, b), scale), F.lit(0.0))


def correlations(s: Span, channels: Sequence[str]) -> dict[str, Column]:
    return {f"corr_{a}_{b}": correlation(s, a, b) for a, b in combinations(channels, 2)}


def covariances(s: Span, channels: Sequence[str]) -> dict[str, Column]:
    """Sample covariance matrix, row by row, upper triangle with diagonal."""
    out = {}
    for i, a in enumerate(channels):
        for b in channels[i:]:
            out[f"cov_{a}_{b}"] = s.agg(F.covar_samp, a, b)
    return out


def slope(s: Span, c: str) -> Column:
    """Least-squares slope per record."""
    return s.agg(F.regr_slope, F.col(c), F.col("pos").cast("double"))


def late_early(s: Span, c: str, *, absolute: bool = True, default: float | None = None) -> Column:
    """Mean of the second half over the mean of the first half."""
    early, late = s.agg(F.avg, c, half="early"), s.agg(F.avg, c, half="late")
    ratio = late / ((F.abs(early) if absolute else early) + F.lit(1e-10))
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def last_value(s: Span, c: str) -> Column:
    return s.agg(F.max_by, F.col(c), F.col("pos"))


# ---- composite vectors --------------------------------------------------------

def monitoring_vector(s: Span, channels: Sequence[str], bins: int = 5) -> dict[str, Column]:
    """Time domain, rate, frequency and cross-channel structure of every channel.

    The covariance columns `cov_*` feed `functions.spectral.top_eigenvalues`.
    """
    out: dict[str, Column] = {}
    for part in (time_domain, rate):
        for c in channels:
            out.update(part(s, c))
    for c in channels:
        out.update(spectrum(s, c, bins))
    out.update(correlations(s, channels))
    out.update(covariances(s, channels))
    return out


def monitoring_matrix(channels: Sequence[str], width: int, bins: int = 5, top: int = 5) -> Callable[[Callable], np.ndarray]:
    """`monitoring_vector`, with the eigenvalues in place of the covariances, as a matrix for `window_vectors`: columns as in the catalogue, unknown ones NaN."""
    def of(value: Callable) -> np.ndarray:
        def known(kind: str, *names: str, skip: int = 0, default: float = np.nan) -> np.ndarray:
            found, null = value(kind, names, skip, "")
            return np.where(null, default, found)

        out = [known(kind, c) for c in channels for kind in ("avg", "std", "min", "max")]
        for c in channels:
            out += [known("avg", f"d1_{c}", skip=1), known("std", f"d1_{c}", skip=1), known("avg", f"d2_{c}", skip=2, default=0.0)]
        for c in channels:
            out += [known(f"fft{k}", c) if k <= width // 2 else np.zeros(len(out[0])) for k in range(1, bins + 1)]
        for a, b in combinations(channels, 2):
            (cov, none), (one, _), (two, _) = (value(*what, 0, "") for what in (("cov", (a, b)), ("std", (a,)), ("std", (b,))))
            out.append(np.where(none | (one * two == 0), 0.0, cov / (one * two)))
        cells = [known("cov1", a, b, default=0.0) for i, a in enumerate(channels) for b in channels[i:]]
        return np.column_stack([*out, eigenvalues(np.column_stack(cells), len(channels), top)])
    return of


def decay_vector(s: Span, channels: Sequence[str]) -> dict[str, Column]:
    """Time domain, time-normalised rate, late/early ratio, cross-channel correlation."""
    out: dict[str, Column] = {}
    for c in channels:
        out.update(time_domain(s, c))
    for c in channels:
        out.update(rate(s, c, "r"))
    for c in channels:
        out[f"{c}_ratio"] = late_early(s, c)
    out.update(correlations(s, channels))
    return out


def second_level(s: Span, columns: Sequence[str]) -> dict[str, Column]:
    """Mean, deviation and mean step of features that are themselves per-record summaries."""
    out: dict[str, Column] = {f"{c}_mean": s.agg(F.avg, c) for c in columns}
    out.update({f"{c}_std": s.agg(F.stddev_pop, c) for c in columns})
    out.update({f"{c}_step": s.agg(F.avg, f"d1_{c}", skip=1) for c in columns})
    return out
