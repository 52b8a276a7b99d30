"""Proportions, intervals and p-values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a proportion, clamped to [0, 1]; (0, 0) when there are no trials."""
    s, m = successes.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p = s / m
    z2 = z * z
    scale = 1 + F.lit(z2) / m
    centre = (p + F.lit(z2) / (2 * m)) / scale
    spread = F.lit(z) * F.sqrt(p * (1 - p) / m + F.lit(z2) / (4 * m * m)) / scale
    low = F.coalesce(F.greatest(F.lit(0.0), centre - spread), F.lit(0.0))
    high = F.when(m.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(1.0), centre + spread))
    return low, high


def precision_recall_f1(tp: Column, fp: Column, fn: Column, none_fired: float = 0.0) -> tuple[Column, Column, Column]:
    """`none_fired` is the precision when nothing fired."""
    p = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(none_fired))
    r = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return p, r, f1


def f1_interval(tp: Column, fp: Column, fn: Column, z: float = Z95) -> tuple[Column, Column]:
    """F1 at both ends of the precision and recall intervals."""
    p_lo, p_hi = wilson(tp, tp + fp, z)
    r_lo, r_hi = wilson(tp, tp + fn, z)

    def harmonic(p: Column, r: Column) -> Column:
        return F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(F.lit(0.0))

    return harmonic(p_lo, r_lo), harmonic(p_hi, r_hi)


def f1_interval_from_recall(tp: Column, fn: Column, z: float = Z95) -> tuple[Column, Column]:
    """F1 at both ends of the recall interval with precision 1: the form for evaluations that can have no false alarm."""
    low, high = wilson(tp, tp + fn, z)
    return 2 * low / (1 + low), 2 * high / (1 + high)


# ---- p-values as columns ------------------------------------------------------

def _backward(steps: Column | int, build, start: Column | None = None) -> Column:
    """Fold over k = steps, ..., 1 from 1.0: the innermost term of a continued fraction or of a Horner form comes first."""
    ks = F.sequence(F.lit(steps) if isinstance(steps, int) else steps, F.lit(1), F.lit(-1))
    return F.aggregate(ks, F.lit(1.0) if start is None else start, lambda acc, k: build(acc, k.cast("double")))


def normal_tail_of(z: Column) -> Column:
    """P(Z > z) of the standard normal: a series below 3, a continued fraction beyond."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) / F.lit(math.sqrt(2 * math.pi))
    inner = F.lit(0.5) - density * a * _backward(60, lambda acc, k: 1 + acc * a * a / (2 * k + 1))
    outer = density / _backward(90, lambda acc, k: a + k / acc, a)
    upper = F.when(a < 3, inner).otherwise(outer)
    return F.when(z < 0, 1 - upper).otherwise(upper)


def log_gamma_of(x: Column) -> Column:
    """ln Γ(x) for x > 0: Stirling's series at x + 8, less the eight factors between."""
    y = x + 8
    r = 1 / (y * y)
    series = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * (F.lit(1 / 1680) - r * F.lit(1 / 1188))))) / y
    factors = x
    for k in range(1, 8):
        factors = factors * (x + k)
    return (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(factors)


def _beta_side(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function, divided by a; it converges within about sqrt(a + b) pairs of steps."""
    def term(acc: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(k % 2 == 0, even).otherwise(odd) / acc
    return 1 / (a * (1 - (a + b) * x / (a + 1) / _backward(steps, lambda acc, k: term(acc, k + 1))))


def spearman_p_of(rho: Column, n: Column) -> Column:
    """Two-sided p from Student's t with n − 2 degrees of freedom, as `spearman_p`."""
    a, b = (n.cast("double") - 2) / 2, F.lit(0.5)
    y = rho * rho
    x = 1 - y
    steps = (F.lit(60) + 6 * F.sqrt(n.cast("double"))).cast("int")
    front = F.exp(log_gamma_of(a + b) - log_gamma_of(a) - F.lit(0.5 * math.log(math.pi)) + a * F.ln(x) + b * F.ln(y))
    low = x < (a + 1) / (a + b + 2)
    p = F.when(low, front * _beta_side(a, b, x, steps)).otherwise(1 - front * _beta_side(b, a, y, steps))
    return F.when(n < 3, 1.0).when(F.abs(rho) >= 1, 0.0).when(rho == 0, 1.0).otherwise(p)


def mann_whitney_p_of(u: Column, n1: Column, n2: Column, ties: Column, *, less: bool = True) -> Column:
    """One-sided normal approximation with tie and continuity correction, as `mann_whitney_p`."""
    a, b = n1.cast("double"), n2.cast("double")
    n = a + b
    var = a * b / 12 * ((n + 1) - F.coalesce(F.try_divide(ties.cast("double"), n * (n - 1)), F.lit(0.0)))
    big = a * b - u if less else u
    return F.when(var <= 0, 1.0).otherwise(normal_tail_of((big - a * b / 2 - 0.5) / F.sqrt(var)))


# ---- p-values of single result rows (plain numbers) ---------------------------

def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def mann_whitney_p(u: float, n1: int, n2: int, ties: float = 0.0, *, less: bool = True) -> float:
    """One-sided normal approximation with tie and continuity correction; `u` counts pairs won by sample 1."""
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    big = n1 * n2 - u if less else u
    return normal_tail((big - n1 * n2 / 2.0 - 0.5) / math.sqrt(var))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p from Student's t with n − 2 degrees of freedom."""
    if n < 3 or abs(rho) >= 1.0:
        return 0.0 if n >= 3 else 1.0
    df = n - 2
    t2 = rho * rho * df / (1.0 - rho * rho)
    return incomplete_beta(df / 2.0, 0.5, df / (df + t2))
