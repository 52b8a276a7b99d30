"""Scalar column helpers: dates, guarded arithmetic, fixed-format numbers, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
_UNIX_EPOCH_JD = 2440587.5
_J2000_MICROS = 946_728_000_000_000          # 2000-01-01 12:00:00
_DAY_MICROS = 86_400_000_000
LUNAR_DISTANCES_PER_AU = 389.17
EARTH_RADIUS_KM = 6378.137
MU_EARTH = 398600.4418


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_valid(x: Column | str) -> Column:
    """Known, not NaN and finite."""
    x = _c(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def finite_or_zero(x: Column | str) -> Column:
    return F.when(is_valid(x), _c(x)).otherwise(F.lit(0.0))


def clean_double(text: Column | str) -> Column:
    """Number in a text column; NULL when empty, malformed or NaN."""
    value = _c(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def log10_magnitude(x: Column | str, floor: float = -30.0) -> Column:
    """log10 of the absolute value, `floor` at zero, NULL and NaN kept."""
    x = _c(x)
    return F.when(F.isnan(x), x).when(x == 0, F.lit(floor)).otherwise(F.log10(F.abs(x)))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def julian_to_timestamp(jd: Column | str) -> Column:
    return F.timestamp_micros(F.round((_c(jd) - F.lit(_UNIX_EPOCH_JD)) * F.lit(float(_DAY_MICROS))).cast("long"))


def julian_to_calendar(jd: Column | str) -> Column:
    """Calendar text such as 2029-Apr-13."""
    return F.date_format(julian_to_timestamp(jd), "yyyy-MMM-dd")


def two_digit_year_epoch(year: Column | str, day: Column | str) -> Column:
    """Two-digit year (57 and later are 19xx) and fractional day of year to a timestamp."""
    year, day = _c(year), _c(day)
    full = F.when(year < 57, year + 2000).otherwise(year + 1900).cast("int")
    start = F.unix_date(F.make_date(full, F.lit(1), F.lit(1))).cast("long") * F.lit(_DAY_MICROS)
    return F.timestamp_micros(start + F.round((day - 1) * F.lit(float(_DAY_MICROS))).cast("long"))


def days_since_j2000(epoch: Column | str) -> Column:
    """ISO text (with or without Z, T or fraction) to days since 2000-01-01 12:00."""
    text = F.regexp_replace(F.regexp_replace(_c(epoch), "Z$", ""), "T", " ")
    micros = F.unix_micros(text.try_cast("timestamp"))
    return (micros - F.lit(_J2000_MICROS)) / F.lit(float(_DAY_MICROS))


def timestamp_to_j2000(ts: Column | str) -> Column:
    return (F.unix_micros(_c(ts).cast("timestamp")) - F.lit(_J2000_MICROS)) / F.lit(float(_DAY_MICROS))


def pseudo_exponent(text: Column | str) -> Column:
    """Numbers such as -11606-4 (meaning -0.11606e-4); blank counts as 0."""
    t = F.trim(_c(text))
    blank = (t == "") | t.contains(" ")
    size = F.length(t)
    mantissa = F.substring(t, F.lit(1), size - 2).try_cast("double") * F.lit(1e-5)
    power = F.substring(t, size - 1, F.lit(2)).try_cast("int")
    return F.when(blank, F.lit(0.0)).otherwise(mantissa * F.pow(F.lit(10.0), power))


def implied_decimal(text: Column | str) -> Column:
    return F.concat(F.lit("0."), F.trim(_c(text))).try_cast("double")


def strip_line_end(text: Column | str) -> Column:
    """Drop trailing backslashes, line ends and blanks."""
    return F.regexp_replace(_c(text), r"[\\\s]+$", "")


def to_lunar_distance(au: Column | str) -> Column:
    return _c(au) * F.lit(LUNAR_DISTANCES_PER_AU)


def orbit_from_mean_motion(revs_per_day: Column | str, ecc: Column | str) -> dict[str, Column]:
    """Semi-major axis and heights above the surface (km); NULL for a non-positive motion."""
    n, e = _c(revs_per_day), _c(ecc)
    rad_s = n * F.lit(2.0) * F.pi() / F.lit(86400.0)
    a = F.when(rad_s > 0, F.pow(F.lit(MU_EARTH) / (rad_s * rad_s), F.lit(1.0 / 3.0)))
    return {"semimajor_axis": a, "periapsis": a * (1 - e) - EARTH_RADIUS_KM, "apoapsis": a * (1 + e) - EARTH_RADIUS_KM}


def row_digest(columns: Sequence[Column | str], separator: str = "|") -> Column:
    """MD5 over the columns' text, NULL as empty text."""
    return F.md5(F.concat_ws(separator, *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns]))


def width_bucket_clipped(x: Column | str, top: float, n: int) -> Column:
    """Equal-width bucket of [0, top], out-of-range values in the nearest end bucket."""
    raw = F.width_bucket(_c(x).cast("double"), F.lit(0.0), F.lit(float(top)), F.lit(n))
    return F.greatest(F.least(raw, F.lit(n)) - 1, F.lit(0)).cast("int")
