"""Readers for the raw files, each with a column-level half that works on any frame of lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.scalar import (clean_double, implied_decimal, orbit_from_mean_motion, pseudo_exponent,
                                        strip_line_end, two_digit_year_epoch)
from driftline.session import materialise

# fixed values: column order of the headerless turbofan text
TURBOFAN_COLUMNS = (["unit_id", "cycle"] + [f"setting_{i}" for i in range(1, 4)] + [f"sensor_{i}" for i in range(1, 22)])
# fixed values: columns of the event messages that are used
MESSAGE_NUMBERS = ["time_to_tca", "risk", "miss_distance", "mahalanobis_distance", "relative_position_r",
                   "relative_position_t", "relative_position_n", "t_sigma_r", "c_sigma_r", "t_position_covariance_det",
                   "c_position_covariance_det", "t_obs_used", "c_obs_used", "t_weighted_rms", "c_weighted_rms",
                   "c_actual_od_span", "t_time_lastob_end", "c_time_lastob_end"]
# fixed values: flight tables; groups that would leak the answer are refused
FLIGHT_CONDITIONS = ["alt", "Mach", "TRA", "T2"]
FLIGHT_SENSORS = ["T24", "T30", "T48", "T50", "P15", "P2", "P21", "P24", "Ps30", "P40", "P50", "Nf", "Nc", "Wf"]
FLIGHT_KEYS = ["unit", "cycle", "Fc", "h_s"]


# ---- whitespace text ----------------------------------------------------------

def split_fields(lines: DataFrame, columns: Sequence[str], pattern: str = r"\s+", value: str = "value",
                 ints: Sequence[str] = (), places: Sequence[int] | None = None) -> DataFrame:
    """Fields of a text line as typed columns; blank lines are skipped."""
    line = F.btrim(F.col(value), F.lit(" \t\r\n"))
    parts = F.split(line, pattern)
    places = list(places) if places is not None else list(range(len(columns)))
    rest = [F.col(c) for c in lines.columns if c != value]
    kept = lines.where(line != "")
    return kept.select(*rest, *[F.get(parts, F.lit(i)).try_cast("int" if c in ints else "double").alias(c)
                                for i, c in zip(places, columns)])


def read_sensor_text(spark: SparkSession, path: str) -> DataFrame:
    return split_fields(spark.read.text(path), TURBOFAN_COLUMNS, ints=["unit_id", "cycle"])


def read_life_truth(spark: SparkSession, path: str) -> DataFrame:
    """One number per line; line i belongs to unit i. A truth file has one line per object."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.btrim(F.col("value"), F.lit(" \t\r\n")), r"\r?\n")))
    return rows.select((F.col("pos") + 1).cast("int").alias("unit_id"),
                       F.trim("col").try_cast("double").cast("int").alias("true_rul"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): every line of a file, or of a folder's files in name order, with its 0-based number; files are read in splits.

    A split's lines stand together in one task, in order, so a line's number is its place in the split plus the lines of earlier splits: one
    small row per split carries them. The lines are written once, as both readers have to see the same splits.
    """
    split = ["_file", "_start"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    lines = materialise(lines.withColumn("_id", F.monotonically_increasing_id()))
    sizes = lines.groupBy(*split).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)           # one row per split of 128 MB
    carried = sizes.select(*split, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return lines.join(carried, split).select((F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "value")


def read_life_truth_lines(spark: SparkSession, path: str) -> DataFrame:
    """As `read_life_truth`, for truth files of any size, or folders of files in name order."""
    return numbered_lines(spark, path).select((F.col("line_no") + 1).alias("unit_id"), F.trim("value").try_cast("double").cast("long").alias("true_rul"))


def in_file_order(df: DataFrame, file: str, pattern: str, out: str = "file_no") -> DataFrame:
    """Add `out`: the 0-based place of the row's file by the number in its name (`pattern`'s group), not by the name's text."""
    number = F.regexp_extract(file, pattern, 1).cast("long")
    files = df.select(number.alias("_number")).distinct()
    places = files.withColumn(out, (F.row_number().over(Window.orderBy("_number")) - 1).cast("long"))     # one row per file
    return df.withColumn("_number", number).join(places, "_number").drop("_number")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Vibration files acc_NNNNN.csv under <bearing>/: comma or semicolon, six fields, the last two are signals."""
    raw = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="acc_*.csv").select("value", "_metadata.file_path")
    raw = raw.withColumns({
        "bearing": F.element_at(F.split("file_path", "/"), -2),
        "snapshot_no": F.regexp_extract("file_path", r"acc_(\d+)\.csv", 1).cast("int")}).drop("file_path")
    return snapshot_fields(raw)


def snapshot_fields(lines: DataFrame, value: str = "value") -> DataFrame:
    """Time of day and both signals of a sample line, whatever the delimiter."""
    names = ["hour", "minute", "second", "micro", "horiz", "vert"]
    return split_fields(lines, names, "[,;]", value)


# ---- event messages -----------------------------------------------------------

def read_messages(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Header CSV, every field text at first; numbers that do not parse become NULL."""
    raw = spark.read.option("header", True).csv(path)
    return message_numbers(raw, [c for c in (columns or MESSAGE_NUMBERS) if c in raw.columns])


def message_numbers(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    return raw.withColumns({c: clean_double(c) for c in columns})


def column_difference(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns that only one side has."""
    return sorted(set(a.columns) ^ set(b.columns))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select("event_id", clean_double("true_risk").alias("true_risk"))


def _once(df: DataFrame, keep: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Columns that later filters and columns share, computed a single time.

    A filter on a computed column is pushed below it together with a copy of its
    expression; rows that come out of a generator are not recomputed.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


# ---- two-line orbit text ------------------------------------------------------

def read_orbit_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Line pairs of a catalogue file of any size.

    Records are split in front of every first line, so the file stays splittable
    and no global line order is needed.
    """
    return pair_blocks(spark.read.option("lineSep", "\n1 ").text(path))


def pair_blocks(blocks: DataFrame, value: str = "value") -> DataFrame:
    """Blocks that start with a first line and go on with a second line right after it."""
    rest = [c for c in blocks.columns if c != value]
    # the block is often a long expression: without this it would be worked out for each line and again for the filter
    once = _once(blocks, rest, {"_parts": F.split(F.regexp_replace(F.col(value), r"^1 ", ""), "\n", 3)})
    out = once.where(F.get("_parts", F.lit(1)).startswith("2 "))
    return out.select(*rest, F.concat(F.lit("1 "), F.get("_parts", F.lit(0))).alias("line1"), F.get("_parts", F.lit(1)).alias("line2"))


def strict_double(text: Column) -> Column:
    """A decimal number, else NULL; casts alone would also take type suffixes such as 12.5f."""
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def parse_orbits(pairs: DataFrame, at_least: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Fixed-width fields of line pairs; pairs with a malformed field are dropped.

    `at_least` keeps object numbers from there on, `wanted(norad_id)` a given set;
    both act before the remaining fields are parsed.
    """
    cut = lambda c, a, b: F.substring(F.col(c), a + 1, b - a)
    num = lambda c, a, b: strict_double(F.trim(cut(c, a, b)))
    rest = [c for c in pairs.columns if c not in ("line1", "line2")]
    base = _once(pairs, rest, {"line1": strip_line_end("line1"), "line2": strip_line_end("line2")})
    base = base.withColumn("norad_id", F.trim(cut("line1", 2, 7)))
    if at_least is not None:
        base = base.where(F.col("norad_id").try_cast("int") >= at_least)
    if wanted is not None:
        base = base.join(wanted.select("norad_id").distinct(), "norad_id", "left_semi")
    out = _once(base, [*rest, "norad_id"], {
        "classification": cut("line1", 7, 8), "object_id": F.trim(cut("line1", 9, 17)),
        "epoch": two_digit_year_epoch(F.trim(cut("line1", 18, 20)).try_cast("int"), num("line1", 20, 32)),
        "mean_motion_dot": num("line1", 33, 43), "bstar": pseudo_exponent(cut("line1", 53, 61)),
        "inclination": num("line2", 8, 16), "raan": num("line2", 17, 25),
        "eccentricity": implied_decimal(cut("line2", 26, 33)), "arg_pericenter": num("line2", 34, 42),
        "mean_anomaly": num("line2", 43, 51), "mean_motion": num("line2", 52, 63)})
    need = ["epoch", "mean_motion_dot", "bstar", "inclination", "raan", "eccentricity", "arg_pericenter", "mean_anomaly"]
    out = out.dropna(subset=need).where(F.col("mean_motion") > 0)
    return out.withColumns(orbit_from_mean_motion("mean_motion", "eccentricity"))


# ---- ephemeris text -----------------------------------------------------------

# fixed values: places of the fields in an ephemeris line
EPHEMERIS_FIELDS = {"jd": 0, "e": 2, "q": 3, "i": 4, "om": 5, "w": 6, "tp": 7, "nm": 8, "ma": 9, "a": 11}


def read_ephemeris(spark: SparkSession, path: str) -> DataFrame:
    """One text per object, the object named by its file."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.element_at(F.split("_metadata.file_path", "/"), -1), r"^(.*?)(\.[^.]*)?$", 1).alias("designation"),
        "value")
    return parse_ephemeris(raw)


def parse_ephemeris(texts: DataFrame, value: str = "value") -> DataFrame:
    """Element lines between the start and end markers; short or malformed lines are skipped."""
    rest = [F.col(c) for c in texts.columns if c != value]
    body = F.regexp_extract(F.col(value), r"(?s)\$\$SOE(.*?)(?:\$\$EOE|$)", 1)
    lines = texts.select(*rest, F.explode(F.split(body, "\n")).alias("_line"))
    parts = F.split("_line", ",")
    fields = {n: F.trim(F.get(parts, F.lit(p))).try_cast("double") for n, p in EPHEMERIS_FIELDS.items()}
    out = lines.where(F.size(parts) >= 12).select(*rest, *[v.alias(n) for n, v in fields.items()])
    return out.dropna(subset=list(fields))


# ---- row-array JSON -----------------------------------------------------------

def parse_row_arrays(docs: DataFrame, wanted: Mapping[str, str], value: str = "value") -> DataFrame:
    """Documents {"fields": [...], "data": [[...], ...]}: pick fields by name, skip rows that do not parse.

    `wanted` maps a field name to a Spark type.
    """
    shape = "struct<fields: array<string>, data: array<array<string>>>"
    rest = [F.col(c) for c in docs.columns if c != value]
    rows = docs.select(*rest, F.from_json(F.col(value), shape).alias("_d")).select(
        *rest, F.col("_d.fields").alias("_f"), F.explode("_d.data").alias("_r"))

    def item(name: str, kind: str) -> Column:
        at = F.array_position("_f", name).cast("int")
        return F.when(at > 0, F.get(F.col("_r"), at - 1)).try_cast(kind)

    out = rows.select(*rest, *[item(n, k).alias(n) for n, k in wanted.items()])
    return out.dropna(subset=[n for n, k in wanted.items() if k != "string"])


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lists of records (decay records, object lists, per-object caches) with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


# ---- staged tables ------------------------------------------------------------

def read_whitelisted(spark: SparkSession, path: str, columns: Sequence[str],
                     forbidden: str = r"(?i)^(x_v|t_.*health|theta).*") -> DataFrame:
    """Only the allowed columns of a staged table; asking for a leaking column is an error."""
    return whitelist(spark.read.parquet(path), columns, forbidden)


def read_variants(spark: SparkSession, path: str, pattern: str, name: str) -> DataFrame:
    """Staged files whose names match a glob, with the data set's name taken from the file name.

    `name` is a regular expression with one group, e.g. `(DS\\d+[a-z]?)`.
    """
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(path)
    return files.select("*", F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("dataset"))


def whitelist(df: DataFrame, columns: Sequence[str], forbidden: str = r"(?i)^(x_v|t_.*health|theta).*") -> DataFrame:
    import re
    bad = [c for c in columns if re.match(forbidden, c)]
    if bad:
        raise ValueError(f"columns would leak the answer: {bad}")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*columns)


def same_columns(df: DataFrame, expected: Sequence[str]) -> bool:
    """Whether the file's channels are the declared ones, in the declared order."""
    return [c for c in df.columns if c in set(expected)] == list(expected)


def discharge_cycles(cycles: DataFrame, signals: Sequence[str] = ("voltage", "current", "temperature", "time_s")) -> DataFrame:
    """Discharge cycles with a known capacity, one row per sample."""
    kept = cycles.where((F.col("type") == "discharge") & (F.size("capacity") > 0))
    rest = [c for c in cycles.columns if c not in (*signals, "capacity", "type")]
    zipped = F.arrays_zip(*[F.col(s) for s in signals])
    rows = kept.select(*rest, F.get("capacity", F.lit(0)).alias("capacity"), F.posexplode(zipped).alias("sample_no", "_s"))
    return rows.select(*rest, "capacity", "sample_no", *[F.col(f"_s.{s}").alias(s) for s in signals])
