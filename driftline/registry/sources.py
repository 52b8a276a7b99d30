"""Readers, scalar functions and artifacts, on lines and records derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import scalar as X
from driftline.models import model_io
from driftline.operators import relations as Rl
from driftline.operators.ordering import with_position
from driftline.registry.base import R, Tables, big, query, r
from driftline.session import shared_path
from driftline.sources import text as S

# ---- S: scans -----------------------------------------------------------------


@query("S1_sensor_text", f"""
SELECT CAST(l_suppkey AS INTEGER) AS unit_id, l_linenumber AS cycle, l_quantity AS setting_1, l_tax AS setting_2,
       {R('l_extendedprice')} AS sensor_1 FROM lineitem""")
def _(t: Tables):
    cols = [F.col(c).cast("string") for c in ("l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice")]
    lines = t.lineitem.select(F.concat(F.concat_ws("  ", *cols), F.lit(" ")).alias("value"))
    out = S.split_fields(lines, ["unit_id", "cycle", "setting_1", "setting_2", "sensor_1"], ints=["unit_id", "cycle"])
    return out.withColumn("sensor_1", r("sensor_1"))


@query("S2_life_truth_by_line", """
SELECT row_number() OVER (ORDER BY s_suppkey) AS unit_id, CAST(floor(s_acctbal) AS BIGINT) AS true_rul FROM supplier""")
def _(t: Tables):
    out = with_position(t.supplier, [], ["s_suppkey"], rows=t.rows("supplier"))
    return out.select(big(F.col("pos") + 1).alias("unit_id"), big(F.floor("s_acctbal")).alias("true_rul"))


@query("S2_life_truth_text", """
SELECT row_number() OVER (ORDER BY s_suppkey) AS unit_id, CAST(trunc(s_acctbal) AS BIGINT) AS true_rul FROM supplier""")
def _(t: Tables):
    path = shared_path(t.spark, "truth")
    t.supplier.orderBy("s_suppkey").select(F.col("s_acctbal").cast("string").alias("value")).write.text(path)
    return S.read_life_truth_lines(t.spark, path)


@query("S4_snapshot_files", f"""
SELECT file_no, snapshot_no, count(*) AS n, {R('sum(horiz)', 4)} AS horiz FROM (
  SELECT dense_rank() OVER (ORDER BY p_size * 3) - 1 AS file_no, p_size * 3 AS snapshot_no, p_retailprice AS horiz FROM part) GROUP BY ALL""")
def _(t: Tables):
    path = shared_path(t.spark, "snapshots")
    rows = t.part.select((F.col("p_size") * 3).alias("acc"), F.concat_ws(",", F.lit("9"), F.lit("1"), F.lit("0"), F.lit("0"), F.col("p_retailprice").cast("string"), F.lit("0")).alias("value"))
    rows.repartition("acc").write.partitionBy("acc").text(path)
    lines = t.spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    out = S.snapshot_fields(S.in_file_order(lines, "file", r"/acc=(\d+)/").withColumn("snapshot_no", F.regexp_extract("file", r"/acc=(\d+)/", 1).cast("int")))
    return out.groupBy("file_no", "snapshot_no").agg(F.count(F.lit(1)).alias("n"), r(F.sum("horiz"), 4).alias("horiz"))


@query("S3_two_delimiters", f"""
SELECT event_id, {R('value')} AS horiz, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS vert FROM events""")
def _(t: Tables):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    parts = [F.hour("ts"), F.minute("ts"), F.second("ts"), F.lit(0), F.col("value"), F.col("k")]
    parts = [p.cast("string") for p in parts]
    line = F.when(F.col("event_id") % 2 == 0, F.concat_ws(",", *parts)).otherwise(F.concat_ws(";", *parts))
    out = S.snapshot_fields(e.select("event_id", line.alias("value")))
    return out.select("event_id", r("horiz").alias("horiz"), "vert")


@query("S5_text_numbers", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_linenumber IN (1, 2, 3) THEN NULL ELSE {R('l_extendedprice')} END AS risk,
       l_discount AS miss_distance FROM lineitem""")
def _(t: Tables):
    ln = F.col("l_linenumber")
    raw = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(ln == 1, "").when(ln == 2, "n/a").when(ln == 3, "NaN").otherwise(F.col("l_extendedprice").cast("string")).alias("risk"),
        F.col("l_discount").cast("string").alias("miss_distance"))
    return S.message_numbers(raw, ["risk", "miss_distance"]).withColumn("risk", r("risk"))


@query("S6_private_labels", """
SELECT o_orderkey AS event_id, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE round(o_totalprice, 2) END AS true_risk FROM orders""")
def _(t: Tables):
    raw = t.orders.select(F.col("o_orderkey").alias("event_id"),
                          F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice").cast("string")).otherwise("").alias("true_risk"))
    return raw.select("event_id", F.round(X.clean_double("true_risk"), 2).alias("true_risk"))


def _pad(e: str, n: int) -> str:
    return f"lpad(CAST({e} AS VARCHAR), {n}, '0')"


# both engines build the same two lines from integer columns, then cut them by position
ORBIT_ROWS = f"""raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey AS BIGINT) + 44000 AS sat, CAST(l_partkey AS BIGINT) AS pk,
         CAST(l_orderkey AS BIGINT) AS ok, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
orbit_lines AS (SELECT raw.*,
  '1 ' || {_pad('sat', 5)} || 'U 19074A   ' || {_pad('(ok % 70 + 40) % 100', 2)} || {_pad('pk % 365 + 1', 3)} || '.'
    || {_pad('ok * 7919 % 100000000', 8)} || ' ' || (CASE WHEN q % 2 = 0 THEN '-' ELSE ' ' END) || '.' || {_pad('pk * 31 % 10000', 8)}
    || '  00000-0 ' || (CASE WHEN q % 5 = 0 THEN '        ' WHEN q % 3 = 0 THEN '-' || {_pad('pk % 100000', 5)} || '-3'
       ELSE ' ' || {_pad('ok % 100000', 5)} || '-4' END) || ' 0  9991' || (CASE WHEN q % 7 = 0 THEN chr(92) ELSE '' END) AS line1,
  '2 ' || {_pad('sat', 5)} || ' ' || {_pad('pk % 90', 3)} || '.' || {_pad('ok % 10000', 4)} || ' ' || {_pad('ok % 360', 3)} || '.' || {_pad('pk % 10000', 4)}
    || ' ' || (CASE WHEN q % 11 = 0 THEN '00x0000' ELSE {_pad('pk * 13 % 100000', 7)} END) || ' ' || {_pad('(pk + ok) % 360', 3)} || '.' || {_pad('q', 4)}
    || ' ' || {_pad('(pk * 3 + ok) % 360', 3)} || '.' || {_pad('q * 7', 4)} || ' ' || {_pad('q % 4 + 12', 2)} || '.' || {_pad('ok * 104729 % 100000000', 8)} || '    56' AS line2
  FROM raw)"""


def orbit_lines(t: Tables):
    sql = ORBIT_ROWS.replace("VARCHAR", "STRING").replace("FROM lineitem", "FROM {li}").replace("chr(92)", "char(92)")
    return t.spark.sql(f"WITH {sql} SELECT l_orderkey, l_linenumber, l_partkey, q, line1, line2 FROM orbit_lines", li=t.lineitem)


@query("S7_line_pairs", f"""WITH {ORBIT_ROWS}
SELECT l_orderkey, l_linenumber, l_partkey, line1, line2 FROM orbit_lines WHERE q % 9 <> 0""")
def _(t: Tables):
    # every ninth quantity leaves an orphan first line (followed by another one)
    lines = orbit_lines(t)
    follow = F.when(F.col("q") % 9 == 0, F.concat(F.lit("\n"), F.substring("line1", 3, 80))).otherwise(
        F.concat(F.lit("\n"), F.col("line2")))
    blocks = lines.select("l_orderkey", "l_linenumber", "l_partkey",
                          F.concat(F.expr("substring(line1, 3)"), follow).alias("value"))
    return S.pair_blocks(blocks)


@query("S8_orbit_fields", f"""WITH {ORBIT_ROWS}, cut AS (
  SELECT *, rtrim(rtrim(line1, chr(92))) AS a, line2 AS b FROM orbit_lines),
f AS (SELECT l_orderkey, l_linenumber, l_partkey, trim(substr(a, 3, 5)) AS norad_id, trim(substr(a, 10, 8)) AS object_id,
  CAST(substr(a, 19, 2) AS INTEGER) AS yr, CAST(substr(a, 21, 12) AS DOUBLE) AS dayno,
  CAST(trim(substr(a, 34, 10)) AS DOUBLE) AS ndot, trim(substr(a, 54, 8)) AS bs, CAST(substr(b, 9, 8) AS DOUBLE) AS incl,
  TRY_CAST('0.' || substr(b, 27, 7) AS DOUBLE) AS ecc, CAST(substr(b, 53, 11) AS DOUBLE) AS mm FROM cut),
g AS (SELECT *, pow(398600.4418 / pow(mm * 2 * pi() / 86400, 2), CAST(1 AS DOUBLE) / 3) AS sma,
  CASE WHEN bs = '' THEN 0 ELSE CAST(substr(bs, 1, length(bs) - 2) AS DOUBLE) * 1e-5 * pow(10, CAST(right(bs, 2) AS INTEGER)) END AS bstar
  FROM f WHERE ecc IS NOT NULL)
SELECT l_orderkey, l_linenumber, l_partkey, norad_id, object_id,
  epoch_us(make_timestamp(CASE WHEN yr < 57 THEN 2000 + yr ELSE 1900 + yr END, 1, 1, 0, 0, 0)) // 1000 + CAST(round((dayno - 1) * 86400000) AS BIGINT) AS epoch_ms,
  {R('ndot', 8)} AS mean_motion_dot, {R('bstar', 9)} AS bstar, {R('incl')} AS inclination, {R('ecc', 7)} AS eccentricity,
  {R('mm')} AS mean_motion, {R('sma', 4)} AS semimajor_axis, {R('sma * (1 - ecc) - 6378.137', 4)} AS periapsis,
  {R('sma * (1 + ecc) - 6378.137', 4)} AS apoapsis FROM g""")
def _(t: Tables):
    p = S.parse_orbits(orbit_lines(t).drop("q"))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "norad_id", "object_id",
                    F.round(F.unix_micros("epoch") / 1000.0).cast("long").alias("epoch_ms"),
                    r("mean_motion_dot", 8).alias("mean_motion_dot"), r("bstar", 9).alias("bstar"),
                    r("inclination").alias("inclination"), r("eccentricity", 7).alias("eccentricity"),
                    r("mean_motion").alias("mean_motion"), r("semimajor_axis", 4).alias("semimajor_axis"),
                    r("periapsis", 4).alias("periapsis"), r("apoapsis", 4).alias("apoapsis"))


@query("S10_ephemeris_text", f"""
SELECT event_id, event_id + CAST(0.5 AS DOUBLE) AS jd, {R('value')} AS q, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS a
FROM events""")
def _(t: Tables):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    s = lambda c: F.col(c).cast("string")
    good = F.concat_ws(", ", (F.col("event_id") + F.lit(0.5)).cast("string"), F.lit("A.D. 2024"), F.lit("0.1"), s("value"),
                       *[F.lit("1.5")] * 7, s("k"), F.lit("2"), F.lit("3"), F.lit(""))
    doc = F.concat(F.lit("header, with, commas\n$$SOE\n"), good, F.lit("\n 1, 2, 3\n"), F.lit("x, y, 1,1,1,1,1,1,1,1,1,1,1\n$$EOE\n"), good)
    out = S.parse_ephemeris(e.select("event_id", doc.alias("value")))
    return out.select("event_id", "jd", r("q").alias("q"), "a")


@query("S11_row_arrays", f"""
SELECT event_id, 'o' || user_id AS des, event_id + CAST(0.25 AS DOUBLE) AS jd, {R('value')} AS dist FROM events""")
def _(t: Tables):
    row = F.concat(F.lit('["'), F.col("value").cast("string"), F.lit('","o'), F.col("user_id").cast("string"), F.lit('","'),
                   (F.col("event_id") + F.lit(0.25)).cast("string"), F.lit('"]'))
    doc = F.concat(F.lit('{"count":"2","fields":["dist","des","jd"],"data":['), row, F.lit(',["oops","bad","1"]]}'))
    out = S.parse_row_arrays(t.events.select("event_id", doc.alias("value")), {"des": "string", "jd": "double", "dist": "double"})
    return out.withColumn("dist", r("dist"))


@query("S12_whitelist", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def _(t: Tables):
    return S.whitelist(t.lineitem, ["l_orderkey", "l_quantity", "l_tax"])


@query("S15_nested_discharges", f"""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, unnest([0, 1, 2]) AS sample_no, l_quantity AS q, l_tax AS x FROM lineitem
  WHERE l_linenumber % 2 = 0 AND l_linenumber % 3 <> 0)
SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS capacity, CAST(sample_no AS BIGINT) AS sample_no, {R('q * (sample_no + 1)')} AS voltage,
  {R('x + sample_no')} AS current, {R('q + x')} AS temperature, {R('10 * sample_no')} AS time_s FROM c""")
def _(t: Tables):
    q, x = F.col("l_quantity"), F.col("l_tax")
    ln = F.col("l_linenumber")
    cyc = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(ln % 2 == 0, "discharge").otherwise("charge").alias("type"),
        F.when(ln % 3 == 0, F.array().cast("array<double>")).otherwise(F.array("l_discount", x)).alias("capacity"),
        F.array(q, q * 2, q * 3).alias("voltage"), F.array(x, x + 1, x + 2).alias("current"),
        F.array(q + x, q + x, q + x).alias("temperature"), F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0)).alias("time_s"))
    out = S.discharge_cycles(cyc)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "capacity", big("sample_no").alias("sample_no"),
                      *[r(c).alias(c) for c in ("voltage", "current", "temperature", "time_s")])


@query("S16_named_subset", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_discount")


# ---- X: scalar functions ------------------------------------------------------


@query("X1_julian_dates", """
SELECT event_id, strftime(make_timestamp(CAST(round((2460000.5 + value - 2440587.5) * 86400000000) AS BIGINT)), '%Y-%b-%d') AS calendar,
       strftime(make_timestamp(CAST(round((2460000.5 + value - 2440587.5) * 86400000000) AS BIGINT)), '%Y-%m-%d %H:%M') AS minute
FROM events""")
def _(t: Tables):
    jd = F.lit(2460000.5) + F.col("value")
    return t.events.select("event_id", X.julian_to_calendar(jd).alias("calendar"),
                           F.date_format(X.julian_to_timestamp(jd), "yyyy-MM-dd HH:mm").alias("minute"))


@query("X2_two_digit_years", """
SELECT l_orderkey, l_linenumber, l_partkey, epoch_us(make_timestamp(CASE WHEN l_orderkey % 100 < 57 THEN 2000 ELSE 1900 END + l_orderkey % 100, 1, 1, 0, 0, 0))
  + CAST(round((l_partkey % 365 + CAST(0.25 AS DOUBLE) * l_linenumber) * 86400000000) AS BIGINT) AS micros FROM lineitem""")
def _(t: Tables):
    day = F.col("l_partkey") % 365 + F.lit(0.25) * F.col("l_linenumber") + 1
    ts = X.two_digit_year_epoch((F.col("l_orderkey") % 100).cast("int"), day)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.unix_micros(ts).alias("micros"))


@query("X3_iso_epochs", f"""
SELECT event_id, {R('(epoch_us(ts) - 946728000000000) / CAST(86400000000 AS DOUBLE)')} AS days FROM events""")
def _(t: Tables):
    ts = F.col("ts").cast("timestamp")
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(full, F.lit("Z"))).when(
        F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(full)
    return t.events.select("event_id", r(X.days_since_j2000(text)).alias("days"))


@query("X4_pseudo_exponent", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN CAST(0 AS DOUBLE) ELSE {R('(CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) * (l_partkey % 100000) * 1e-5 * pow(10, -(l_linenumber % 5))', 9)} END AS x
FROM lineitem""")
def _(t: Tables):
    ln = F.col("l_linenumber")
    body = F.concat(F.when(ln % 2 == 0, "-").otherwise(" "), F.lpad((F.col("l_partkey") % 100000).cast("string"), 5, "0"),
                    F.lit("-"), (ln % 5).cast("string"))
    text = F.when(ln == 1, F.lit("        ")).otherwise(body)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r(X.pseudo_exponent(text), 9).alias("x"))


@query("X5_implied_decimal", f"SELECT p_partkey, {R('(p_partkey % 10000000) / CAST(10000000 AS DOUBLE)', 7)} AS ecc FROM part")
def _(t: Tables):
    text = F.lpad((F.col("p_partkey") % 10000000).cast("string"), 7, "0")
    return t.part.select("p_partkey", r(X.implied_decimal(text), 7).alias("ecc"))


@query("X6_line_end", "SELECT p_partkey, p_name AS line FROM part")
def _(t: Tables):
    dirty = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit("\\ \r\n")).otherwise(F.lit("  \\\\")))
    return t.part.select("p_partkey", X.strip_line_end(dirty).alias("line"))


@query("X7_string_tests", """
SELECT p_partkey, contains(lower(p_type), 'eco') AS has_eco, starts_with(p_brand, 'Brand#1') AS brand_1 FROM part""")
def _(t: Tables):
    return t.part.select("p_partkey", F.lower("p_type").contains("eco").alias("has_eco"),
                         F.col("p_brand").startswith("Brand#1").alias("brand_1"))


@query("X8_arithmetic", f"""
SELECT p_partkey, {R('abs(p_size - 25)')} AS a, {R('sqrt(p_size)')} AS s, {R('exp(-p_size / CAST(13 AS DOUBLE))')} AS e,
  {R('log10(p_retailprice)')} AS l, {R('pow(p_size, CAST(1 AS DOUBLE) / 3)')} AS p, {R('least(p_size, 20)')} AS lo,
  {R('greatest(p_size, 20)')} AS hi, {R('round(p_retailprice, 1)')} AS rd FROM part""")
def _(t: Tables):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return t.part.select("p_partkey", r(F.abs(s - 25)).alias("a"), r(F.sqrt(s)).alias("s"), r(F.exp(-s / F.lit(13.0))).alias("e"),
                         r(F.log10(p)).alias("l"), r(F.pow(s, F.lit(1.0 / 3))).alias("p"), r(F.least(s, F.lit(20))).alias("lo"),
                         r(F.greatest(s, F.lit(20))).alias("hi"), r(F.round(p, 1)).alias("rd"))


@query("X9_lunar_distance", f"SELECT s_suppkey, {R('s_acctbal * CAST(389.17 AS DOUBLE)', 3)} AS ld FROM supplier")
def _(t: Tables):
    return t.supplier.select("s_suppkey", r(X.to_lunar_distance("s_acctbal"), 3).alias("ld"))


@query("X10_safe_division", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {R('CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END')} AS ratio,
  {R('l_quantity / greatest(l_tax, 1)')} AS at_least_one FROM lineitem""")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             r(X.safe_divide(F.col("l_discount"), F.col("l_tax"))).alias("ratio"),
                             r(F.col("l_quantity") / F.greatest(F.col("l_tax"), F.lit(1.0))).alias("at_least_one"))


@query("X11_row_digest", """
SELECT c_custkey, md5(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment)) AS digest FROM customer""")
def _(t: Tables):
    return t.customer.select("c_custkey", X.row_digest(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).alias("digest"))


@query("X12_array_steps", f"""
SELECT vec_id, {R('embedding[4]::DOUBLE - embedding[3]::DOUBLE')} AS d4, {R('list_sum(embedding[1:8]::DOUBLE[])')} AS head, len(embedding) AS n FROM embeddings""")
def _(t: Tables):
    e = F.col("embedding").cast("array<double>")
    diff = F.zip_with(F.slice(e, 2, F.size(e) - 1), F.slice(e, 1, F.size(e) - 1), lambda a, b: a - b)
    return t.embeddings.select("vec_id", r(diff[2]).alias("d4"),
                               r(F.aggregate(F.slice(e, 1, 8), F.lit(0.0), lambda a, b: a + b)).alias("head"), big(F.size(e)).alias("n"))


# ---- K: artifacts -------------------------------------------------------------


@query("K3_ordered_output", """
SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS micros FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey""")
def _(t: Tables):
    out = t.orders.select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("micros"))
    return out.orderBy("o_custkey", F.desc("micros"), "o_orderkey")


@query("K5_table_digest", """
WITH d AS (SELECT md5(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment)) AS h FROM customer),
g AS (SELECT substr(h, 1, 2) AS g, count(*) AS n, sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS b FROM d GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, md5(string_agg(g || ':' || n || ':' || a || ':' || b, '|' ORDER BY g || ':' || n || ':' || a || ':' || b)) AS digest FROM g""")
def _(t: Tables):
    return model_io.table_digest(t.customer, ["c_custkey", "c_name", "c_mktsegment"])


@query("K6_split_manifest", """
SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_objects, count(*) FILTER (event_id % 2 = 0) AS n_first,
  count(*) FILTER (event_id % 2 = 1) AS n_second, count(DISTINCT user_id) FILTER (event_id % 2 = 0) AS objects_first,
  epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts FROM events""")
def _(t: Tables):
    first = F.col("event_id") % 2 == 0
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    # one row per object before the distinct counts
    per = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(first).alias("a"),
                                          F.min(micros).alias("lo"), F.max(micros).alias("hi"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_objects"), F.sum("a").alias("n_first"),
                   (F.sum("n") - F.sum("a")).alias("n_second"), F.count_if(F.col("a") > 0).alias("objects_first"),
                   F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"))


# ---- through shared storage ---------------------------------------------------

@query("S9_record_lists", f"SELECT o_orderkey, o_custkey, {R('o_totalprice', 2)} AS o_totalprice FROM orders")
def _(t: Tables):
    # lists of the records of a thousand consecutive orders, one JSON document each
    path = shared_path(t.spark, "lists")
    record = F.struct("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    lists = t.orders.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("part")).agg(F.to_json(F.collect_list(record)).alias("value"))
    lists.repartition("part").write.partitionBy("part").text(path)
    out = S.read_records(t.spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double").drop("part")
    return out.withColumn("o_totalprice", r("o_totalprice", 2))


@query("S14_name_variants", f"SELECT event_id, {R('value')} AS value, event_type AS dataset FROM events")
def _(t: Tables):
    path = shared_path(t.spark, "variants")
    t.events.select("event_id", "value", F.col("event_type").alias("kind")).write.partitionBy("kind").parquet(path)
    return S.read_variants(t.spark, path, "*.parquet", r"/kind=(\w+)/").select("event_id", r("value").alias("value"), "dataset")


@query("K1_record_cache", """
WITH u AS (SELECT *, 1 AS load_no FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, ts, user_id, event_type, value + 1, props, 2 FROM events)
SELECT user_id, event_id, load_no, round(value, 6) AS v FROM u QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY load_no, event_id) = 1""")
def _(t: Tables):
    path = shared_path(t.spark, "cache")
    first = t.events.where("event_id % 3 = 0").withColumn("load_no", F.lit(1))
    second = t.events.withColumn("value", F.col("value") + 1).withColumn("load_no", F.lit(2))
    model_io.write_records(first, path, "user_id")
    model_io.write_records(second, path, "user_id")
    out = Rl.dedupe(t.spark.read.parquet(path), ["user_id", "ts"], "load_no", ["event_id"])
    return out.select("user_id", "event_id", "load_no", F.round("value", 6).alias("v"))


@query("K1_merged_cache", """
WITH u AS (SELECT *, 1 AS load_no FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, ts, user_id, event_type, value + 1, props, 2 FROM events WHERE user_id % 5 <> 0)
SELECT user_id, event_id, load_no, round(value, 6) AS v FROM u QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY load_no, event_id) = 1""")
def _(t: Tables):
    path = shared_path(t.spark, "merged")
    first = t.events.where("event_id % 3 = 0").withColumn("load_no", F.lit(1))
    second = t.events.where("user_id % 5 != 0").withColumn("value", F.col("value") + 1).withColumn("load_no", F.lit(2))
    for load in (first, second):
        model_io.merge_records(load, path, "user_id", "ts", ["event_id"])
    # read as it stands: no record is there twice
    return t.spark.read.parquet(path).select("user_id", "event_id", "load_no", F.round("value", 6).alias("v"))


@query("K4_result_tables", f"""
WITH s AS (SELECT l_suppkey, count(*) AS n, {R('sum(l_quantity)', 3)} AS total FROM lineitem GROUP BY l_suppkey)
SELECT 'csv' AS form, * FROM s UNION ALL SELECT 'json', * FROM s UNION ALL SELECT 'parquet', * FROM s""")
def _(t: Tables):
    table = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 3).alias("total"))
    out = None
    for form in ("csv", "json", "parquet"):
        path = shared_path(t.spark, form)
        model_io.write_results(table, path, form)
        back = t.spark.read.schema(table.schema).option("header", True).format(form).load(path).select(F.lit(form).alias("form"), *table.columns)
        out = back if out is None else out.unionByName(back)
    return out
