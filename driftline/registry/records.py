"""Cleaning, labels, relations, splits and orderings on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import scalar as X
from driftline.models import calibrate
from driftline.models.scale import varying
from driftline.operators import ordering as O
from driftline.operators import relations as Rl
from driftline.operators import windows as W
from driftline.plans import conjunction, flights, orbits
from driftline.registry.base import EV, LI, R, SUPPLY_ORDER, Tables, big, query, r

# ---- P: projections, filters, cleaning ----------------------------------------


@query("P1_drop_flat", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def _(t: Tables):
    flat = ["l_tax", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return t.lineitem.drop(*flat)


@query("P2_varying_features", """
WITH c AS (SELECT 'l_quantity' AS feature, stddev_pop(l_quantity) AS s FROM lineitem UNION ALL
  SELECT 'flat', stddev_pop(CAST(5 AS DOUBLE)) FROM lineitem UNION ALL SELECT 'l_tax', stddev_pop(l_tax) FROM lineitem)
SELECT feature FROM c WHERE s > 0""")
def _(t: Tables):
    kept = varying(t.lineitem.withColumn("flat", F.lit(5.0)), ["l_quantity", "flat", "l_tax"])
    return t.spark.createDataFrame([(c,) for c in kept], "feature string")


def _approaches(t: Tables):
    return t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"),
                           (F.col("o_totalprice") / F.lit(1e7)).alias("dist_au"),
                           (F.col("o_custkey") % 40).cast("double").alias("v_inf"))


@query("P3_corpus_filter", """
SELECT o_orderkey FROM orders WHERE o_totalprice / CAST(1e7 AS DOUBLE) <= CAST(0.02 AS DOUBLE) AND o_custkey % 40 <= 15
  AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-01-01'""")
def _(t: Tables):
    return orbits.corpus_filter(_approaches(t), "1996-01-01", "2000-01-01").select("o_orderkey")


@query("P4_enough_history", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 10)""")
def _(t: Tables):
    return Rl.enough_history(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], 10)


@query("P5_exclude_identity", "SELECT c_custkey, c_name FROM customer WHERE NOT contains(lower(c_name), '00042')")
def _(t: Tables):
    return t.customer.where(~F.lower("c_name").contains("00042")).select("c_custkey", "c_name")


@query("P6_first_n_by_date", """
SELECT o_orderkey, epoch_us(o_orderdate) AS micros FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000""")
def _(t: Tables):
    return t.orders.orderBy("o_orderdate", "o_orderkey").limit(1000).select(
        "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("micros"))


@query("P7_id_range_or_set", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 700 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def _(t: Tables):
    wanted = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.where("o_custkey >= 700").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("P8_complete_records", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_tax > 0 AND l_discount > 0""")
def _(t: Tables):
    text = lambda c: F.when(F.col(c) > 0, F.col(c).cast("string")).otherwise(F.lit("bad")).try_cast("double")
    rec = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text("l_tax").alias("a"), text("l_discount").alias("b"))
    return rec.dropna(subset=["a", "b"]).drop("a", "b")


def messages(t: Tables):
    """lineitem orders as conjunction events: a few messages each, with unknown and zero values."""
    q, p, d, x = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    ln, pk = F.col("l_linenumber"), F.col("l_partkey")
    return t.lineitem.select(
        F.col("l_orderkey").alias("event_id"), "l_linenumber", "l_partkey", p.alias("price"), q.alias("qty"),
        (F.dayofmonth("l_shipdate") / F.lit(10.0)).alias("time_to_tca"),
        (-p / F.lit(10000.0)).alias("risk"), (q * 100).alias("miss_distance"),
        F.when(ln != 5, p / F.lit(1000.0)).alias("mahalanobis_distance"), (q - 25).alias("relative_position_r"),
        d.alias("relative_position_t"), (x * 10).alias("relative_position_n"), (x * 100 + 1).alias("t_sigma_r"),
        F.when(ln % 3 != 1, d * 50 + 1).alias("c_sigma_r"), (x * d).alias("t_position_covariance_det"),
        F.when(ln != 2, -x * q).alias("c_position_covariance_det"), (pk % 50).cast("double").alias("t_obs_used"),
        (pk % 37).cast("double").alias("c_obs_used"), x.alias("t_weighted_rms"), (d + 1).alias("c_weighted_rms"),
        (q / F.lit(7.0)).alias("c_actual_od_span"), F.lit(0.0).alias("t_time_lastob_end"), d.alias("c_time_lastob_end"))


MESSAGE_TIE = ["l_linenumber", "l_partkey", "price", "qty"]

MSG = """msg AS (
  SELECT l_orderkey AS event_id, l_linenumber, l_partkey, l_extendedprice AS price, l_quantity AS qty,
    day(l_shipdate) / CAST(10 AS DOUBLE) AS time_to_tca, -l_extendedprice / CAST(10000 AS DOUBLE) AS risk, l_quantity * 100 AS miss_distance,
    CASE WHEN l_linenumber <> 5 THEN l_extendedprice / CAST(1000 AS DOUBLE) END AS mahalanobis_distance, l_quantity - 25 AS relative_position_r,
    l_discount AS relative_position_t, l_tax * 10 AS relative_position_n, l_tax * 100 + 1 AS t_sigma_r,
    CASE WHEN l_linenumber % 3 <> 1 THEN l_discount * 50 + 1 END AS c_sigma_r, l_tax * l_discount AS t_position_covariance_det,
    CASE WHEN l_linenumber <> 2 THEN -l_tax * l_quantity END AS c_position_covariance_det, CAST(l_partkey % 50 AS DOUBLE) AS t_obs_used,
    CAST(l_partkey % 37 AS DOUBLE) AS c_obs_used, l_tax AS t_weighted_rms, l_discount + 1 AS c_weighted_rms,
    l_quantity / CAST(7 AS DOUBLE) AS c_actual_od_span, CAST(0 AS DOUBLE) AS t_time_lastob_end, l_discount AS c_time_lastob_end
  FROM lineitem)"""


@query("P9_event_horizon", f"WITH {MSG} SELECT event_id, count(*) AS n FROM msg WHERE time_to_tca <= 2 GROUP BY event_id")
def _(t: Tables):
    return conjunction.near_event(messages(t)).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("P9_excluded_events", f"WITH {MSG} SELECT event_id FROM msg GROUP BY event_id HAVING min(time_to_tca) > 2")
def _(t: Tables):
    return conjunction.excluded_events(messages(t))


@query("P10_post_event_cut", f"""
WITH {EV}, last AS (SELECT user_id, max(t) - 5 AS te FROM ev GROUP BY user_id)
SELECT event_id, {R('te - t')} AS rul FROM ev JOIN last USING (user_id) WHERE te - t >= 0""")
def _(t: Tables):
    h = t.history()
    ends = h.groupBy("user_id").agg((F.max("t") - 5).alias("te"))
    return orbits.remaining(h.join(ends, "user_id"), "te", "t").select("event_id", r("rul").alias("rul"))


@query("P11_finite_or_zero", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 OR l_discount = 0 THEN CAST(0 AS DOUBLE) ELSE {R('l_discount / l_tax')} END AS z FROM lineitem""")
def _(t: Tables):
    d, x = F.col("l_discount"), F.col("l_tax")
    z = F.when(x == 0, F.lit(float("inf"))).when(d == 0, F.lit(float("nan"))).otherwise(d / x)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r(X.finite_or_zero(z)).alias("z"))


@query("P12_fill_gaps", """
WITH g AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate, CASE WHEN l_linenumber % 3 = 0 THEN l_discount END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, coalesce(
  last_value(x IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(x IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS filled
FROM g WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)""")
def _(t: Tables):
    g = t.supply().withColumn("x", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_discount")))
    out = W.fill_gaps(g, ["l_suppkey"], SUPPLY_ORDER, "x", "filled", rows=t.rows("lineitem"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "filled")


@query("P13_log_magnitude", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN CAST(-30 AS DOUBLE) ELSE {R('log10(abs(-l_tax))')} END AS x FROM lineitem""")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r(X.log10_magnitude(-F.col("l_tax"))).alias("x"))


@query("P14_valid_values", """
SELECT l_linenumber, count(*) FILTER (l_tax > 0 AND l_discount > 0) AS valid, count(*) AS n FROM lineitem GROUP BY l_linenumber""")
def _(t: Tables):
    z = F.when(F.col("l_tax") == 0, float("inf")).when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_tax"))
    return t.lineitem.groupBy("l_linenumber").agg(F.count_if(X.is_valid(z)).alias("valid"), F.count(F.lit(1)).alias("n"))


@query("P15_clip", f"""
WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(least(n - 1 - pos, 125) AS BIGINT) AS rul FROM li""")
def _(t: Tables):
    out = O.with_position(t.supply(), ["l_suppkey"], SUPPLY_ORDER, rows=t.rows("lineitem"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                      big(F.least(F.col("n") - 1 - F.col("pos"), F.lit(125))).alias("rul"))


CRUISE = f"""{LI}, f AS (SELECT *, l_extendedprice AS alt, l_quantity AS tra FROM li),
roll AS (SELECT *, CASE WHEN n <= 50 THEN stddev_pop(tra) OVER (PARTITION BY l_suppkey)
    WHEN pos < 50 THEN max(CASE WHEN pos = 50 THEN s END) OVER (PARTITION BY l_suppkey) ELSE s END AS sp
  FROM (SELECT *, stddev_pop(tra) OVER (PARTITION BY l_suppkey ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS s FROM f)),
m AS (SELECT *, alt > 30000 AS high, sp < 14.43 AND alt > 30000 AS steady FROM roll),
cm AS (SELECT *, CASE WHEN count(*) FILTER (steady) OVER (PARTITION BY l_suppkey) >= 250 THEN steady
    WHEN count(*) FILTER (high) OVER (PARTITION BY l_suppkey) >= 350 THEN high ELSE true END AS cruise FROM m)"""


def _cruise(t: Tables):
    f = t.supply().withColumns({"alt": F.col("l_extendedprice"), "tra": F.col("l_quantity")})
    # thresholds fit the stand-in columns
    return flights.cruise_mask(f, ["l_suppkey"], SUPPLY_ORDER, std_max=14.43, alt_min=30000.0, least=250,
                               rows=t.rows("lineitem"))


@query("P16_cruise_mask", f"""WITH {CRUISE.replace('>= 350', '>= 250')}
SELECT l_suppkey, count(*) FILTER (cruise) AS n_cruise, count(*) AS n, {R('sum(CASE WHEN cruise THEN pos ELSE 0 END)')} AS where_sum FROM cm GROUP BY l_suppkey""")
def _(t: Tables):
    c = F.col("cruise")
    return _cruise(t).groupBy("l_suppkey").agg(F.count_if(c).alias("n_cruise"), F.count(F.lit(1)).alias("n"),
                                               r(F.sum(F.when(c, F.col("pos")).otherwise(0))).alias("where_sum"))


@query("W11_cycle_means", f"""WITH {CRUISE.replace('>= 350', '>= 250')}
SELECT l_suppkey, {R('avg(l_discount) FILTER (cruise)')} AS l_discount, {R('avg(l_tax) FILTER (cruise)')} AS l_tax,
  {R('avg(alt) FILTER (cruise)', 3)} AS alt, arg_min(l_partkey, pos) AS l_partkey FROM cm GROUP BY l_suppkey""")
def _(t: Tables):
    out = flights.per_cycle(_cruise(t), ["l_suppkey"], "pos", ["l_discount", "l_tax", "alt"], ["l_partkey"])
    return out.select("l_suppkey", r("l_discount").alias("l_discount"), r("l_tax").alias("l_tax"), r("alt", 3).alias("alt"), "l_partkey")


# ---- L: labels and keys -------------------------------------------------------


@query("L1_life_from_last_cycle", f"""
WITH {EV} SELECT event_id, {R('max(t) OVER (PARTITION BY user_id) - t')} AS rul FROM ev""")
def _(t: Tables):
    h = O.per_group(t.history(), ["user_id"], {"last": F.max("t")}, rows=t.rows("events"))
    return h.select("event_id", r(F.col("last") - F.col("t")).alias("rul"))


@query("L2_life_in_steps", f"WITH {EV} SELECT event_id, CAST(least(n - 1 - pos, 40) AS BIGINT) AS rul FROM ev")
def _(t: Tables):
    h = O.with_position(t.history(), ["user_id"], ["t", "event_id"], rows=t.rows("events"))
    return h.select("event_id", big(F.least(F.col("n") - 1 - F.col("pos"), F.lit(40))).alias("rul"))


@query("L3_L4_time_to_event", f"""
WITH {EV}, last AS (SELECT user_id, max(t) AS te FROM ev GROUP BY user_id)
SELECT event_id, {R('te - t')} AS rul, CAST(te - t <= 7 AS INTEGER) AS label FROM ev JOIN last USING (user_id)""")
def _(t: Tables):
    h = t.history()
    out = orbits.remaining(h.join(h.groupBy("user_id").agg(F.max("t").alias("te")), "user_id"), "te", "t")
    return out.select("event_id", r("rul").alias("rul"), F.when(F.col("rul") <= 7, 1).otherwise(0).alias("label"))


@query("L5_two_populations", f"""
WITH {EV}, o AS (SELECT user_id, max(t) AS te, count(*) FILTER (event_type = 'error') > 14 AS has_event FROM ev GROUP BY user_id)
SELECT event_id, CASE WHEN NOT has_event THEN 0 WHEN te - t <= 3 THEN 1 ELSE -1 END AS label FROM ev JOIN o USING (user_id)""")
def _(t: Tables):
    h = t.history()
    o = h.groupBy("user_id").agg(F.max("t").alias("te"), (F.count_if(F.col("event_type") == "error") > 14).alias("has_event"))
    label = orbits.two_population_label(F.col("has_event"), F.col("te") - F.col("t"), 3.0)
    return h.join(o, "user_id").select("event_id", label.alias("label"))


@query("L6_final_risk_label", f"""
WITH {MSG}, f AS (SELECT event_id, arg_max(risk, (-time_to_tca, l_linenumber, l_partkey, price, qty)) AS risk FROM msg GROUP BY event_id)
SELECT event_id, {R("CASE WHEN o_orderstatus = $$F$$ THEN -o_totalprice / 100000 ELSE risk END", 7)} AS final_risk,
  CAST((CASE WHEN o_orderstatus = 'F' THEN -o_totalprice / 100000 ELSE risk END) >= -5 AS INTEGER) AS label
FROM f LEFT JOIN orders ON o_orderkey = event_id""")
def _(t: Tables):
    m = messages(t)
    order = [-F.col("time_to_tca"), *[F.col(c) for c in MESSAGE_TIE]]
    last = conjunction.final_values(m, "event_id", order, ["risk"])
    private = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"), (-F.col("o_totalprice") / 100000).alias("true_risk"))
    final = F.coalesce("true_risk", "risk")
    return last.join(private, "event_id", "left").select("event_id", r(final, 7).alias("final_risk"), F.when(final >= -5, 1).otherwise(0).alias("label"))


@query("L7_life_buckets", """
SELECT p_partkey, least(greatest(CAST(floor((p_size * 3 - 10) / (CAST(125 AS DOUBLE) / 6)) AS INTEGER), 0), 5) AS bucket FROM part""")
def _(t: Tables):
    return t.part.select("p_partkey", X.width_bucket_clipped(F.col("p_size") * 3 - 10, 125.0, 6).alias("bucket"))


@query("L8_data_thresholds", f"""
WITH {LI}, q AS (SELECT CAST(floor(quantile_cont(CAST(n - 1 - pos AS DOUBLE), CAST(0.95 AS DOUBLE))) AS INTEGER) AS clip FROM li)
SELECT clip, CAST(round_even(clip * CAST(0.2 AS DOUBLE), 0) AS INTEGER) AS basin, CAST(round_even(clip * CAST(0.4 AS DOUBLE), 0) AS INTEGER) AS warning FROM q""")
def _(t: Tables):
    n = t.rows("lineitem")
    h = O.with_position(t.supply(), ["l_suppkey"], SUPPLY_ORDER, rows=n)
    return calibrate.data_thresholds(h.withColumn("rul", (F.col("n") - 1 - F.col("pos")).cast("double")), "rul", rows=n)


@query("L9_object_class", """
SELECT o_custkey, epoch_us(max(o_orderdate)) AS last_epoch, count(*) AS n_records,
  CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') > 0 THEN 'reentry'
       WHEN max(o_orderdate) >= TIMESTAMP '2000-06-01' THEN 'operational' ELSE 'ambiguous' END AS class
FROM orders GROUP BY o_custkey""")
def _(t: Tables):
    o = t.orders.withColumn("decay", F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), F.col("o_orderdate")))
    out = Rl.classify_objects(o, "o_custkey", "o_orderdate", "decay", "2000-06-01")
    return out.withColumn("last_epoch", F.unix_micros(F.col("last_epoch").cast("timestamp")))


@query("L10_latest_attributes", """
SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'F') AS priority,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'O') AS price FROM orders GROUP BY o_custkey""")
def _(t: Tables):
    s = F.col("o_orderstatus")
    o = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", F.when(s != "F", F.col("o_orderpriority")).otherwise("").alias("priority"),
                        F.when(s == "O", F.col("o_totalprice")).alias("price"))
    return Rl.latest_known(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["priority", "price"])


@query("L11_holdout_by_designator", """
WITH o AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus <> 'F') AS designator, max(o_orderkey) AS last_key FROM orders GROUP BY o_custkey)
SELECT o_custkey, designator FROM o WHERE starts_with(designator, '2-H') AND DATE '1990-01-01' + CAST(last_key % 7000 AS INTEGER) <= DATE '2000-06-30'""")
def _(t: Tables):
    o = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).otherwise("").alias("designator"))
    first = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_key"))
    # the epoch only has to rise with the key inside an object; its last value decides
    dated = o.join(first, "o_custkey").withColumn("epoch", F.when(
        F.col("o_orderkey") == F.col("last_key"), F.expr("date_add(date'1990-01-01', int(last_key % 7000))").cast("timestamp")).otherwise(
        F.timestamp_micros(F.col("o_orderkey"))))
    return Rl.holdout_objects(dated, "o_custkey", "designator", "epoch", "2-H", "2000-06-30").select("o_custkey", "designator")


@query("L12_altitude_bands", """
SELECT year(o_orderdate) AS onset, CASE WHEN o_totalprice / 1000 < 350 THEN 'low' WHEN o_totalprice / 1000 < 400 THEN 'middle' ELSE 'high' END AS band,
  count(*) AS n FROM orders GROUP BY ALL""")
def _(t: Tables):
    alt = F.col("o_totalprice") / 1000
    band = F.when(alt < 350, "low").when(alt < 400, "middle").otherwise("high")
    return t.orders.groupBy(big(F.year("o_orderdate")).alias("onset"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("L13_excursion_class", """
SELECT p_partkey, CASE WHEN p_size < 5 THEN 'brief' WHEN p_size <= 20 THEN 'medium' ELSE 'long' END AS class FROM part""")
def _(t: Tables):
    n = F.col("p_size")
    return t.part.select("p_partkey", F.when(n < 5, "brief").when(n <= 20, "medium").otherwise("long").alias("class"))


# ---- J: joins and set relations -----------------------------------------------


@query("J1_object_attributes", f"""
WITH {EV}, o AS (SELECT user_id, max(t) AS te, mode() WITHIN GROUP (ORDER BY event_type) AS kind FROM ev GROUP BY user_id)
SELECT event_id, {R('te')} AS te FROM ev JOIN o USING (user_id)""")
def _(t: Tables):
    h = t.history()
    return h.join(h.groupBy("user_id").agg(F.max("t").alias("te")), "user_id").select("event_id", r("te").alias("te"))


@query("J2_truth_join", f"""
WITH {EV}, f AS (SELECT user_id, arg_max(v, pos) AS d_final FROM ev GROUP BY user_id)
SELECT user_id, {R('d_final')} AS d_final, {R('c_acctbal', 2)} AS true_rul FROM f JOIN customer ON c_custkey = user_id""")
def _(t: Tables):
    f = t.history().groupBy("user_id").agg(F.max_by("v", F.struct("t", "event_id")).alias("d_final"))
    truth = t.customer.select(F.col("c_custkey").alias("user_id"), r("c_acctbal", 2).alias("true_rul"))
    return f.join(truth, "user_id").select("user_id", r("d_final").alias("d_final"), "true_rul")


@query("J3_missing_labels", """
SELECT count(*) AS n_documents, count(*) FILTER (quality IS NULL) AS n_missing, sum(quality) AS n_good FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t: Tables):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("quality").isNull()).alias("n_missing"), F.sum("quality").alias("n_good"))


@query("J4_identity_sets", """
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_id % 7 < 3 AND user_id % 3 > 0), b AS (SELECT DISTINCT user_id FROM events WHERE NOT (event_id % 7 < 3) AND user_id % 4 > 0)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'first' WHEN a.user_id IS NULL THEN 'second' ELSE 'both' END AS side
FROM a FULL JOIN b ON a.user_id = b.user_id""")
def _(t: Tables):
    first = F.col("event_id") % 7 < 3
    return Rl.set_relations(t.events.where(first & (F.col("user_id") % 3 > 0)), t.events.where(~first & (F.col("user_id") % 4 > 0)), "user_id")


def _two_sources(t: Tables):
    e = t.history()
    return e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1 OR event_id % 10 = 0")


@query("J5_duplicate_rows", """
SELECT event_id FROM events WHERE event_id % 10 = 0""")
def _(t: Tables):
    a, b = _two_sources(t)
    return Rl.duplicated_rows(a, b, "user_id", ["user_id", "event_id", "t", "v", "k"]).select("event_id")


@query("J11_interleaving", f"""
WITH {EV}, a AS (SELECT user_id, max(t) AS x FROM ev WHERE event_type = 'error' GROUP BY user_id), b AS (SELECT user_id, min(t) AS y FROM ev WHERE event_type <> 'error' GROUP BY user_id)
SELECT user_id, {R('x')} AS max_first, {R('y')} AS min_second, CASE WHEN x < y THEN 'clean' ELSE 'interleaved' END AS pattern FROM a JOIN b USING (user_id)""")
def _(t: Tables):
    h = t.history()
    out = Rl.interleaving(h.where("event_type = 'error'"), h.where("event_type <> 'error'"), "user_id", "t")
    return out.withColumns({c: r(c) for c in ("max_first", "min_second")})


@query("J10_identity_leak", """
WITH s AS (SELECT user_id, substr(md5(user_id || ':42'), 1, 1) < '8' AS train FROM (SELECT DISTINCT user_id FROM events))
SELECT count(*) AS n_train, (SELECT count(*) FROM s WHERE NOT train) AS n_test, CAST(0 AS BIGINT) AS n_shared FROM s WHERE train""")
def _(t: Tables):
    ids = t.events.select("user_id").distinct()
    train = F.substring(F.md5(F.concat(F.col("user_id").cast("string"), F.lit(":42"))), 1, 1) < "8"
    sides = Rl.set_relations(ids.where(train), ids.where(~train), "user_id")
    n = lambda s: F.count_if(F.col("side") == s)
    return sides.agg(n("first").alias("n_train"), n("second").alias("n_test"), n("both").alias("n_shared"))


@query("J12_holdout_removal", """
SELECT user_id, count(*) AS n, user_id IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 18) AS held_out FROM events GROUP BY user_id""")
def _(t: Tables):
    hold = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("m")).where("m > 18").select("user_id")
    marked = t.events.select("user_id").join(hold.withColumn("_held", F.lit(True)), "user_id", "left")
    return marked.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("_held"), F.lit(False)).alias("held_out"))


# ---- T: set operations and splits ---------------------------------------------


@query("T1_union_datasets", """
SELECT 'error' AS dataset, event_id, value AS v FROM events WHERE event_type = 'error' UNION ALL SELECT 'other', event_id, value FROM events WHERE event_type <> 'error'""")
def _(t: Tables):
    part = lambda k, rows: rows.select(F.lit(k).alias("dataset"), "event_id", F.col("value").alias("v"))
    return part("error", t.events.where("event_type = 'error'")).unionByName(part("other", t.events.where("event_type <> 'error'")))


@query("T2_interleave_sources", """
SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS source, epoch_us(ts) AS micros FROM events""")
def _(t: Tables):
    e = t.events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    both = Rl.interleave({"first": e.where("event_id % 2 = 0"), "second": e.where("event_id % 2 = 1")})
    return both.orderBy("user_id", F.desc("micros"), "event_id")


@query("T3_monotonicity", f"""
WITH {LI}, g AS (SELECT *, lag(day) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS b,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS p FROM li)
SELECT l_suppkey, min(p) FILTER (day <= b) AS violation_pos, arg_min(CASE WHEN day = b THEN 'duplicate' ELSE 'reversal' END, p) FILTER (day <= b) AS violation FROM g GROUP BY l_suppkey""")
def _(t: Tables):
    return Rl.monotonicity(t.supply(), "l_suppkey", "day", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"],
                           rows=t.rows("lineitem"))


@query("T4_append_dedupe", """
WITH u AS (SELECT *, 1 AS load_no FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, ts, user_id, event_type, value + 1, props, 2 FROM events)
SELECT user_id, event_id, load_no, round(value, 6) AS v FROM u QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY load_no) = 1""")
def _(t: Tables):
    old = t.events.where("event_id % 2 = 0").withColumn("load_no", F.lit(1))
    new = t.events.withColumn("value", F.col("value") + 1).withColumn("load_no", F.lit(2))
    out = Rl.dedupe(old.unionByName(new), ["user_id", "ts"], "load_no", ["event_id"])
    return out.select("user_id", "event_id", "load_no", F.round("value", 6).alias("v"))


@query("T5_distinct_identities", "SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def _(t: Tables):
    return t.events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias("n_users"))


SPLIT = """WITH i AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id || ':42'), user_id) - 1 AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, CASE WHEN rk < least(200, floor(n * CAST(0.8 AS DOUBLE))) THEN 'train' ELSE 'test' END AS split FROM i"""


@query("T6_identity_split", SPLIT)
def _(t: Tables):
    return Rl.split_identities(t.events.select("user_id"), "user_id", rows=t.rows("events"))


@query("K7_identity_lists", f"SELECT split, count(*) AS n, sum(user_id)::BIGINT AS id_sum FROM ({SPLIT}) GROUP BY split")
def _(t: Tables):
    s = Rl.split_identities(t.events.select("user_id"), "user_id", rows=t.rows("events"))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("id_sum"))


@query("T7_stratified_split", """
WITH i AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':42'), c_custkey) - 1 AS rk, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, c_mktsegment, CASE WHEN rk < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM i""")
def _(t: Tables):
    return Rl.split_stratified(t.customer, "c_custkey", "c_mktsegment", rows=t.rows("customer"))


@query("T8_seeded_sample", "SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':7'), c_custkey LIMIT 100")
def _(t: Tables):
    return Rl.sample_identities(t.customer, "c_custkey", 100, seed=7)


@query("T9_leave_one_out", f"""
WITH {EV}, f AS (SELECT DISTINCT user_id AS fold FROM ev)
SELECT fold AS user_id, count(*) AS n_train, (SELECT count(*) FROM ev x WHERE x.user_id = fold) AS n_test, {R('avg(v)')} AS v_mean, {R('stddev_pop(v)')} AS v_std
FROM f JOIN ev ON ev.user_id <> fold GROUP BY fold""")
def _(t: Tables):
    out = Rl.leave_out_means(t.history(), "user_id", ["v"])
    return out.select("user_id", "n_train", "n_test", r("v_mean").alias("v_mean"), r("v_std").alias("v_std"))


@query("T10_group_holdout", f"""
WITH c AS (SELECT n_regionkey, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey), f AS (SELECT DISTINCT n_regionkey AS fold FROM c)
SELECT fold AS n_regionkey, count(*) AS n_train, {R('avg(c_acctbal)')} AS c_acctbal_mean, {R('stddev_pop(c_acctbal)', 5)} AS c_acctbal_std FROM f JOIN c ON c.n_regionkey <> fold GROUP BY fold""")
def _(t: Tables):
    c = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    out = Rl.leave_out_means(c, "n_regionkey", ["c_acctbal"])
    return out.select("n_regionkey", "n_train", r("c_acctbal_mean").alias("c_acctbal_mean"), r("c_acctbal_std", 5).alias("c_acctbal_std"))


_PAIRS = [("error", "click"), ("view", "purchase")]


@query("T11_cross_folds", f"""
WITH p(pair, a, b) AS (VALUES ('error+click', 'error', 'click'), ('view+purchase', 'view', 'purchase')),
s AS (SELECT pair, a, b, avg(value) AS m, stddev_pop(value) AS sd FROM p JOIN events ON event_type IN (a, b) GROUP BY ALL)
SELECT pair, event_type AS dataset, event_type NOT IN (a, b) AS held_out, count(*) AS n, {R('avg((value - m) / sd)')} AS z_mean FROM s JOIN events ON true GROUP BY ALL""")
def _(t: Tables):
    # the deviation is linear in the value: one aggregate per data set gives the statistics of every pair and every mean
    own = t.events.groupBy(F.col("event_type").alias("dataset")).agg(F.count("value").alias("n"), F.avg("value").alias("a"), F.var_pop("value").alias("v"))
    member = F.explode(F.array(*[F.struct(F.lit("+".join(p)).alias("pair"), F.lit(d).alias("of")) for p in _PAIRS for d in p]))
    inside = own.withColumn("p", member).where("p.of = dataset").select("p.pair", "dataset", "n", "a", "v")
    fit = inside.groupBy("pair").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("a")).alias("_s"), F.sum(F.col("n") * (F.col("v") + F.col("a") * F.col("a"))).alias("_q"))
    m = F.col("_s") / F.col("_n")
    both = own.crossJoin(F.broadcast(fit)).join(inside.select("pair", "dataset", F.lit(False).alias("_held")), ["pair", "dataset"], "left")     # one row per pair
    return both.select("pair", "dataset", F.coalesce("_held", F.lit(True)).alias("held_out"), "n", r((F.col("a") - m) / F.sqrt(F.col("_q") / F.col("_n") - m * m)).alias("z_mean"))


@query("T12_row_accounting", """
SELECT count(*) AS rows_in, count(*) AS rows_out, true AS balanced FROM events""")
def _(t: Tables):
    e = t.events
    return Rl.row_accounting([e], [e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")])


# ---- O: orders and limits -----------------------------------------------------


@query("O1_object_order", f"WITH {LI} SELECT l_suppkey, pos, l_orderkey, l_linenumber, l_partkey FROM li")
def _(t: Tables):
    out = O.with_position(t.supply(), ["l_suppkey"], SUPPLY_ORDER, rows=t.rows("lineitem"), size=None)
    return out.select("l_suppkey", "pos", "l_orderkey", "l_linenumber", "l_partkey")


@query("O2_global_order", "SELECT user_id, event_id, round(value, 6) AS v FROM events ORDER BY user_id, ts, event_id")
def _(t: Tables):
    return t.events.orderBy("user_id", "ts", "event_id").select("user_id", "event_id", F.round("value", 6).alias("v"))


@query("O3_numeric_id_order", "SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier ORDER BY s_suppkey")
def _(t: Tables):
    return t.supplier.select(F.col("s_suppkey").cast("string").alias("id")).orderBy(F.col("id").cast("int"))


@query("O6_first_best", """
SELECT event_type, arg_min(event_id, (-value, event_id)) AS best, round(max(value), 6) AS v FROM events GROUP BY event_type""")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"),
                                              F.round(F.max("value"), 6).alias("v"))


@query("E11_smallest_remaining", """
SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5""")
def _(t: Tables):
    return t.customer.orderBy("c_acctbal", "c_custkey").limit(5).select("c_custkey", "c_acctbal")


# ---- fits per fold: closed form of two features --------------------------------

def _fit_sql(rows: str, by: str) -> str:
    """w and cut of the two-feature discriminant over `rows` (by, y, a, b)."""
    return f"""mo AS (SELECT {by}, avg(a) FILTER (y = 0) AS a0, avg(a) FILTER (y = 1) AS a1, avg(b) FILTER (y = 0) AS b0, avg(b) FILTER (y = 1) AS b1,
  (var_pop(a) FILTER (y = 0) * count(*) FILTER (y = 0) + var_pop(a) FILTER (y = 1) * count(*) FILTER (y = 1)) / count(*) AS saa,
  (var_pop(b) FILTER (y = 0) * count(*) FILTER (y = 0) + var_pop(b) FILTER (y = 1) * count(*) FILTER (y = 1)) / count(*) AS sbb,
  (covar_pop(a, b) FILTER (y = 0) * count(*) FILTER (y = 0) + covar_pop(a, b) FILTER (y = 1) * count(*) FILTER (y = 1)) / count(*) AS sab FROM {rows} GROUP BY {by}),
u AS (SELECT *, sbb * (a1 - a0) - sab * (b1 - b0) AS ua, saa * (b1 - b0) - sab * (a1 - a0) AS ub, saa * sbb - sab * sab AS det FROM mo),
fit AS (SELECT {by}, sign(det) * ua / sqrt(ua * ua + ub * ub) AS wa, sign(det) * ub / sqrt(ua * ua + ub * ub) AS wb,
  sign(det) * (ua * (a0 + a1) + ub * (b0 + b1)) / 2 / sqrt(ua * ua + ub * ub) AS cut FROM u)"""


_COUNTS = "count(*) FILTER (hit AND y = 1) AS tp, count(*) FILTER (hit AND y = 0) AS fp, count(*) FILTER (NOT hit AND y = 1) AS fn, count(*) FILTER (NOT hit AND y = 0) AS tn"


def _fold_report(rows, fits, key: str, on: str, features, by):
    from driftline.models import evaluate, folds

    held = rows.join(fits.withColumnRenamed(on, "_f"), rows[key] == F.col("_f"))
    return evaluate.confusion(held, folds.fired(features), F.col("y") == 1, by)


@query("T9_fits_without_one_object", f"""
WITH {EV}, e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, v AS a, k AS b FROM ev), o AS (SELECT f.user_id AS fold, e.y, e.a, e.b FROM (SELECT DISTINCT user_id FROM e) f JOIN e ON e.user_id <> f.user_id),
{_fit_sql('o', 'fold')}, s AS (SELECT fold, y, wa * a + wb * b > cut AS hit FROM fit JOIN e ON e.user_id = fold),
c AS (SELECT fold, {_COUNTS} FROM s GROUP BY fold)
SELECT fold AS user_id, {R('wa')} AS w_v, {R('wb')} AS w_k, {R('cut', 5)} AS cut, tp, fp, fn, tn FROM fit JOIN c USING (fold)""")
def _(t: Tables):
    from driftline.models import folds

    e = t.history().select("user_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"), "v", "k")
    fits = folds.leave_one_out_fits(folds.fold_moments(e, "user_id", F.col("y"), ["v", "k"]), "user_id", 2)
    counts = _fold_report(e, fits, "user_id", "user_id", ["v", "k"], ["user_id"])
    return fits.join(counts, "user_id").select("user_id", r(F.get("w", F.lit(0))).alias("w_v"), r(F.get("w", F.lit(1))).alias("w_k"), r("cut", 5).alias("cut"), "tp", "fp", "fn", "tn")


@query("T10_fits_without_one_group", f"""
WITH e AS (SELECT l_linenumber AS g, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS y, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b FROM lineitem),
o AS (SELECT f.g AS fold, e.y, e.a, e.b FROM (SELECT DISTINCT g FROM e) f JOIN e ON e.g <> f.g),
{_fit_sql('o', 'fold')}, s AS (SELECT fold, y, wa * a + wb * b > cut AS hit FROM fit JOIN e ON e.g = fold), c AS (SELECT fold, {_COUNTS} FROM s GROUP BY fold)
SELECT fold AS g, {R('wa')} AS w_a, {R('wb')} AS w_b, {R('cut', 5)} AS cut, tp, fp, fn, tn FROM fit JOIN c USING (fold)""")
def _(t: Tables):
    from driftline.models import folds

    e = t.lineitem.select(F.col("l_linenumber").alias("g"), F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("y"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    fits = folds.leave_one_out_fits(folds.fold_moments(e, "g", F.col("y"), ["a", "b"]), "g", 2)
    counts = _fold_report(e, fits, "g", "g", ["a", "b"], ["g"])
    return fits.join(counts, "g").select("g", r(F.get("w", F.lit(0))).alias("w_a"), r(F.get("w", F.lit(1))).alias("w_b"), r("cut", 5).alias("cut"), "tp", "fp", "fn", "tn")


@query("T11_pair_fits", f"""
WITH {EV}, e AS (SELECT event_type AS g, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS y, v AS a, k AS b FROM ev),
p(pair, g) AS (VALUES ('error+click', 'error'), ('error+click', 'click'), ('view+purchase', 'view'), ('view+purchase', 'purchase')), o AS (SELECT pair, y, a, b FROM p JOIN e USING (g)),
{_fit_sql('o', 'pair')}, s AS (SELECT pair, g, y, wa * a + wb * b > cut AS hit FROM fit JOIN e ON true)
SELECT pair, g AS dataset, (pair, g) NOT IN (SELECT (pair, g) FROM p) AS held_out, {_COUNTS} FROM s GROUP BY pair, g""")
def _(t: Tables):
    from driftline.models import evaluate, folds

    groups = {"+".join(p): p for p in _PAIRS}
    e = t.history().select(F.col("event_type").alias("dataset"), F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("y"), "v", "k")
    fits = folds.group_fits(folds.fold_moments(e, "dataset", F.col("y"), ["v", "k"]), "dataset", groups, 2)
    both = e.crossJoin(F.broadcast(fits.withColumnRenamed("fit", "pair")))               # one row per group of data sets
    inside = F.lit(False)
    for g, of in groups.items():
        inside = inside | ((F.col("pair") == g) & F.col("dataset").isin(*of))
    return evaluate.confusion(both.withColumn("held_out", ~inside), folds.fired(["v", "k"]), F.col("y") == 1, ["pair", "dataset", "held_out"])
