"""Whole domain studies on the stand-in histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog import features as C
from driftline.models import evaluate
from driftline.operators.ordering import with_position
from driftline.plans import conjunction, domains as D, orbits, studies
from driftline.registry.base import LI, R, SUPPLY_ORDER, Tables, query, r, windows_sql
from driftline.registry.records import MESSAGE_TIE, _fit_sql, messages
from driftline.registry.windowed import elements
from driftline.session import materialise

LIFE = D.Setting(30, 5, 5, 300.0, 60.0, 120.0)


def life_windows(t: Tables):
    rul = F.least(F.col("n") - 1 - F.col("pos"), F.lit(300)).cast("double")
    w, names = D.monitoring_vectors(t.supply(), ["l_suppkey"], SUPPLY_ORDER, ["l_quantity", "l_discount", "l_tax"], LIFE,
                                    {"rul": rul}, rows=t.rows("lineitem"))
    return materialise(w), names


@query("flow_life_monitor")
def _(t: Tables):
    n = t.rows("lineitem")
    w, names = life_windows(t)
    fitted = D.fit_life_monitor(w.where("l_suppkey % 5 <> 0"), names, LIFE, rows=n)
    # test histories end early, each at its own share of its length
    scored = fitted.model.written(w.where("l_suppkey % 5 = 0"))
    ends = scored.groupBy("l_suppkey").agg(F.max("win").alias("_end"))
    test = scored.join(ends, "l_suppkey").where("win <= _end * (0.5 + (l_suppkey % 7) * 0.07)").drop("_end")
    truth = test.groupBy("l_suppkey").agg(F.min("rul").alias("true_rul"))
    best = D.held_out_sweep(fitted, test, "l_suppkey", "win", truth, LIFE.warning)
    report = D.life_report(fitted, LIFE, 60.0, rows=n)
    return evaluate._beside(report, best.select(F.col("f1").alias("held_out_f1"), "precision", "recall"))


@query("flow_decay_monitor")
def _(t: Tables):
    n = t.rows("lineitem")
    s = t.supply().withColumns({"p": F.col("l_quantity"), "m": F.col("l_discount")})
    w = orbits.decay_windows(s, "l_suppkey", SUPPLY_ORDER, time="day", channels=["p", "m"], rows=n)
    ends = s.groupBy("l_suppkey").agg(F.max("day").alias("te"))
    w = orbits.remaining(w.join(ends, "l_suppkey"), "te", "day")
    event = F.col("l_suppkey") % 3 == 0
    w = materialise(w.withColumn("label", orbits.two_population_label(event, F.col("rul"), 200.0)))
    names = [f for f, _, _ in C.decay_catalogue(["p", "m"])]
    weights = {f: C.DECAY_CLASS_WEIGHTS[k] for f, k, _ in C.decay_catalogue(["p", "m"])}
    train, test = w.where("l_suppkey % 2 = 0"), w.where("l_suppkey % 2 = 1")
    fitted = D.fit_labelled_monitor(train, names, weights, 5, D.operational_threshold(rows=n), tightened=True)
    conf = D.validate_sustained(fitted, test, "l_suppkey", ["win"], "rul", event, rows=n)
    return evaluate.with_intervals(evaluate.with_rates(conf))


@query("flow_approach_monitor")
def _(t: Tables):
    n = t.rows("lineitem")
    w = orbits.asteroid_windows(elements(t), "l_suppkey", SUPPLY_ORDER, rows=n)
    ends = elements(t).groupBy("l_suppkey").agg(F.max("jd").alias("te"))
    w = orbits.remaining(w.join(ends, "l_suppkey"), "te", "jd")
    w = materialise(w.withColumn("label", F.when(F.col("rul") <= 90, 1).otherwise(0)))
    fitted = D.fit_labelled_monitor(w, list(C.ASTEROID_WEIGHTS), C.ASTEROID_WEIGHTS, 5, D.best_f1_threshold(rows=n))
    return fitted.train.select("l_suppkey", "win", "rul", "label", "proj", "d_mean", F.lit(fitted.epsilon).alias("epsilon"))


@query("flow_conjunction_models")
def _(t: Tables):
    n = t.rows("lineitem")
    ev = materialise(conjunction.event_features(messages(t), tie=MESSAGE_TIE, rows=n))
    train, test = ev.where("event_id % 4 <> 0"), ev.where("event_id % 4 = 0")
    out = None
    for name, weights in (("all", C.CONJUNCTION_WEIGHTS), ("consistent", {f: 1.0 for f in C.CONJUNCTION_CONSISTENT})):
        fitted = D.fit_labelled_monitor(train, list(weights), weights, 5, D.self_distance_threshold(rows=n))
        d = fitted.distances(test)
        conf = evaluate.with_rates(evaluate.confusion(d, F.col("d_mean") < fitted.epsilon, F.col("label") == 1))
        one = conf.select(F.lit(name).alias("model"), "tp", "fp", "fn", "tn", r("f1").alias("f1"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- cross-validated studies ----------------------------------------------------

BATTERY = D.Setting(15, 1, 5, 100.0, 15.0, 20.0)
BEARING = D.Setting(20, 1, 3, 275.0, 30.0, 20.0)
FLIGHT = D.Setting(10, 1, 5, 100.0, 10.0, 10.0)


def _parts(t: Tables, size: int):
    """Supplier histories cut into cycles of `size` records."""
    s = with_position(t.supply(), ["l_suppkey"], SUPPLY_ORDER, rows=t.rows("lineitem"))
    return s.withColumn("cycle", F.floor(F.col("pos") / size)).withColumn("seq", F.col("pos")).drop("pos", "n")


def _second_sql(cycles: str, width: int, clip: float, warning: float, a: str, b: str, extra: str = "") -> str:
    """e: (obj, y, rul, a, b) of every window over the cycles (l_suppkey, cycle, ...); d_<c> are steps inside the window."""
    return f"""cp AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY cycle) - 1 AS pos, count(*) OVER (PARTITION BY l_suppkey) AS n FROM {cycles}),
{windows_sql('cp', 'l_suppkey', width, 1)},
e AS (SELECT obj, CAST(least(min(n - 1 - pos), {clip}) AS DOUBLE) AS rul, CASE WHEN least(min(n - 1 - pos), {clip}) <= {warning} THEN 1 ELSE 0 END AS y, {a} AS a, {b} AS b{extra} FROM wr GROUP BY obj, win)"""


_COUNTED = """count(*) FILTER (hit AND y = 1) AS tp, count(*) FILTER (hit AND y = 0) AS fp, count(*) FILTER (NOT hit AND y = 1) AS fn, count(*) FILTER (NOT hit AND y = 0) AS tn"""
_DETECTED = "max(rul) FILTER (hit AND y = 1) AS first_detection_rul, coalesce(bool_or(hit AND y = 1), false) AS detected"


def _held_sql(fold: str) -> str:
    """s: every window with the side of the fit on the other folds."""
    return f"""o AS (SELECT f.g AS fold, y, a, b FROM (SELECT DISTINCT {fold} AS g FROM e) f JOIN e ON {fold} <> f.g),
{_fit_sql('o', 'fold')}, s AS (SELECT obj, y, rul, wa * a + wb * b > cut AS hit FROM fit JOIN e ON {fold} = fold)"""


_BATTERY_WINDOWS = _second_sql("cy", BATTERY.window, BATTERY.clip, BATTERY.warning, "regr_slope(capacity, off)", "avg(v_std)")
_BATTERY_CYCLES = f"""{LI}, cy AS (SELECT l_suppkey, pos // 10 AS cycle, sum(l_quantity) AS capacity, CASE WHEN count(*) < 4 THEN 0 ELSE stddev_pop(l_quantity) END AS v_std FROM li GROUP BY ALL)"""


def _battery(t: Tables):
    points = _parts(t, 10).withColumns({"voltage": F.col("l_quantity").cast("double"), "current": F.col("l_tax").cast("double"), "temperature": F.col("l_discount").cast("double")})
    w, _ = studies.battery_windows(points, "l_suppkey", "cycle", ["seq"], F.sum("voltage"), setting=BATTERY, t="day")
    return materialise(w.select("l_suppkey", "rul", "cap_slope", "v_std_mean", (F.col("l_suppkey") % 3).alias("ambient")))


def _battery_study(t: Tables, fold: str):
    features, due = ["cap_slope", "v_std_mean"], F.col("rul") <= BATTERY.warning
    w = _battery(t)
    held = studies.apply_held_out(w, studies.fit_folds(w, fold, features, due), fold, features)
    return studies.object_report(held, ["l_suppkey"], due)


@query("flow_battery_without_one", f"""
WITH {_BATTERY_CYCLES}, {_BATTERY_WINDOWS}, {_held_sql('obj')} SELECT obj AS l_suppkey, {_COUNTED}, {_DETECTED} FROM s GROUP BY obj""")
def _(t: Tables):
    return _battery_study(t, "l_suppkey")


@query("flow_battery_without_group", f"""
WITH {_BATTERY_CYCLES}, {_BATTERY_WINDOWS}, {_held_sql('obj % 3')} SELECT obj AS l_suppkey, {_COUNTED}, {_DETECTED} FROM s GROUP BY obj""")
def _(t: Tables):
    return _battery_study(t, "ambient")


@query("flow_bearing_study", f"""
WITH {LI}, cy AS (SELECT l_suppkey, pos // 10 AS cycle, sqrt(avg(l_quantity * l_quantity)) AS rms, max(abs(l_extendedprice)) AS peak FROM li GROUP BY ALL),
{_second_sql('cy', BEARING.window, BEARING.clip, BEARING.warning, 'avg(rms)', 'stddev_pop(peak)')}, {_held_sql('obj % 4')},
p AS (SELECT obj, {_COUNTED}, {_DETECTED} FROM s GROUP BY obj)
SELECT obj % 4 AS condition, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn, count(*) FILTER (detected) AS n_detected, count(*) AS n_objects,
  {R('coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0)')} AS f1 FROM p GROUP BY obj % 4""")
def _(t: Tables):
    samples = _parts(t, 10).withColumns({"horiz": F.col("l_quantity").cast("double"), "vert": F.col("l_extendedprice").cast("double")})
    w, _ = studies.bearing_windows(samples, "l_suppkey", "cycle", ("horiz", "vert"), "seq", setting=BEARING)
    w = materialise(w.select("l_suppkey", "rul", "horiz_rms_mean", "vert_peak_std", (F.col("l_suppkey") % 4).alias("condition")))
    features, due = ["horiz_rms_mean", "vert_peak_std"], F.col("rul") <= BEARING.warning
    held = studies.apply_held_out(w, studies.fit_folds(w, "condition", features, due), "condition", features)
    report = studies.pooled(studies.object_report(held, ["condition", "l_suppkey"], due), ["condition"])
    return report.select("condition", "tp", "fp", "fn", "tn", "n_detected", "n_objects", r("f1").alias("f1"))


_CRUISE = {"altitude": "alt", "throttle": "tra", "std_max": 2.5, "alt_min": 30_000.0, "least": 8}


@query("flow_flight_study", f"""
WITH {LI}, fl AS (SELECT *, pos // 20 AS cycle, l_extendedprice > 30000 AS high, stddev_pop(l_tax * 100) OVER (PARTITION BY l_suppkey, pos // 20) < 2.5 AND l_extendedprice > 30000 AS steady FROM li),
fc AS (SELECT *, count(*) FILTER (steady) OVER w AS n_steady, count(*) FILTER (high) OVER w AS n_high FROM fl WINDOW w AS (PARTITION BY l_suppkey, cycle)),
cy AS (SELECT l_suppkey, cycle, avg(l_quantity) AS q, avg(l_discount) AS x FROM fc WHERE CASE WHEN n_steady >= 8 THEN steady WHEN n_high >= 8 THEN high ELSE true END GROUP BY ALL),
{_second_sql('cy', FLIGHT.window, FLIGHT.clip, FLIGHT.warning, 'avg(q)', 'stddev_pop(x)', ', obj % 4 AS g, obj // 4 % 2 = 0 AS dev')},
o AS (SELECT f.g AS fold, how AS fit_on, y, a, b FROM (SELECT DISTINCT g, how FROM e, (VALUES ('own'), ('others')) v(how)) f JOIN e ON dev AND (e.g = f.g) = (how = 'own')),
{_fit_sql('o', 'fold, fit_on')}, s AS (SELECT fit_on, g, y, wa * a + wb * b > cut AS hit FROM fit JOIN e ON e.g = fold AND NOT dev)
SELECT fit_on AS fit, g AS dataset, {_COUNTED}, {R('coalesce(2 * count(*) FILTER (hit AND y = 1) / nullif(count(*) FILTER (hit) + count(*) FILTER (y = 1), 0), 0)')} AS f1 FROM s GROUP BY fit_on, g""")
def _(t: Tables):
    samples = _parts(t, 20).withColumns({"alt": F.col("l_extendedprice").cast("double"), "tra": F.col("l_tax") * 100, "q": F.col("l_quantity").cast("double"), "x": F.col("l_discount").cast("double")})
    w, _ = studies.flight_windows(samples, "l_suppkey", "cycle", ["seq"], ["q", "x"], setting=FLIGHT, cruise=_CRUISE)
    w = materialise(w.select("l_suppkey", "rul", "q_mean", "x_std", (F.col("l_suppkey") % 4).alias("dataset")))
    dev = F.floor(F.col("l_suppkey") / 4) % 2 == 0
    out = studies.cross_dataset(w.where(dev), w.where(~dev), "dataset", ["q_mean", "x_std"], F.col("rul") <= FLIGHT.warning)
    return out.select("fit", "dataset", "tp", "fp", "fn", "tn", r("f1").alias("f1"))
