"""Count windows and window features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from driftline.catalog import features as C
from driftline.functions import features as Ft
from driftline.functions.scalar import orbit_from_mean_motion
from driftline.functions.spectral import top_eigenvalues
from driftline.models.evaluate import spearman
from driftline.operators import windows as W
from driftline.operators.ordering import framed
from driftline.plans import conjunction, orbits, signals
from driftline.registry.base import EV, LI, R, SUPPLY_ORDER, Tables, query, r, windows_sql
from driftline.registry.records import MESSAGE_TIE, MSG, messages

WIDTH, STRIDE = 30, 7
EV_WIN = f"{EV}, {windows_sql('ev', 'user_id', WIDTH, STRIDE)}"
DIFF = """dw AS (
  SELECT *, v - lag(v) OVER w AS d1v, k - lag(k) OVER w AS d1k, t - lag(t) OVER w AS dt, lag(t) OVER w AS pt FROM wr WINDOW w AS (PARTITION BY obj, win ORDER BY off)),
dd AS (SELECT *, d1v - lag(d1v) OVER w AS d2v, d1k - lag(d1k) OVER w AS d2k,
  d1v / greatest(dt, 1e-6) AS r1v, lag(dt) OVER w AS dt0 FROM dw WINDOW w AS (PARTITION BY obj, win ORDER BY off)),
dr AS (SELECT *, (r1v - lag(r1v) OVER w) / greatest(dt0, 1e-6) AS r2v FROM dd WINDOW w AS (PARTITION BY obj, win ORDER BY off))"""
GROUPED = "GROUP BY obj, win"


def event_windows(t: Tables, features, stages=(), last=(), **kw):
    kw.setdefault("width", WIDTH)
    kw.setdefault("stride", STRIDE)
    return W.window_features(t.history(), ["user_id"], ["t", "event_id"], kw.pop("width"), kw.pop("stride"), features,
                             stages=stages, last=last, rows=t.rows("events"), **kw).withColumnRenamed("user_id", "obj")


def supply_windows(t: Tables, features, stages=(), last=(), width=30, stride=7, **kw):
    return W.window_features(t.supply(), ["l_suppkey"], SUPPLY_ORDER, width, stride, features, stages=stages, last=last,
                             rows=t.rows("lineitem"), **kw).withColumnRenamed("l_suppkey", "obj")


def rounded(df, digits: int = 6, keep=("obj", "win")):
    return df.select(*keep, *[r(c, digits).alias(c) for c in df.columns if c not in keep])


# ---- W ------------------------------------------------------------------------


@query("W1_complete_windows", f"""
WITH {EV} SELECT user_id AS obj, pos - 29 AS win, {R('t')} AS t_end FROM ev WHERE pos >= 29 AND (pos - 29) % 7 = 0""")
def _(t: Tables):
    out = W.complete_windows(t.history(), ["user_id"], ["t", "event_id"], WIDTH, STRIDE, rows=t.rows("events"))
    return out.select(F.col("user_id").alias("obj"), "win", r("t").alias("t_end"))


@query("W2_shrinking_windows", f"""
WITH o AS (SELECT o_custkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
s AS (SELECT o_custkey, pos AS win, least(12, n) AS w FROM o WHERE n >= 3 AND pos % 5 = 0 AND pos + least(12, n) <= n)
SELECT s.o_custkey AS obj, win, count(*) AS n_rows, {R('avg(x)', 3)} AS x_mean, {R('arg_max(x, pos)', 2)} AS x_last FROM s JOIN o ON o.o_custkey = s.o_custkey AND pos BETWEEN win AND win + w - 1 GROUP BY ALL""")
def _(t: Tables):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("x"))
    out = W.window_features(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 12, 5,
                            lambda s: {"n_rows": s.agg(F.count, "x"), "x_mean": s.agg(F.avg, "x")}, last=["x"], shrink=True,
                            rows=t.rows("orders"))
    return out.select(F.col("o_custkey").alias("obj"), "win", "n_rows", r("x_mean", 3).alias("x_mean"), r("x", 2).alias("x_last"))


@query("W3_two_strides", f"""
WITH {EV} SELECT 'train' AS purpose, user_id AS obj, pos - 29 AS win FROM ev WHERE pos >= 29 AND (pos - 29) % 5 = 0
UNION ALL SELECT 'evaluate', user_id, pos - 29 FROM ev WHERE pos >= 29""")
def _(t: Tables):
    one = lambda name, s: W.complete_windows(t.history(), ["user_id"], ["t", "event_id"], WIDTH, s, rows=t.rows("events")).select(
        F.lit(name).alias("purpose"), F.col("user_id").alias("obj"), "win")
    return one("train", 5).unionByName(one("evaluate", 1))


@query("W4_growing_prefixes", f"""
WITH {EV} SELECT event_id, pos + 1 AS step, {R('avg(v) OVER w')} AS v_mean, {R('min(v) OVER w')} AS v_min, {R('max(v) OVER w')} AS v_max, {R('avg(k) OVER w')} AS k_mean
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def _(t: Tables):
    out = W.prefix_stats(t.history(), ["user_id"], ["t", "event_id"], ["v", "k"], rows=t.rows("events"))
    return out.select("event_id", "step", *[r(c).alias(c) for c in ("v_mean", "v_min", "v_max", "k_mean")])


ARCS = [1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 14.0, 18.0, 21.0, 25.0, 28.0]


@query("W5_arc_lengths", f"""
WITH {EV}, a AS (SELECT unnest([1, 2, 3, 5, 7, 10, 14, 18, 21, 25, 28]) AS arc), f AS (SELECT user_id, min(t) AS t0 FROM ev GROUP BY user_id)
SELECT user_id AS obj, CAST(arc AS DOUBLE) AS arc, count(*) AS n, {R('avg(v)')} AS v_mean, count(*) >= 30 AS long_enough FROM ev JOIN f USING (user_id) JOIN a ON t <= t0 + arc GROUP BY ALL""")
def _(t: Tables):
    out = W.arcs(t.history(), ["user_id"], "t", ARCS).groupBy(F.col("user_id").alias("obj"), "arc").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("v")).alias("v_mean"))
    return out.withColumn("long_enough", F.col("n") >= 30)


@query("W6_own_baseline", f"""
WITH {EV}, b AS (SELECT user_id, avg(v) AS m, stddev_pop(v) AS s FROM ev WHERE pos < 10 GROUP BY user_id)
SELECT event_id, {R('(v - m) / (CASE WHEN s < 1e-10 THEN 1 ELSE s END)')} AS v_scaled FROM ev JOIN b USING (user_id)""")
def _(t: Tables):
    out = W.baseline_scaled(t.history(), ["user_id"], ["t", "event_id"], ["v"], rows=t.rows("events"))
    return out.select("event_id", r("v_scaled").alias("v_scaled"))


@query("W7_half_windows", f"""
WITH {EV_WIN} SELECT obj, win, {R('avg(v) FILTER (off < 15)')} AS early, {R('avg(v) FILTER (off >= 15)')} AS late FROM wr {GROUPED}""")
def _(t: Tables):
    return rounded(event_windows(t, lambda s: {"early": s.agg(F.avg, "v", half="early"), "late": s.agg(F.avg, "v", half="late")}))


@query("W8_tail_records", f"WITH {EV} SELECT user_id AS obj, event_id FROM ev WHERE pos >= n - 60")
def _(t: Tables):
    out = W.tail_rows(t.history(), ["user_id"], ["t", "event_id"], 60, rows=t.rows("events"))
    return out.select(F.col("user_id").alias("obj"), "event_id")


@query("W9_centred_smoothing", f"""
WITH {EV} SELECT event_id, {R('sum(v) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5')} AS v_smooth FROM ev""")
def _(t: Tables):
    out = W.smooth(t.history(), ["user_id"], ["t", "event_id"], ["v"], 5, rows=t.rows("events"))
    return out.select("event_id", r("v_smooth").alias("v_smooth"))


@query("W10_trailing_deviation", f"""
WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {R('stddev_pop(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)')} AS roll_std FROM li""")
def _(t: Tables):
    out = W.rolling_std(t.supply(), ["l_suppkey"], SUPPLY_ORDER, "l_quantity", 50, rows=t.rows("lineitem"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", r("roll_std").alias("roll_std"))


# ---- F ------------------------------------------------------------------------


@query("F1_time_domain", f"""
WITH {EV_WIN} SELECT obj, win, {R('avg(v)')} AS v_mean, {R('stddev_pop(v)')} AS v_std, {R('min(v)')} AS v_min, {R('max(v)')} AS v_max,
  {R('avg(k)')} AS k_mean, {R('stddev_pop(k)')} AS k_std, {R('min(k)')} AS k_min, {R('max(k)')} AS k_max FROM wr {GROUPED}""")
def _(t: Tables):
    return rounded(event_windows(t, lambda s: {**Ft.time_domain(s, "v"), **Ft.time_domain(s, "k")}))


@query("F2_unit_rates", f"""
WITH {EV_WIN}, {DIFF} SELECT obj, win, {R('avg(d1v)')} AS v_d1_mean, {R('stddev_pop(d1v)')} AS v_d1_std, {R('avg(d2v)')} AS v_d2_mean,
  {R('avg(d1k)')} AS k_d1_mean, {R('stddev_pop(d1k)')} AS k_d1_std, {R('avg(d2k)')} AS k_d2_mean FROM dd {GROUPED}""")
def _(t: Tables):
    return rounded(event_windows(t, lambda s: {**Ft.rate(s, "v"), **Ft.rate(s, "k")}, Ft.difference_stages(["v", "k"])))


@query("F3_time_rates", f"""
WITH {EV_WIN}, {DIFF} SELECT obj, win, {R('avg(r1v)', 4)} AS v_r1_mean, {R('stddev_pop(r1v)', 3)} AS v_r1_std, {R('avg(r2v)', 0)} AS v_r2_mean FROM dr {GROUPED}""")
def _(t: Tables):
    out = event_windows(t, lambda s: Ft.rate(s, "v", "r"), Ft.rate_stages(["v"], "t"))
    return out.select("obj", "win", r("v_r1_mean", 4).alias("v_r1_mean"), r("v_r1_std", 3).alias("v_r1_std"), r("v_r2_mean", 0).alias("v_r2_mean"))


def _dft(c: str, k: int) -> str:
    a = f"{2 * k} * pi() * off / 30"
    return f"sqrt(pow(sum({c} * cos({a})), 2) + pow(sum({c} * sin({a})), 2))"


@query("F4_low_frequencies", f"""
WITH {EV_WIN} SELECT obj, win, {', '.join(f"{R(_dft('v', k))} AS v_fft{k}" for k in range(1, 6))} FROM wr {GROUPED}""")
def _(t: Tables):
    return rounded(event_windows(t, lambda s: Ft.spectrum(s, "v")))


@query("F5_correlations", f"""
WITH {LI}, {windows_sql('li', 'l_suppkey', 30, 7)} SELECT obj, win, {', '.join(
    f"{R(f'coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0)')} AS corr_{a}_{b}"
    for a, b in combinations(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'], 2))} FROM wr {GROUPED}""")
def _(t: Tables):
    return rounded(supply_windows(t, lambda s: Ft.correlations(s, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])))


@query("F6_covariance_eigenvalues")
def _(t: Tables):
    ch = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    out = supply_windows(t, lambda s: Ft.covariances(s, ch), stride=30)
    cells = [f"cov_{a}_{b}" for i, a in enumerate(ch) for b in ch[i:]]
    out = out.withColumn("eig", top_eigenvalues(cells, len(ch)))
    return out.select("obj", "win", *[r(F.col("eig")[i]).alias(f"eig{i + 1}") for i in range(5)])


_CH6 = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
_C6 = {(i, j): f"c{min(i, j)}{max(i, j)}" for i in range(4) for j in range(4)}


@query("F6_eigenvalue_sums", f"""
WITH {LI}, {windows_sql('li', 'l_suppkey', 30, 30)}, c AS (SELECT obj, win, {', '.join(f"covar_samp({_CH6[i]}, {_CH6[j]}) AS {n}" for (i, j), n in _C6.items() if i <= j)} FROM wr {GROUPED})
SELECT obj, win, {R(' + '.join(_C6[i, i] for i in range(4)), 5)} AS trace, {R(' + '.join(f'{n} * {n}' for n in _C6.values()), 4)} AS squares,
  {R(' + '.join(f'{_C6[i, j]} * {_C6[j, k]} * {_C6[k, i]}' for i in range(4) for j in range(4) for k in range(4)), 2)} AS cubes FROM c""")
def _(t: Tables):
    # all four eigenvalues are among the top five: their power sums are the traces of the matrix and its powers
    out = supply_windows(t, lambda s: Ft.covariances(s, _CH6), stride=30)
    cells = [f"cov_{a}_{b}" for i, a in enumerate(_CH6) for b in _CH6[i:]]
    out = out.withColumn("eig", top_eigenvalues(cells, len(_CH6)))
    power = lambda p: F.aggregate("eig", F.lit(0.0), lambda acc, x: acc + F.pow(x, F.lit(float(p))))
    return out.select("obj", "win", r(power(1), 5).alias("trace"), r(power(2), 4).alias("squares"), r(power(3), 2).alias("cubes"))


@query("F6_two_channel_eigenvalues", f"""
WITH {EV_WIN}, c AS (SELECT obj, win, var_samp(v) AS a, var_samp(k) AS b, covar_samp(v, k) AS c FROM wr {GROUPED})
SELECT obj, win, {R('(a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c)', 4)} AS eig1, {R('(a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c)', 4)} AS eig2, CAST(0 AS DOUBLE) AS eig3 FROM c""")
def _(t: Tables):
    out = event_windows(t, lambda s: Ft.covariances(s, ["v", "k"]))
    out = out.withColumn("eig", top_eigenvalues(["cov_v_v", "cov_v_k", "cov_k_k"], 2))
    return out.select("obj", "win", *[r(F.col("eig")[i], 4).alias(f"eig{i + 1}") for i in range(3)])


@query("F7_monitoring_vector")
def _(t: Tables):
    ch = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = supply_windows(t, lambda s: Ft.monitoring_vector(s, ch), Ft.difference_stages(ch), stride=10, last=["day"])
    cells = [f"cov_{a}_{b}" for i, a in enumerate(ch) for b in ch[i:]]
    out = out.withColumn("_eig", top_eigenvalues(cells, len(ch))).drop(*cells)
    return out.select("*", *[F.col("_eig")[i].alias(f"eig{i + 1}") for i in range(5)]).drop("_eig")


_CH7 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _vector_sql() -> dict[str, str]:
    """Every feature of the monitoring vector but the eigenvalues, over windows with in-window differences d1_, d2_."""
    out = {}
    for c in _CH7:
        out.update({f"{c}_mean": f"avg({c})", f"{c}_std": f"stddev_pop({c})", f"{c}_min": f"min({c})", f"{c}_max": f"max({c})", f"{c}_d1_mean": f"avg(d1_{c})",
                    f"{c}_d1_std": f"stddev_pop(d1_{c})", f"{c}_d2_mean": f"avg(d2_{c})"} | {f"{c}_fft{k}": _dft(c, k) for k in range(1, 6)})
    return out | {f"corr_{a}_{b}": f"coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0)" for a, b in combinations(_CH7, 2)}


_digits = lambda name: 3 if name.startswith("l_extendedprice") else 6


@query("F7_monitoring_features", f"""
WITH {LI}, {windows_sql('li', 'l_suppkey', 30, 10)}, f1 AS (SELECT *, {', '.join(f'{c} - lag({c}) OVER w AS d1_{c}' for c in _CH7)} FROM wr WINDOW w AS (PARTITION BY obj, win ORDER BY off)),
f2 AS (SELECT *, {', '.join(f'd1_{c} - lag(d1_{c}) OVER w AS d2_{c}' for c in _CH7)} FROM f1 WINDOW w AS (PARTITION BY obj, win ORDER BY off))
SELECT obj, win, {', '.join(f'{R(e, _digits(n))} AS {n}' for n, e in _vector_sql().items())} FROM f2 {GROUPED}""")
def _(t: Tables):
    out = supply_windows(t, lambda s: Ft.monitoring_vector(s, _CH7), Ft.difference_stages(_CH7), stride=10)
    return out.select("obj", "win", *[r(n, _digits(n)).alias(n) for n in out.columns if n not in ("obj", "win") and not n.startswith("cov_")])


def _catalogue_sql(channels: list[str]) -> str:
    rows = C.monitoring_catalogue(channels)
    return ", ".join(f"('{f}', '{c}', {'NULL' if ch is None else repr(ch)})" for f, c, ch in rows)


@query("F8_feature_catalogue", f"""
WITH c(feature, class, channel) AS (VALUES {_catalogue_sql(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])})
SELECT class, channel, count(*) AS n, (SELECT count(*) FROM lineitem) AS n_records FROM c GROUP BY class, channel""")
def _(t: Tables):
    channels = [c for c in t.lineitem.columns if dict(t.lineitem.dtypes)[c] == "double"]
    cat = C.catalogue_table(t.spark, C.monitoring_catalogue(channels))
    n = t.lineitem.agg(F.count(F.lit(1)).alias("n_records")).withColumn("_one", F.lit(1))
    return cat.groupBy("class", "channel").agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1)).join(n, "_one").drop("_one")


_NAMED = f"""{LI}, {windows_sql('li', 'l_suppkey', 30, 30)}, f1 AS (SELECT *, {', '.join(f'{c} - lag({c}) OVER w AS d1_{c}' for c in _CH7)} FROM wr WINDOW w AS (PARTITION BY obj, win ORDER BY off)),
f2 AS (SELECT *, {', '.join(f'd1_{c} - lag(d1_{c}) OVER w AS d2_{c}' for c in _CH7)} FROM f1 WINDOW w AS (PARTITION BY obj, win ORDER BY off)),
f3 AS (SELECT obj, win, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _vector_sql().items())} FROM f2 {GROUPED}), f4 AS (UNPIVOT f3 ON COLUMNS(* EXCLUDE (obj, win)) INTO NAME feature VALUE x)"""


@query("F8_feature_values", f"""
WITH {_NAMED} SELECT CASE WHEN feature LIKE 'corr%' THEN 'covariance' WHEN feature LIKE '%fft_' THEN 'frequency' WHEN regexp_matches(feature, '_d[12]_') THEN 'rate' ELSE 'time_domain' END AS class,
  CASE WHEN feature NOT LIKE 'corr%' THEN regexp_extract(feature, '^(l_[a-z]+)_', 1) END AS channel, count(DISTINCT feature) AS n_features, count(*) AS n_values, {R('avg(x)', 3)} AS mean_value FROM f4 GROUP BY 1, 2""")
def _(t: Tables):
    channels = [c for c, kind in t.lineitem.dtypes if kind == "double"]
    names = C.monitoring_catalogue(channels, eigenvalues=0)
    out = supply_windows(t, lambda s: Ft.monitoring_vector(s, channels), Ft.difference_stages(channels), stride=30)
    values = out.select("obj", "win", *[F.col(f).cast("double").alias(f) for f, _, _ in names]).unpivot(["obj", "win"], [f for f, _, _ in names], "feature", "x")
    # one row per feature before the names are joined
    sums = values.groupBy("feature").agg(F.count("x").alias("n"), F.sum("x").alias("s"))
    named = sums.join(C.catalogue_table(t.spark, names), "feature")
    return named.groupBy("class", "channel").agg(F.count(F.lit(1)).alias("n_features"), F.sum("n").alias("n_values"), r(F.sum("s") / F.sum("n"), 3).alias("mean_value"))


ORBIT = f"""{LI}, el AS (SELECT *, day AS jd, l_extendedprice / 50000 AS q, l_quantity AS a, l_discount AS e, l_tax AS i, l_linenumber AS nm,
  day + l_quantity AS tp, abs(l_extendedprice / 50000 - 1) AS gap FROM li), {windows_sql('el', 'l_suppkey', 30, 7)},
d1 AS (SELECT *, q - lag(q) OVER w AS dq, a - lag(a) OVER w AS da, e - lag(e) OVER w AS de, gap - lag(gap) OVER w AS dg FROM wr WINDOW w AS (PARTITION BY obj, win ORDER BY off)),
d2 AS (SELECT *, dq - lag(dq) OVER (PARTITION BY obj, win ORDER BY off) AS d2q FROM d1)"""
_corr = lambda a, b: f"coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0)"
ASTEROID_SQL = {
    "q_mean": "avg(q)", "q_std": "stddev_pop(q) + 1e-10", "q_min": "min(q)", "q_max": "max(q)", "a_mean": "avg(a)",
    "a_std": "stddev_pop(a) + 1e-10", "e_mean": "avg(e)", "e_std": "stddev_pop(e) + 1e-10", "dq_mean": "avg(dq)",
    "dq_std": "stddev_pop(dq) + 1e-10", "da_mean": "avg(da)", "da_std": "stddev_pop(da) + 1e-10", "de_mean": "avg(de)",
    "de_std": "stddev_pop(de) + 1e-10", "gap_mean": "avg(gap)", "gap_min": "min(gap)", "dgap_mean": "avg(dg)",
    "dgap_std": "stddev_pop(dg) + 1e-10", "d2q_mean": "avg(d2q)", "d2q_std": "stddev_pop(d2q) + 1e-10",
    "corr_e_q": _corr("e", "q"), "corr_a_q": _corr("a", "q"), "q_slope": "regr_slope(q, off)",
    "gap_ratio": "avg(gap) FILTER (off >= 15) / (avg(gap) FILTER (off < 15) + 1e-10)", "i_mean": "avg(i)", "n_mean": "avg(nm)",
    "tp_mean": "avg(abs(tp - jd))", "tp_min": "min(abs(tp - jd))"}


def elements(t: Tables):
    """lineitem as orbital elements per supplier."""
    return t.supply().withColumns({
        "jd": F.col("day"), "q": F.col("l_extendedprice") / 50000, "a": F.col("l_quantity"), "e": F.col("l_discount"),
        "i": F.col("l_tax"), "nm": F.col("l_linenumber").cast("double"), "tp": F.col("day") + F.col("l_quantity")})


@query("F9_asteroid_vector", f"WITH {ORBIT} SELECT obj, win, {', '.join(f'{R(v)} AS {k}' for k, v in ASTEROID_SQL.items())} FROM d2 {GROUPED}")
def _(t: Tables):
    out = orbits.asteroid_windows(elements(t), "l_suppkey", SUPPLY_ORDER, rows=t.rows("lineitem")).drop("jd")
    return rounded(out.withColumnRenamed("l_suppkey", "obj"))


@query("F10_slope", f"WITH {EV_WIN} SELECT obj, win, {R('regr_slope(v, off)')} AS v_slope FROM wr {GROUPED}")
def _(t: Tables):
    return rounded(event_windows(t, lambda s: {"v_slope": Ft.slope(s, "v")}))


@query("F11_late_early", f"""
WITH {EV_WIN}, h AS (SELECT obj, win, avg(v - 50) FILTER (off < 15) AS a, avg(v - 50) FILTER (off >= 15) AS b FROM wr {GROUPED})
SELECT obj, win, {R('b / (a + 1e-10)', 4)} AS plain, {R('b / (abs(a) + 1e-10)', 4)} AS absolute FROM h""")
def _(t: Tables):
    def both(s):
        early, late = s.agg(F.avg, F.col("v") - 50, half="early"), s.agg(F.avg, F.col("v") - 50, half="late")
        return {"early": early, "late": late}
    out = event_windows(t, both)
    return out.select("obj", "win", r(F.col("late") / (F.col("early") + 1e-10), 4).alias("plain"),
                      r(F.col("late") / (F.abs("early") + 1e-10), 4).alias("absolute"))


MSG_RATES = f"""{MSG}, near AS (SELECT *, -time_to_tca AS el FROM msg WHERE time_to_tca <= 2),
np AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY event_id) AS n,
  CASE WHEN t_position_covariance_det = 0 THEN -30 ELSE log10(abs(t_position_covariance_det)) END AS t_det,
  CASE WHEN c_position_covariance_det = 0 THEN -30 ELSE log10(abs(c_position_covariance_det)) END AS c_det,
  coalesce(last_value(c_sigma_r IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(c_sigma_r IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS c_sigma
  FROM near WINDOW w AS (PARTITION BY event_id ORDER BY el, l_linenumber, l_partkey, price, qty)),
rt AS (SELECT *, el - lag(el) OVER w AS gap, {', '.join(f'CASE WHEN abs(el - lag(el) OVER w) >= 1e-8 THEN ({c} - lag({c}) OVER w) / (el - lag(el) OVER w) END AS rate_{c}'
  for c in ('miss_distance', 'mahalanobis_distance', 't_sigma_r', 'c_sigma', 't_det', 'c_det', 'c_obs_used', 'risk'))} FROM np WINDOW w AS (PARTITION BY event_id ORDER BY pos)),
rk AS (SELECT event_id, miss_distance AS a, c_det AS b FROM np WHERE miss_distance IS NOT NULL AND c_det IS NOT NULL),
rr AS (SELECT event_id, rank() OVER (PARTITION BY event_id ORDER BY a) + (count(*) OVER (PARTITION BY event_id, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY event_id ORDER BY b) + (count(*) OVER (PARTITION BY event_id, b) - 1) / 2.0 AS rb FROM rk),
sp AS (SELECT event_id, CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 0) END AS rho FROM rr GROUP BY event_id)"""


def _near(t: Tables):
    return conjunction.near_event(messages(t)).withColumn("_order", -F.col("time_to_tca"))


def _rated(t: Tables, columns):
    return conjunction.step_rates(_near(t), ["event_id"], ["_order", *MESSAGE_TIE], "_order", columns, rows=t.rows("lineitem"))


@query("F12_mean_rate", f"WITH {MSG_RATES} SELECT event_id, {R('coalesce(avg(rate_miss_distance), 0)', 3)} AS rate FROM rt GROUP BY event_id")
def _(t: Tables):
    return _rated(t, ["miss_distance"]).groupBy("event_id").agg(r(conjunction.mean_rate("miss_distance"), 3).alias("rate"))


@query("F13_last_rate", f"WITH {MSG_RATES} SELECT event_id, {R('coalesce(arg_max(rate_mahalanobis_distance, pos) FILTER (rate_mahalanobis_distance IS NOT NULL), 0)', 3)} AS rate FROM rt GROUP BY event_id")
def _(t: Tables):
    return _rated(t, ["mahalanobis_distance"]).groupBy("event_id").agg(r(conjunction.last_rate("mahalanobis_distance"), 3).alias("rate"))


@query("F14_mean_acceleration", f"""
WITH {MSG_RATES}, kept AS (SELECT event_id, el, pos, rate_risk AS x FROM rt WHERE rate_risk IS NOT NULL),
s AS (SELECT event_id, x - lag(x) OVER w AS dx, el - lag(el) OVER w AS de FROM kept WINDOW w AS (PARTITION BY event_id ORDER BY pos)),
a AS (SELECT event_id, avg(dx / de) FILTER (abs(de) >= 1e-8) AS acc FROM s GROUP BY event_id)
SELECT event_id, {R('coalesce(acc, 0)', 2)} AS acc FROM (SELECT DISTINCT event_id FROM rt) LEFT JOIN a USING (event_id)""")
def _(t: Tables):
    out = conjunction.mean_acceleration(_rated(t, ["risk"]), ["event_id"], "_order", "risk", "acc", rows=t.rows("lineitem"))
    return out.select("event_id", r("acc", 2).alias("acc"))


@query("F15_rank_correlation", f"WITH {MSG_RATES} SELECT event_id, {R('rho')} AS rho FROM sp")
def _(t: Tables):
    from driftline.functions.scalar import log10_magnitude
    near = _near(t).withColumn("c_det", log10_magnitude("c_position_covariance_det"))
    out = spearman(near, "miss_distance", "c_det", ["event_id"], rows=t.rows("lineitem"))
    return out.select("event_id", r("rho").alias("rho"))


@query("F16_final_values", f"""
WITH {MSG_RATES} SELECT event_id, {R('arg_max(miss_distance, pos)')} AS miss_distance, {R('arg_max(risk, pos)', 5)} AS risk FROM np GROUP BY event_id""")
def _(t: Tables):
    order = [F.col("_order"), *[F.col(c) for c in MESSAGE_TIE]]
    out = conjunction.final_values(_near(t), "event_id", order, ["miss_distance", "risk"])
    return out.select("event_id", r("miss_distance").alias("miss_distance"), r("risk", 5).alias("risk"))


@query("F17_range_and_rise", f"""
WITH {EV}, d AS (SELECT user_id, v, v > lag(v) OVER (PARTITION BY user_id ORDER BY pos) AS up FROM ev)
SELECT user_id AS obj, {R('max(v) - min(v)')} AS v_range, {R('avg(CASE WHEN up THEN 1 WHEN NOT up THEN 0 END)')} AS rising FROM d GROUP BY user_id""")
def _(t: Tables):
    fr = framed(t.history(), ["user_id"], ["t", "event_id"], 1, rows=t.rows("events"))
    up = fr.finish(fr.df.withColumn("up", (F.col("v") > F.lag("v").over(fr.ordered)).cast("int")))
    return up.groupBy(F.col("user_id").alias("obj")).agg(r(F.max("v") - F.min("v")).alias("v_range"), r(F.avg("up")).alias("rising"))


@query("F18_record_gaps", f"""
WITH {MSG_RATES} SELECT event_id, count(*) AS n, {R('coalesce(avg(gap), 0)')} AS gap_mean, {R('coalesce(stddev_pop(gap), 0)')} AS gap_std, {R('coalesce(arg_max(gap, pos), 0)')} AS gap_last FROM rt GROUP BY event_id""")
def _(t: Tables):
    return _rated(t, []).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), r(F.coalesce(F.avg("gap"), F.lit(0.0))).alias("gap_mean"),
        r(F.coalesce(F.stddev_pop("gap"), F.lit(0.0))).alias("gap_std"), r(F.coalesce(F.max_by("gap", "pos"), F.lit(0.0))).alias("gap_last"))


_le = lambda c: f"coalesce(avg({c}) FILTER (pos >= n // 2) / (abs(avg({c}) FILTER (pos < n // 2)) + 1e-10), 1)"
_last = lambda c: f"arg_max_null({c}, pos)"
EVENT_SQL = {
    "miss_dist_final": (_last("miss_distance"), 4), "d_miss_dist_dt_mean": ("coalesce(avg(rate_miss_distance), 0)", 3),
    "d_miss_dist_dt_last": ("coalesce(arg_max(rate_miss_distance, pos) FILTER (rate_miss_distance IS NOT NULL), 0)", 3),
    "mahal_dist_final": (_last("mahalanobis_distance"), 4), "d_mahal_dt_mean": ("coalesce(avg(rate_mahalanobis_distance), 0)", 3),
    "rel_pos_r_final": (_last("relative_position_r"), 6), "rel_pos_t_final": (_last("relative_position_t"), 6),
    "rel_pos_n_final": (_last("relative_position_n"), 6), "miss_dist_late_early_ratio": (_le("miss_distance"), 5),
    "mahal_late_early_ratio": (_le("mahalanobis_distance"), 5), "t_sigma_r_final": (_last("t_sigma_r"), 6),
    "c_sigma_r_final": (_last("c_sigma"), 6), "d_t_sigma_r_dt": ("coalesce(avg(rate_t_sigma_r), 0)", 4),
    "d_c_sigma_r_dt": ("coalesce(avg(rate_c_sigma), 0)", 4), "t_cov_det_final": (_last("t_det"), 6), "c_cov_det_final": (_last("c_det"), 6),
    "d_t_cov_det_dt": ("coalesce(avg(rate_t_det), 0)", 3), "d_c_cov_det_dt": ("coalesce(avg(rate_c_det), 0)", 3),
    "cov_det_ratio_tc": (f"coalesce({_last('t_det')}, 0) - coalesce({_last('c_det')}, 0)", 5),
    "sigma_r_ratio_tc": (f"{_last('t_sigma_r')} / (coalesce({_last('c_sigma')}, 1) + 1e-10)", 5),
    "t_cov_late_early_ratio": (_le("t_det"), 5), "c_cov_late_early_ratio": (_le("c_det"), 5),
    "t_obs_used_final": (_last("t_obs_used"), 6), "c_obs_used_final": (_last("c_obs_used"), 6),
    "d_c_obs_used_dt": ("coalesce(avg(rate_c_obs_used), 0)", 3), "c_weighted_rms_final": (_last("c_weighted_rms"), 6),
    "c_actual_od_span_final": (_last("c_actual_od_span"), 5), "t_time_lastob_end_final": (_last("t_time_lastob_end"), 6),
    "c_time_lastob_end_final": (_last("c_time_lastob_end"), 6),
    "od_quality_ratio": (f"(CASE WHEN {_last('t_weighted_rms')} <> 0 THEN {_last('t_weighted_rms')} ELSE 1e-10 END) / ({_last('c_weighted_rms')} + 1e-10)", 6),
    "inter_cdm_dt_mean": ("coalesce(avg(gap), 0)", 6), "inter_cdm_dt_std": ("coalesce(stddev_pop(gap), 0)", 6),
    "inter_cdm_dt_last": ("coalesce(arg_max(gap, pos), 0)", 6), "n_cdms": ("count(*)", 0), "corr_miss_c_cov_det": ("coalesce(any_value(rho), 0)", 6),
}


@query("F20_event_features", f"""
WITH {MSG_RATES} SELECT event_id, {', '.join(f'{R(e, d)} AS {k}' for k, (e, d) in EVENT_SQL.items())},
  CAST(arg_max(risk, pos) >= -5 AS INTEGER) AS label, {R('arg_max(risk, pos)', 5)} AS final_risk, CAST(count(*) < 2 AS INTEGER) AS single_cdm
FROM rt LEFT JOIN sp USING (event_id) GROUP BY event_id""")
def _(t: Tables):
    out = conjunction.event_features(messages(t), tie=MESSAGE_TIE, rows=t.rows("lineitem"))
    return out.select("event_id", *[r(k, d).alias(k) for k, (_, d) in EVENT_SQL.items()], "label", r("final_risk", 5).alias("final_risk"), "single_cdm")


@query("F19_cross_source_ratios", f"""
WITH {MSG_RATES} SELECT event_id, {', '.join(f'{R(EVENT_SQL[k][0], EVENT_SQL[k][1])} AS {k}' for k in ('cov_det_ratio_tc', 'sigma_r_ratio_tc', 'od_quality_ratio'))} FROM rt GROUP BY event_id""")
def _(t: Tables):
    out = conjunction.event_features(messages(t), tie=MESSAGE_TIE, rows=t.rows("lineitem"))
    return out.select("event_id", *[r(k, EVENT_SQL[k][1]).alias(k) for k in ("cov_det_ratio_tc", "sigma_r_ratio_tc", "od_quality_ratio")])


@query("K2_feature_table", f"""
WITH {MSG_RATES} SELECT event_id, {R('coalesce(avg(gap), 0)')} AS inter_cdm_dt_mean, CAST(arg_max(risk, pos) >= -5 AS INTEGER) AS label, CAST(count(*) < 2 AS INTEGER) AS single_cdm
FROM rt GROUP BY event_id""")
def _(t: Tables):
    out = conjunction.event_features(messages(t), tie=MESSAGE_TIE, rows=t.rows("lineitem"))
    return out.select("event_id", r("inter_cdm_dt_mean").alias("inter_cdm_dt_mean"), "label", "single_cdm")


@query("F21_signal_summary", f"""
SELECT l_suppkey AS obj, {R('sqrt(avg(pow(l_quantity - 25, 2)))')} AS rms, {R('max(abs(l_quantity - 25))')} AS peak,
  {R('max(abs(l_quantity - 25)) / greatest(sqrt(avg(pow(l_quantity - 25, 2))), 1e-12)')} AS crest, {R('kurtosis_pop(l_quantity - 25)')} AS kurtosis FROM lineitem GROUP BY l_suppkey""")
def _(t: Tables):
    vals = signals.vibration_summary(F.col("l_quantity") - 25)
    return t.lineitem.groupBy(F.col("l_suppkey").alias("obj")).agg(*[r(v).alias(k) for k, v in vals.items()])


@query("F23_channel_correlation", f"""
SELECT l_suppkey AS obj, {R(_corr('l_quantity', 'l_extendedprice'))} AS cross_corr FROM lineitem GROUP BY l_suppkey""")
def _(t: Tables):
    from driftline.models.evaluate import guarded_corr
    return t.lineitem.groupBy(F.col("l_suppkey").alias("obj")).agg(r(guarded_corr("l_quantity", "l_extendedprice")).alias("cross_corr"))


def snapshots(t: Tables):
    """Embeddings as vibration snapshots: two channels of 32 samples."""
    e = t.embeddings.select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "x"))
    return e.groupBy("vec_id", (F.col("p") % 32).alias("sample_no")).agg(
        F.max(F.when(F.col("p") < 32, F.col("x"))).alias("horiz"), F.max(F.when(F.col("p") >= 32, F.col("x"))).alias("vert"))


SNAP = """x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
sn AS (SELECT vec_id, p % 32 AS s, max(x) FILTER (p < 32) AS horiz, max(x) FILTER (p >= 32) AS vert FROM x GROUP BY ALL)"""


def _band_sql(c: str) -> str:
    # 17 spectrum bins in 8 bands: edges 0, 2, 4, 6, 8, 10, 12, 14, 17
    edges = [int(17 * i / 8) for i in range(9)]
    parts = []
    for b in range(8):
        terms = [f"pow(sum({c} * cos({2 * k} * pi() * s / 32)), 2) + pow(sum({c} * sin({2 * k} * pi() * s / 32)), 2)" for k in range(edges[b], edges[b + 1])]
        parts.append(f"{R('log10(1 + ' + ' + '.join(terms) + ')')} AS {c}_band{b + 1}")
    return ", ".join(parts)


@query("F22_band_energies", f"WITH {SNAP} SELECT vec_id, {_band_sql('horiz')} FROM sn GROUP BY vec_id")
def _(t: Tables):
    out = signals.snapshot_features(snapshots(t), ["vec_id"], ("horiz", "vert"), "sample_no")
    return out.select("vec_id", *[r(f"horiz_band{b}").alias(f"horiz_band{b}") for b in range(1, 9)])


@query("F24_snapshot_row", f"""
WITH {SNAP} SELECT vec_id, {', '.join(f"{R(f'sqrt(avg({c} * {c}))')} AS {c}_rms, {R(f'max(abs({c}))')} AS {c}_peak, {R(f'max(abs({c})) / greatest(sqrt(avg({c} * {c})), 1e-12)')} AS {c}_crest, {R(f'kurtosis_pop({c})', 5)} AS {c}_kurtosis, {_band_sql(c)}" for c in ('horiz', 'vert'))},
  {R(_corr('horiz', 'vert'))} AS cross_corr FROM sn GROUP BY vec_id""")
def _(t: Tables):
    out = signals.snapshot_features(snapshots(t), ["vec_id"], ("horiz", "vert"), "sample_no")
    return out.select("vec_id", *[r(c, 5 if c.endswith("kurtosis") else 6).alias(c) for c in out.columns if c != "vec_id"])


@query("F25_second_level", f"""
WITH {LI}, c AS (SELECT l_suppkey, pos // 10 AS snap, avg(l_quantity) AS rms, max(l_discount) AS peak FROM li GROUP BY ALL),
cp AS (SELECT *, snap AS pos, count(*) OVER (PARTITION BY l_suppkey) AS n FROM c), {windows_sql('cp', 'l_suppkey', 20, 1)},
d AS (SELECT *, rms - lag(rms) OVER w AS d_rms, peak - lag(peak) OVER w AS d_peak FROM wr WINDOW w AS (PARTITION BY obj, win ORDER BY off))
SELECT obj, win, {', '.join(f"{R(f'avg({c})')} AS {c}_mean, {R(f'stddev_pop({c})')} AS {c}_std, {R(f'avg(d_{c})')} AS {c}_step" for c in ('rms', 'peak'))} FROM d {GROUPED}""")
def _(t: Tables):
    from driftline.operators.ordering import with_position
    n = t.rows("lineitem")
    s = with_position(t.supply(), ["l_suppkey"], SUPPLY_ORDER, rows=n)
    c = s.groupBy("l_suppkey", F.floor(F.col("pos") / 10).alias("snap")).agg(F.avg("l_quantity").alias("rms"), F.max("l_discount").alias("peak"))
    out = W.window_features(c, ["l_suppkey"], ["snap"], 20, 1, lambda s: Ft.second_level(s, ["rms", "peak"]),
                            stages=Ft.difference_stages(["rms", "peak"], second=False), rows=n)
    return rounded(out.withColumnRenamed("l_suppkey", "obj"))


@query("F26_capacity_trend", f"""
WITH {EV}, {windows_sql('ev', 'user_id', 15, 1)} SELECT obj, win, {R('regr_slope(v, off)')} AS cap_slope, {R('avg(v)')} AS cap_mean, {R('stddev_pop(v)')} AS cap_std, {R('min(v)')} AS cap_min, {R('arg_max(v, off)')} AS cap_last FROM wr {GROUPED}""")
def _(t: Tables):
    out = event_windows(t, lambda s: {"cap_slope": Ft.slope(s, "v"), "cap_mean": s.agg(F.avg, "v"), "cap_std": s.agg(F.stddev_pop, "v"),
                                      "cap_min": s.agg(F.min, "v"), "cap_last": Ft.last_value(s, "v")}, width=15, stride=1)
    return rounded(out)


CURVE = """cv AS (SELECT o_custkey AS obj, o_totalprice / 100000 AS v, o_orderkey % 11 - 5 AS i, o_orderkey % 17 AS tp, epoch_us(o_orderdate) / CAST(86400000000 AS DOUBLE) AS ts,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
c2 AS (SELECT *, CASE WHEN n > 1 THEN pos / CAST(n - 1 AS DOUBLE) ELSE 0 END AS x, ts - lag(ts) OVER (PARTITION BY obj ORDER BY pos) AS dt FROM cv),
ps AS (SELECT obj, max(n) AS n, count(*) AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(v) AS t0, sum(x*v) AS t1, sum(x*x*v) AS t2 FROM c2 GROUP BY obj),
qf AS (SELECT obj, n, s4*(s2*s0-s1*s1) - s3*(s3*s0-s1*s2) + s2*(s3*s1-s2*s2) AS det, t2*(s2*s0-s1*s1) - s3*(t1*s0-s1*t0) + s2*(t1*s1-s2*t0) AS n2,
  s4*(t1*s0-t0*s1) - t2*(s3*s0-s1*s2) + s2*(s3*t0-s2*t1) AS n1 FROM ps)"""


def curves(t: Tables):
    """orders per customer as discharge curves."""
    return t.orders.select(F.col("o_custkey").alias("obj"), "o_orderkey", (F.col("o_totalprice") / 100000).alias("voltage"),
                           (F.col("o_orderkey") % 11 - 5).cast("double").alias("current"), (F.col("o_orderkey") % 17).cast("double").alias("temperature"),
                           (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(86400000000.0)).alias("time_s"))


def _discharge(t: Tables):
    return signals.discharge_features(curves(t), ["obj"], ["time_s", "o_orderkey"], rows=t.rows("orders"))


CURVE_SQL = {
    "v_mean": "avg(v)", "v_std": "stddev_pop(v)", "v_min": "min(v)", "v_max": "max(v)", "v_range": "max(v) - min(v)", "v_end": "arg_max(v, pos)",
    "v_q25": "max(v) FILTER (pos = n // 4)", "v_q50": "max(v) FILTER (pos = n // 2)", "v_q75": "max(v) FILTER (pos = 3 * n // 4)",
    "i_mean": "avg(abs(i))", "i_std": "stddev_pop(i)", "t_max": "max(tp)", "t_rise": "max(tp) - arg_min(tp, pos)", "t_mean": "avg(tp)",
    "duration": "max(ts) - min(ts)", "v_rate": "(max(v) - min(v)) / greatest(max(ts) - min(ts), 1)"}


@query("F27_discharge_curve", f"""
WITH {CURVE} SELECT obj, {', '.join(f"{R(f'CASE WHEN max(n) < 4 THEN 0 ELSE {e} END')} AS {k}" for k, e in CURVE_SQL.items())} FROM c2 GROUP BY obj""")
def _(t: Tables):
    return rounded(_discharge(t).select("obj", *CURVE_SQL), keep=("obj",))


@query("F28_energy", f"""
WITH {CURVE} SELECT obj, {R('CASE WHEN max(n) < 4 THEN 0 ELSE coalesce(sum(abs(v * i) * dt), 0) END', 4)} AS energy,
  {R('CASE WHEN max(n) < 4 THEN 0 ELSE coalesce(sum(abs(v * i) * dt), 0) / greatest(max(ts) - min(ts), 1) END', 5)} AS power FROM c2 GROUP BY obj""")
def _(t: Tables):
    d = _discharge(t)
    return d.select("obj", r("energy", 4).alias("energy"), r("power", 5).alias("power"))


@query("F29_quadratic_fit", f"""
WITH {CURVE} SELECT obj, {R('CASE WHEN n < 4 THEN 0 ELSE n2 / det END', 5)} AS v_curvature, {R('CASE WHEN n < 4 THEN 0 ELSE n1 / det END', 5)} AS v_slope FROM qf""")
def _(t: Tables):
    d = _discharge(t)
    return d.select("obj", r("v_curvature", 5).alias("v_curvature"), r("v_slope", 5).alias("v_slope"))


@query("F30_orbit_size", f"""
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, 12 + l_discount * 30 AS n, l_tax AS e FROM lineitem),
a AS (SELECT *, pow(398600.4418 / pow(n * 2 * pi() / 86400, 2), CAST(1 AS DOUBLE) / 3) AS sma FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, {R('sma', 4)} AS semimajor_axis, {R('sma * (1 - e) - 6378.137', 4)} AS periapsis, {R('sma * (1 + e) - 6378.137', 4)} AS apoapsis FROM a""")
def _(t: Tables):
    vals = orbit_from_mean_motion(12 + F.col("l_discount") * 30, "l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[r(v, 4).alias(k) for k, v in vals.items()])


@query("F7_decay_vector", f"""
WITH {LI}, u AS (SELECT *, l_quantity AS p, l_discount AS m FROM li), {windows_sql('u', 'l_suppkey', 30, 5)},
a AS (SELECT *, greatest(day - lag(day) OVER w, 1e-6) AS dt, p - lag(p) OVER w AS dp FROM wr WINDOW w AS (PARTITION BY obj, win ORDER BY off)),
b AS (SELECT *, dp / dt AS rp, lag(dt) OVER w AS dt0 FROM a WINDOW w AS (PARTITION BY obj, win ORDER BY off))
SELECT obj, win, {R('avg(p)')} AS p_mean, {R('stddev_pop(m)')} AS m_std, {R('avg(rp)', 0)} AS p_r1_mean, {R('avg(p) FILTER (off >= 15) / (abs(avg(p) FILTER (off < 15)) + 1e-10)')} AS p_ratio, {R(_corr('p', 'm'))} AS corr_p_m FROM b {GROUPED}""")
def _(t: Tables):
    s = t.supply().withColumns({"p": F.col("l_quantity"), "m": F.col("l_discount")})
    out = orbits.decay_windows(s, "l_suppkey", SUPPLY_ORDER, time="day", channels=["p", "m"], rows=t.rows("lineitem"))
    return out.select(F.col("l_suppkey").alias("obj"), "win", r("p_mean").alias("p_mean"), r("m_std").alias("m_std"),
                      r("p_r1_mean", 0).alias("p_r1_mean"), r("p_ratio").alias("p_ratio"), r("corr_p_m").alias("corr_p_m"))
