"""Scaling, weighting, projection, distances, calibration and detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.catalog import features as C
from driftline.functions import features as Ft
from driftline.models import calibrate, lda, scale
from driftline.operators import detect, knn
from driftline.operators.matching import match_remaining_life
from driftline.operators.ordering import with_position
from driftline.operators.windows import window_features
from driftline.plans.monitoring import Flow, fit_monitor, frozen, measure
from driftline.plans.orbits import tightened_basin
from driftline.registry.base import EV, LI, R, SUPPLY_ORDER, Tables, query, r, windows_sql
from driftline.session import materialise

# coefficients of the frozen stand-in model, applied to standardised features
COEF = {"v_mean": 0.6, "v_std": -0.4, "v_min": 0.3, "k_mean": 0.5, "k_std": 0.25, "v_slope": 0.7, "k_ratio": -0.35}
WEIGHTS = {"v_slope": 2.0, "k_ratio": 1.5}
FEATURE_SQL = {"v_mean": "avg(v)", "v_std": "stddev_pop(v)", "v_min": "min(v)", "k_mean": "avg(k)", "k_std": "stddev_pop(k)",
               "v_slope": "regr_slope(v, off)", "k_ratio": "avg(k) FILTER (off >= {h}) / (abs(avg(k) FILTER (off < {h})) + 1e-10)"}


def flow(t: Tables, width: int = 30, warning: float = 7.0, k: int = 5) -> Flow:
    return Flow("user_id", ("t", "event_id"), "t", ("v", "k"), width, 7, warning, k, rows=t.rows("events"))


def scored(t: Tables, width: int = 30, warning: float = 7.0, k: int = 5, corpus: bool = False) -> DataFrame:
    """Windows of the event histories with projection and basin distance."""
    f = flow(t, width, warning, k)
    windows = materialise(f.windows(t.history()).select("user_id", "win", "t", "rul", "label", *COEF))
    out = measure(windows, frozen(windows, COEF, WEIGHTS), F.col("label") == 1, k, corpus=corpus)
    return out.withColumnRenamed("user_id", "obj")


def projected(t: Tables, width: int) -> DataFrame:
    """Windows of a width with remaining time and projection, which depend on the width alone; written once."""
    windows = materialise(flow(t, width).windows(t.history()).select("user_id", "win", "rul", *COEF))
    return frozen(windows, COEF, WEIGHTS).written(windows).withColumnRenamed("user_id", "obj")


def scored_sql(width: int = 30, warning: float = 7, k: int = 5, corpus: bool = False) -> str:
    """The same as a chain of common table expressions ending in `sd`."""
    half = width // 2
    terms = " + ".join(f"CAST({COEF[f] * WEIGHTS.get(f, 1.0)!r} AS DOUBLE) * ({f} - m_{f}) / s_{f}" for f in COEF)
    near = lambda ref: f"""SELECT obj, win, avg(d) AS d_mean, max(d) AS d_kth FROM (SELECT s.obj, s.win, abs(s.proj - b.proj) AS d,
      row_number() OVER (PARTITION BY s.obj, s.win ORDER BY abs(s.proj - b.proj)) AS rk FROM sc s, {ref} b) WHERE rk <= {k} GROUP BY obj, win"""
    extra = f", co AS ({near('sc')})" if corpus else ""
    return f"""{EV}, {windows_sql('ev', 'user_id', width, 7)}, le AS (SELECT user_id, max(t) AS te FROM ev GROUP BY user_id),
wf AS (SELECT obj, win, max(t) AS t_end, {', '.join(f'{e.format(h=half)} AS {f}' for f, e in FEATURE_SQL.items())} FROM wr GROUP BY obj, win),
lf AS (SELECT wf.*, te - t_end AS rul, CASE WHEN te - t_end <= {warning} THEN 1 ELSE 0 END AS label FROM wf JOIN le ON user_id = obj),
st AS (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in COEF)} FROM lf),
sc AS (SELECT lf.*, {terms} AS proj FROM lf, st), bs AS (SELECT proj FROM sc WHERE label = 1), di AS ({near('bs')}){extra},
sd AS (SELECT sc.*, di.d_mean{', co.d_kth AS d_corpus' if corpus else ''} FROM sc JOIN di USING (obj, win){' JOIN co USING (obj, win)' if corpus else ''})"""


SD = scored_sql()
P5 = "(SELECT quantile_cont(d_mean, CAST(0.05 AS DOUBLE)) FROM sd WHERE label = 0)"


# ---- M: scaling, weights, projection ------------------------------------------


@query("M1_global_scaling", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {R('(l_quantity - m) / s')} AS l_quantity, {R('(l_tax - m2) / s2')} AS l_tax, CAST(0 AS DOUBLE) AS flat
FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2 FROM lineitem WHERE l_suppkey % 5 <> 0)""")
def _(t: Tables):
    li = t.lineitem.withColumn("flat", F.lit(3.0))
    stats = scale.fit_stats(li.where("l_suppkey % 5 <> 0"), ["l_quantity", "l_tax", "flat"])
    out = scale.scale(li, stats)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[r(c).alias(c) for c in stats])


@query("M2_regime_clusters")
def _(t: Tables):
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("s1"), (F.col("p_retailprice") / 100).alias("s2"))
    model = scale.fit_regimes(p, ["s1", "s2"], 6)
    return scale.assign_regimes(p, model, ["s1", "s2"]).select("p_partkey", "regime")


@query("M2_set_points", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 6 AS regime, l_linenumber % 6 * 10 + l_tax AS s1, l_linenumber * l_linenumber % 6 * 0.5 + l_discount AS s2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(regime AS INTEGER) AS regime, {R('avg(round(s1, 3)) OVER w')} AS centre_s1, {R('avg(round(s2, 3)) OVER w')} AS centre_s2 FROM x WINDOW w AS (PARTITION BY regime)""")
def _(t: Tables):
    g = F.col("l_linenumber") % 6
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (g * 10 + F.col("l_tax")).alias("s1"),
                          (F.col("l_linenumber") * F.col("l_linenumber") % 6 * F.lit(0.5) + F.col("l_discount")).alias("s2"))
    centres = scale.fit_set_points(x, ["s1", "s2"], 6)
    at = lambda j: F.get(F.array(*[F.lit(c[j]) for c in centres]), F.col("regime"))
    out = scale.assign_set_points(x, centres, ["s1", "s2"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "regime", r(at(0)).alias("centre_s1"), r(at(1)).alias("centre_s2"))


REGIME = "CAST(l_tax * 100 AS INTEGER) // 3 + CASE WHEN l_suppkey % 50 = 0 THEN 100 ELSE 0 END"


@query("M3_regime_scaling", f"""
WITH x AS (SELECT *, {REGIME} AS regime FROM lineitem), s AS (SELECT regime, avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM x WHERE l_suppkey % 5 <> 0 GROUP BY regime)
SELECT l_orderkey, l_linenumber, l_partkey, regime, {R('CASE WHEN m IS NULL THEN l_quantity ELSE (l_quantity - m) / (CASE WHEN sd = 0 THEN 1 ELSE sd END) END')} AS l_quantity FROM x LEFT JOIN s USING (regime)""")
def _(t: Tables):
    regime = F.floor(F.round(F.col("l_tax") * 100) / 3) + F.when(F.col("l_suppkey") % 50 == 0, 100).otherwise(0)
    li = t.lineitem.withColumn("regime", regime.cast("int"))
    stats = scale.regime_stats(li.where("l_suppkey % 5 <> 0"), "regime", ["l_quantity"])
    out = scale.scale_by_regime(li, stats, "regime", ["l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "regime", r("l_quantity").alias("l_quantity"))


@query("M4_dominant_regime", f"""
WITH {LI}, x AS (SELECT *, l_linenumber % 3 AS reg FROM li), {windows_sql('x', 'l_suppkey', 30, 10)},
st AS (SELECT reg, avg(l_quantity) AS m, stddev_pop(l_quantity) + 1e-10 AS s FROM x WHERE reg <> 2 GROUP BY reg),
md AS (SELECT obj, win, reg FROM (SELECT obj, win, reg, row_number() OVER (PARTITION BY obj, win ORDER BY count(*) DESC, reg) AS k FROM wr GROUP BY obj, win, reg) WHERE k = 1),
nw AS (SELECT wr.obj, wr.win, md.reg, wr.off, CASE WHEN m IS NULL THEN (l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 1e-10) ELSE (l_quantity - m) / s END AS z
  FROM wr JOIN md ON md.obj = wr.obj AND md.win = wr.win LEFT JOIN st ON st.reg = md.reg WINDOW w AS (PARTITION BY wr.obj, wr.win)),
nd AS (SELECT *, z - lag(z) OVER (PARTITION BY obj, win ORDER BY off) AS d1 FROM nw)
SELECT obj, win, reg AS regime, {R('avg(z)')} AS l_quantity_mean, {R('stddev_pop(z)')} AS l_quantity_std, {R('min(z)')} AS l_quantity_min, {R('max(z)')} AS l_quantity_max, {R('stddev_pop(d1)')} AS l_quantity_d1_std FROM nd GROUP BY obj, win, reg""")
def _(t: Tables):
    s = t.supply().withColumn("regime", (F.col("l_linenumber") % 3).cast("int"))
    stats = scale.regime_stats(s.where("regime <> 2"), "regime", ["l_quantity"], pad=1e-10)

    def feats(sp):
        return {**Ft.time_domain(sp, "l_quantity"), **Ft.rate(sp, "l_quantity"),
                "regime": sp.agg(lambda c: F.mode(c, True), "regime")}
    w = window_features(s, ["l_suppkey"], SUPPLY_ORDER, 30, 10, feats, stages=Ft.difference_stages(["l_quantity"]), rows=t.rows("lineitem"))
    out = scale.dominant_regime_scaled(w, stats, "regime", ["l_quantity"])
    return out.select(F.col("l_suppkey").alias("obj"), "win", "regime", *[r(f"l_quantity_{c}").alias(f"l_quantity_{c}") for c in ("mean", "std", "min", "max", "d1_std")])


@query("M5_named_weights", f"""
WITH {EV} SELECT {', '.join(f"{R(f'{w} * avg({c})', 4)} AS {n}" for n, w, c in (('v_mean', 0.5, 'v'), ('k_mean', 4.0, 'k')))}, count(*) AS n FROM ev""")
def _(t: Tables):
    w = C.ASTEROID_WEIGHTS
    return t.history().agg(r(F.lit(w["q_mean"]) * F.avg("v"), 4).alias("v_mean"), r(F.lit(w["gap_ratio"]) * F.avg("k"), 4).alias("k_mean"),
                           F.count(F.lit(1)).alias("n"))


# lineitem columns as the channels of decaying orbits
_DECAY = {"periapsis": "l_quantity", "mean_motion": "l_extendedprice / 1000", "mean_motion_dot": "l_discount", "bstar": "l_tax",
          "eccentricity": "CAST(l_linenumber AS DOUBLE)", "apoapsis": "CAST(l_partkey % 100 AS DOUBLE)"}
_DECAY_CHANNEL_SQL = {"periapsis": 2.0, "mean_motion": 1.5, "mean_motion_dot": 3.0, "bstar": 1.5, "eccentricity": 0.8, "apoapsis": 1.0}
_CC = lambda a, b: f"coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0)"
_PAIRED = [(a, b) for i, a in enumerate(_DECAY) for b in list(_DECAY)[i + 1:]]
# feature: (aggregate, weight = channel x class; pairs of channels 1.2)
_DECAY_SQL = ({f"{c}_{n}": (f"{fn}({c})", w) for c, w in _DECAY_CHANNEL_SQL.items() for n, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))}
              | {f"{c}_r1_mean": (f"avg(d_{c} / dt)", 2.0 * w) for c, w in _DECAY_CHANNEL_SQL.items()}
              | {f"{c}_ratio": (f"avg({c}) FILTER (off >= 15) / (abs(avg({c}) FILTER (off < 15)) + 1e-10)", 2.5 * w) for c, w in _DECAY_CHANNEL_SQL.items()}
              | {f"corr_{a}_{b}": (_CC(a, b), 1.2) for a, b in _PAIRED})


@query("M5_channel_class_scores", f"""
WITH {LI}, u AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _DECAY.items())} FROM li), {windows_sql('u', 'l_suppkey', 30, 5)},
a AS (SELECT *, greatest(day - lag(day) OVER w, 1e-6) AS dt, {', '.join(f'{c} - lag({c}) OVER w AS d_{c}' for c in _DECAY)} FROM wr WINDOW w AS (PARTITION BY obj, win ORDER BY off)),
f AS (SELECT obj, win, {', '.join(f'{e} AS {n}' for n, (e, _) in _DECAY_SQL.items())} FROM a GROUP BY obj, win),
s AS (SELECT {', '.join(f'avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}' for n in _DECAY_SQL)} FROM f)
SELECT obj, win, {R(' + '.join(f'{w} * coalesce(({n} - m_{n}) / CASE WHEN s_{n} = 0 THEN 1 ELSE s_{n} END, 0)' for n, (_, w) in _DECAY_SQL.items()), 5)} AS score FROM f, s""")
def _(t: Tables):
    from driftline.plans import orbits

    s = t.lineitem.withColumn("day", F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(86400000000.0))
    s = s.select("l_suppkey", *[c for c in SUPPLY_ORDER], *[F.expr(e).cast("double").alias(c) for c, e in _DECAY.items()])
    w = orbits.decay_windows(s, "l_suppkey", SUPPLY_ORDER, time="day", channels=list(_DECAY), rows=t.rows("lineitem"))
    weights = C.decay_weights()
    names = [f for f, cls, _ in C.decay_catalogue() if cls != "rate" or f.endswith("r1_mean")]
    w = materialise(w.select(F.col("l_suppkey").alias("obj"), "win", *names))
    return scale.weighted_score(w, scale.fit_stats(w, names), weights).select("obj", "win", r("score", 5).alias("score"))


CH4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CH_GROUP = {"l_quantity": "high", "l_extendedprice": "medium_high", "l_discount": "medium", "l_tax": "low"}


@query("M6_group_class_weights", f"""
WITH m AS (UNPIVOT (SELECT avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME channel VALUE x),
c(feature, class, channel) AS (VALUES {', '.join(f"('{f}', '{c}', '{ch}')" for f, c, ch in C.monitoring_catalogue(CH4) if ch)})
SELECT feature, class, channel, {R("(CASE channel WHEN 'l_quantity' THEN 2.0 WHEN 'l_extendedprice' THEN 1.5 WHEN 'l_discount' THEN 1.0 ELSE 0.7 END) * (CASE class WHEN 'rate' THEN 1.5 WHEN 'frequency' THEN 1.3 ELSE 1.0 END)")} AS weight,
  {R("x * (CASE channel WHEN 'l_quantity' THEN 2.0 WHEN 'l_extendedprice' THEN 1.5 WHEN 'l_discount' THEN 1.0 ELSE 0.7 END)", 3)} AS weighted_mean FROM c JOIN m USING (channel)""")
def _(t: Tables):
    cat = C.catalogue_table(t.spark, C.monitoring_catalogue(CH4))
    chan = {c: C.GROUP_WEIGHTS[g] for c, g in CH_GROUP.items()}
    w = C.weight_table(cat, chan, C.CLASS_WEIGHTS, C.GROUP_WEIGHTS["medium_high"])
    means = t.lineitem.agg(*[F.avg(c).alias(c) for c in CH4]).unpivot([], CH4, "channel", "x")
    cw = t.spark.createDataFrame(list(chan.items()), "channel string, cw double")
    out = w.join(F.broadcast(means), "channel").join(F.broadcast(cw), "channel")
    return out.select("feature", "class", "channel", r("weight").alias("weight"), r(F.col("x") * F.col("cw"), 3).alias("weighted_mean"))


@query("M7_apply_weights", f"WITH {SD} SELECT obj, win, {R('2 * (v_slope - m_v_slope) / s_v_slope')} AS v_slope, {R('1.5 * (k_ratio - m_k_ratio) / s_k_ratio')} AS k_ratio FROM lf, st")
def _(t: Tables):
    windows = materialise(flow(t).windows(t.history()).select("user_id", "win", "v_slope", "k_ratio"))
    out = lda.prepare(windows, ["v_slope", "k_ratio"], scale.fit_stats(windows, ["v_slope", "k_ratio"]), WEIGHTS)
    return out.select(F.col("user_id").alias("obj"), "win", r("v_slope").alias("v_slope"), r("k_ratio").alias("k_ratio"))


@query("J8_frozen_scores", f"WITH {SD} SELECT obj, win, label, {R('proj')} AS proj FROM sc")
def _(t: Tables):
    f = flow(t)
    windows = materialise(f.windows(t.history()).select("user_id", "win", "label", *COEF))
    return frozen(windows, COEF, WEIGHTS).score(windows).select(F.col("user_id").alias("obj"), "win", "label", r("proj").alias("proj"))


TWO = f"""{SD}, z AS (SELECT label, (v_mean - m_v_mean) / s_v_mean AS a, (k_mean - m_k_mean) / s_k_mean AS b FROM lf, st),
c AS (SELECT *, a - avg(a) OVER (PARTITION BY label) AS ca, b - avg(b) OVER (PARTITION BY label) AS cb FROM z),
w AS (SELECT sum(ca * ca) / (count(*) - 2) AS waa, sum(ca * cb) / (count(*) - 2) AS wab, sum(cb * cb) / (count(*) - 2) AS wbb,
  avg(a) FILTER (label = 1) - avg(a) FILTER (label = 0) AS da, avg(b) FILTER (label = 1) - avg(b) FILTER (label = 0) AS db FROM c),
iv AS (SELECT *, (wbb * da - wab * db) / (waa * wbb - wab * wab) AS xa, (waa * db - wab * da) / (waa * wbb - wab * wab) AS xb FROM w),
nm AS (SELECT *, sqrt(xa * da + xb * db) AS s FROM iv)"""


@query("M8_two_class_fit", f"""WITH {TWO} SELECT 'v_mean' AS feature, {R('xa / s')} AS coef FROM nm UNION ALL SELECT 'k_mean', {R('xb / s')} FROM nm""")
def _(t: Tables):
    windows = materialise(flow(t).windows(t.history()).select("label", "v_mean", "k_mean"))
    model = lda.fit_two_class(windows, ["v_mean", "k_mean"], "label")
    return model.table(t.spark).select("feature", r("coef").alias("coef"))


@query("M8_fitted_monitor")
def _(t: Tables):
    monitor, near = fit_monitor(t.history(), flow(t))
    return near.select("user_id", "win", "label", "proj", "d_mean", F.lit(monitor.epsilon).alias("epsilon"))


@query("M9_bucket_fit")
def _(t: Tables):
    f = flow(t)
    windows = materialise(f.windows(t.history()).select("user_id", "win", "rul", *f.features))
    from driftline.functions.scalar import width_bucket_clipped
    model = lda.fit_buckets(windows.withColumn("bucket", width_bucket_clipped("rul", 25.0, 6)), f.features, "bucket")
    return model.score(windows).select("user_id", "win", "rul", "proj")


# two classes of two features: shrunk covariances (unit diagonal, correlation less by the intensity) in closed form
@query("M9_two_class_scores", f"""
WITH {SD}, z AS (SELECT obj, win, label, (v_mean - m_v_mean) / s_v_mean AS a, (k_mean - m_k_mean) / s_k_mean AS b FROM lf, st),
g AS (SELECT label, count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r FROM z GROUP BY label),
q AS (SELECT g.*, f FROM g JOIN (SELECT label, avg(pow(pow((a - ma) / sa, 2) + pow((b - mb) / sb, 2), 2)) AS f FROM z JOIN g USING (label) GROUP BY label) USING (label)),
i AS (SELECT *, greatest(least((f - 2 - 2 * r * r) / (2 * n), r * r), 0) / (r * r) AS s FROM q),
w AS (SELECT sum(n * sa * sa) / sum(n) AS waa, sum(n * (1 - s) * r * sa * sb) / sum(n) AS wab, sum(n * sb * sb) / sum(n) AS wbb, sum(n * ma) / sum(n) AS ga, sum(n * mb) / sum(n) AS gb,
  max(ma) FILTER (label = 0) - max(ma) FILTER (label = 1) AS da, max(mb) FILTER (label = 0) - max(mb) FILTER (label = 1) AS db FROM i),
x AS (SELECT *, (wbb * da - wab * db) / (waa * wbb - wab * wab) AS xa, (waa * db - wab * da) / (waa * wbb - wab * wab) AS xb FROM w)
SELECT obj, win, label, {R('((a - ga) * xa + (b - gb) * xb) / sqrt(xa * da + xb * db)', 5)} AS proj FROM z, x""")
def _(t: Tables):
    windows = materialise(flow(t).windows(t.history()).select("user_id", "win", "label", "v_mean", "k_mean"))
    model = lda.fit_buckets(windows, ["v_mean", "k_mean"], "label")
    return model.score(windows).select(F.col("user_id").alias("obj"), "win", "label", r("proj", 5).alias("proj"))


@query("M10_two_components", f"""
WITH {SD}, m AS (SELECT avg(v_mean) AS ma, avg(k_mean) AS mb, 0.5 * atan2(2 * covar_pop(v_mean, k_mean), var_pop(v_mean) - var_pop(k_mean)) AS turn FROM lf)
SELECT obj, win, {R('abs((v_mean - ma) * cos(turn) + (k_mean - mb) * sin(turn))', 5)} AS first, {R('abs((k_mean - mb) * cos(turn) - (v_mean - ma) * sin(turn))', 5)} AS second,
  {R('pow(v_mean - ma, 2) + pow(k_mean - mb, 2)', 4)} AS norm FROM lf, m""")
def _(t: Tables):
    windows = materialise(flow(t).windows(t.history()).select("user_id", "win", "v_mean", "k_mean"))
    model, means = lda.fit_pca(windows, ["v_mean", "k_mean"], 2)
    e = lda.project_pca(windows, model, means)
    at = [F.col("embedding")[i] for i in (0, 1)]
    return e.select(F.col("user_id").alias("obj"), "win", r(F.abs(at[0]), 5).alias("first"), r(F.abs(at[1]), 5).alias("second"), r(at[0] * at[0] + at[1] * at[1], 4).alias("norm"))


@query("M10_principal_components")
def _(t: Tables):
    f = flow(t)
    windows = materialise(f.windows(t.history()).select("user_id", "win", *f.features))
    scaled = scale.scale(windows, scale.fit_stats(windows, f.features))
    model, means = lda.fit_pca(scaled, f.features, 8)
    return lda.project_pca(scaled, model, means).select("user_id", "win", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("M11_scatter_condition", f"""WITH {TWO}, e AS (SELECT (waa + wbb) / 2 AS m, sqrt(pow((waa - wbb) / 2, 2) + wab * wab) AS d FROM w) SELECT {R('(m + d) / (m - d)', 5)} AS condition FROM e""")
def _(t: Tables):
    windows = materialise(flow(t).windows(t.history()).select("label", "v_mean", "k_mean"))
    model = lda.fit_two_class(windows, ["v_mean", "k_mean"], "label")
    return t.spark.createDataFrame([(model.condition,)], "c double").select(r("c", 5).alias("condition"))


LOADS = "l AS (UNPIVOT (SELECT avg(l_quantity) - 26 AS l_quantity_mean, stddev_pop(l_quantity) AS l_quantity_std, -avg(l_tax) AS l_tax_mean, stddev_pop(l_tax) AS l_tax_std, corr(l_quantity, l_tax) AS corr_l_quantity_l_tax FROM lineitem) ON COLUMNS(*) INTO NAME feature VALUE coef)"


def _loads(t: Tables):
    row = t.lineitem.agg((F.avg("l_quantity") - 26).alias("l_quantity_mean"), F.stddev_pop("l_quantity").alias("l_quantity_std"),
                         (-F.avg("l_tax")).alias("l_tax_mean"), F.stddev_pop("l_tax").alias("l_tax_std"), F.corr("l_quantity", "l_tax").alias("corr_l_quantity_l_tax"))
    return row.unpivot([], row.columns, "feature", "coef")


@query("M12_top_loadings", f"WITH {LOADS} SELECT feature, {R('abs(coef)')} AS abs_coef FROM l ORDER BY abs(coef) DESC LIMIT 3")
def _(t: Tables):
    return _loads(t).select("feature", r(F.abs("coef")).alias("abs_coef")).orderBy(F.desc("abs_coef")).limit(3)


@query("M13_loading_shares", f"""
WITH {LOADS}, s AS (SELECT CASE WHEN starts_with(feature, 'corr') THEN '_covariance' WHEN starts_with(feature, 'l_q') THEN 'l_quantity' ELSE 'l_tax' END AS channel, sum(abs(coef)) AS x FROM l GROUP BY 1)
SELECT channel, {R('x')} AS loading, {R('100 * x / (SELECT sum(x) FROM s)')} AS pct FROM s""")
def _(t: Tables):
    cat = C.catalogue_table(t.spark, C.monitoring_catalogue(["l_quantity", "l_tax"]))
    out = lda.loading_shares(_loads(t), cat, "channel")
    return out.select("channel", r("loading").alias("loading"), r("pct").alias("pct"))


@query("O7_sorted_loadings", f"WITH {LOADS} SELECT feature, {R('coef')} AS coef FROM l ORDER BY abs(coef) DESC")
def _(t: Tables):
    return _loads(t).orderBy(F.desc(F.abs("coef"))).select("feature", r("coef").alias("coef"))


# ---- D: basins and distances --------------------------------------------------


def vectors(t: Tables, where: str | None = None):
    e = t.embeddings
    return (e.where(where) if where else e).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def knn_sql(queries: str, points: str, k: int, extra: str = "true") -> str:
    """nn: the k nearest points of every query, ties by id."""
    return f"""ds AS (SELECT q.vec_id AS id, p.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS distance
  FROM (SELECT * FROM embeddings WHERE {queries}) q, (SELECT * FROM embeddings WHERE {points}) p WHERE {extra}),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM ds) WHERE rank <= {k})"""


@query("D1_failure_basin", f"WITH {SD} SELECT obj, win, {R('proj')} AS proj FROM sc WHERE rul <= 7")
def _(t: Tables):
    windows = materialise(flow(t).windows(t.history()).select("user_id", "win", "rul", *COEF))
    return frozen(windows, COEF, WEIGHTS).score(windows).where("rul <= 7").select(F.col("user_id").alias("obj"), "win", r("proj").alias("proj"))


@query("D2_tightened_basin", f"WITH {SD} SELECT obj, win, {R('proj')} AS proj FROM sc WHERE label = 1 AND proj >= (SELECT avg(proj) - stddev_pop(proj) FROM bs)")
def _(t: Tables):
    windows = materialise(flow(t).windows(t.history()).select("user_id", "win", "label", *COEF))
    out = tightened_basin(frozen(windows, COEF, WEIGHTS).score(windows), F.col("label") == 1)
    return out.select(F.col("user_id").alias("obj"), "win", r("proj").alias("proj"))


@query("D3_nominal_basin", f"WITH {SD} SELECT obj, win, {R('proj')} AS proj FROM sc WHERE rul > 12")
def _(t: Tables):
    windows = materialise(flow(t).windows(t.history()).select("user_id", "win", "rul", *COEF))
    return frozen(windows, COEF, WEIGHTS).score(windows).where("rul > 12").select(F.col("user_id").alias("obj"), "win", r("proj").alias("proj"))


@query("D4_J6_basin_distance", f"WITH {knn_sql('true', 'label = 0', 5)} SELECT id, {R('avg(distance)')} AS d_mean FROM nn GROUP BY id")
def _(t: Tables):
    near = knn.neighbours(vectors(t), vectors(t, "label = 0"), 5)
    return knn.neighbour_summary(near).select("id", r("d_mean").alias("d_mean"))


@query("D5_distance_on_line", f"WITH {SD} SELECT obj, win, {R('d_mean')} AS d_mean FROM sd")
def _(t: Tables):
    return scored(t).select("obj", "win", r("d_mean").alias("d_mean"))


@query("D6_corpus_distance", f"WITH {knn_sql('true', 'true', 5)} SELECT id, {R('max(distance)')} AS d_kth FROM nn GROUP BY id")
def _(t: Tables):
    return knn.neighbour_summary(knn.neighbours(vectors(t), vectors(t), 5)).select("id", r("d_kth").alias("d_kth"))


@query("D7_leave_self_out", f"WITH {knn_sql('label = 0', 'label = 0', 5, 'q.vec_id <> p.vec_id')} SELECT id, {R('avg(distance)')} AS d_mean FROM nn GROUP BY id")
def _(t: Tables):
    b = vectors(t, "label = 0")
    return knn.neighbour_summary(knn.neighbours(b, b, 5, exclude_self=True)).select("id", r("d_mean").alias("d_mean"))


@query("D8_fire", f"WITH {SD} SELECT obj, win, d_mean < {P5} AS fired FROM sd")
def _(t: Tables):
    s = materialise(scored(t))
    eps = calibrate.quantile_threshold(s.where("label = 0"), "d_mean", 0.05, rows=t.rows("events"))
    return s.select("obj", "win", detect.fire("d_mean", eps).alias("fired"))


@query("D9_four_states", f"""
WITH {knn_sql('true', 'label = 0', 5)}, a AS (SELECT id, avg(distance) AS df FROM nn GROUP BY id),
{knn_sql('true', 'label > 0', 5).replace('ds AS', 'ds2 AS').replace('nn AS', 'nn2 AS').replace('FROM ds)', 'FROM ds2)')}, b AS (SELECT id, avg(distance) AS dn FROM nn2 GROUP BY id),
{knn_sql('true', 'true', 5).replace('ds AS', 'ds3 AS').replace('nn AS', 'nn3 AS').replace('FROM ds)', 'FROM ds3)')}, c AS (SELECT id, max(distance) AS dc FROM nn3 GROUP BY id)
SELECT id, CASE WHEN dc > 1.13 THEN 'TERRA_INCOGNITA' WHEN df < 1.05 THEN 'FAILURE_APPROACH' WHEN dn < 0.9 THEN 'NOMINAL' ELSE 'WATCH' END AS state FROM a JOIN b USING (id) JOIN c USING (id)""")
def _(t: Tables):
    q = vectors(t)
    f = knn.neighbour_summary(knn.neighbours(q, vectors(t, "label = 0"), 5)).select("id", F.col("d_mean").alias("d_failure"))
    n = knn.neighbour_summary(knn.neighbours(q, vectors(t, "label > 0"), 5)).select("id", F.col("d_mean").alias("d_nominal"))
    c = knn.neighbour_summary(knn.neighbours(q, q, 5)).select("id", F.col("d_kth").alias("d_ood"))
    return knn.four_state(f.join(n, "id").join(c, "id"), 1.05, 0.9, 1.13).select("id", "state")


@query("D10_similar_cases", f"WITH {knn_sql('vec_id >= 0', 'vec_id >= 0', 5)} SELECT id, CAST(rank AS INTEGER) AS rank, neighbour, {R('distance')} AS distance FROM nn")
def _(t: Tables):
    return knn.neighbours(vectors(t), vectors(t), 5).withColumn("distance", r("distance"))


@query("O4_k_smallest", f"WITH {knn_sql('true', 'true', 3)} SELECT id, neighbour FROM nn")
def _(t: Tables):
    return knn.neighbours(vectors(t), vectors(t), 3).select("id", "neighbour")


@query("D4_large_text_ids", f"""
WITH e AS (SELECT 'v' || vec_id AS id, list_transform(embedding, lambda x: CASE WHEN vec_id % 9 = 0 THEN CAST(label AS DOUBLE) ELSE CAST(x AS DOUBLE) END) AS v FROM embeddings),
ds AS (SELECT q.id, p.id AS neighbour, list_distance(q.v, p.v) AS distance FROM e q, e p WHERE q.id <> p.id)
SELECT * FROM (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INTEGER) AS rank, neighbour, {R('distance', 5)} AS distance FROM ds) WHERE rank <= 4""")
def _(t: Tables):
    # the partitioned form, forced by a small bound, with text ids and many equal vectors
    e = t.embeddings
    same = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 9 == 0, F.col("label").cast("double")).otherwise(x.cast("double")))
    v = e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), same.alias("vec"))
    return knn.neighbours(v, v, 4, exclude_self=True, bound=640, tile=100).withColumn("distance", r("distance", 5))


# ---- C: calibration -----------------------------------------------------------

@query("C1_percentile_sweep", f"""
WITH {SD}, q AS (SELECT quantile_cont(d_mean, [{', '.join(f'CAST({p!r} AS DOUBLE)' for p in calibrate.percentile_grid())}]) AS qs FROM sd),
g AS (SELECT unnest(qs) AS eps, generate_subscripts(qs, 1) - 1 AS idx FROM q),
cf AS (SELECT idx, eps, count(*) FILTER (d_mean < eps AND label = 1) AS tp, count(*) FILTER (d_mean < eps AND label = 0) AS fp, count(*) FILTER (d_mean >= eps AND label = 1) AS fn FROM g, sd GROUP BY ALL)
SELECT CAST(idx AS INTEGER) AS idx, {R('eps')} AS eps, tp, fp, fn, {R('2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-10, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn))')} AS f1 FROM cf""")
def _(t: Tables):
    s = materialise(scored(t))
    out = calibrate.f1_percentile_sweep(s, "d_mean", F.col("label") == 1, rows=t.rows("events"))
    return out.select("idx", r("eps").alias("eps"), "tp", "fp", "fn", r("f1").alias("f1"))


@query("C2_approach_zone", f"WITH {SD} SELECT {R('quantile_disc(d_mean, CAST(0.9 AS DOUBLE))')} AS eps FROM sd WHERE rul > 7 AND rul <= 12")
def _(t: Tables):
    s = materialise(scored(t))
    return calibrate.approach_zone(s, "d_mean", "rul", 7.0, 0.9, 5.0, rows=t.rows("events")).select(r("eps").alias("eps"))


@query("C3_operational_quantile", f"WITH {SD} SELECT {R(P5)} AS eps")
def _(t: Tables):
    s = scored(t).where("label = 0")
    from driftline.operators.ordering import quantiles
    return quantiles(s, "d_mean", {"eps": 0.05}, rows=t.rows("events")).select(r("eps").alias("eps"))


@query("C4_basin_self_quantile", f"WITH {knn_sql('label = 0', 'label = 0', 5, 'q.vec_id <> p.vec_id')}, d AS (SELECT avg(distance) AS x FROM nn GROUP BY id) SELECT {R('quantile_cont(x, CAST(0.95 AS DOUBLE))')} AS eps FROM d")
def _(t: Tables):
    from driftline.operators.ordering import quantiles
    b = vectors(t, "label = 0")
    d = knn.neighbour_summary(knn.neighbours(b, b, 5, exclude_self=True))
    return quantiles(d, "d_mean", {"eps": 0.95}, rows=t.rows("embeddings")).select(r("eps").alias("eps"))


@query("C5_ood_quantile", f"WITH {scored_sql(corpus=True)} SELECT {R('quantile_cont(d_corpus, CAST(0.95 AS DOUBLE))', 7)} AS eps FROM sd")
def _(t: Tables):
    from driftline.operators.ordering import quantiles
    return quantiles(scored(t, corpus=True), "d_corpus", {"eps": 0.95}, rows=t.rows("events")).select(r("eps", 7).alias("eps"))


@query("C6_conformal", f"""
WITH {SD}, n AS (SELECT count(*) AS n FROM sd WHERE label = 0), o AS (SELECT d_mean, row_number() OVER (ORDER BY d_mean) AS rk FROM sd WHERE label = 0)
SELECT 'upper' AS side, {R('(1 - x) * a + x * b')} AS eps, {R('CAST(0.1 AS DOUBLE) + 1.0 / (n + 1)')} AS bound FROM (
  SELECT n, pos - floor(pos) AS x, (SELECT d_mean FROM o WHERE rk = floor(pos) + 1) AS a, (SELECT d_mean FROM o WHERE rk = ceil(pos) + 1) AS b FROM (SELECT n, least(1, CAST(0.9 AS DOUBLE) * (n + 1) / n) * (n - 1) AS pos FROM n))
UNION ALL SELECT 'lower', {R('(SELECT d_mean FROM o WHERE rk = floor(CAST(0.1 AS DOUBLE) * (n + 1)))')}, {R('floor(CAST(0.1 AS DOUBLE) * (n + 1)) / (n + 1)')} FROM n""")
def _(t: Tables):
    s = materialise(scored(t)).where("label = 0")
    out = None
    for side in ("upper", "lower"):
        one = calibrate.conformal(s, "d_mean", 0.1, side=side, rows=t.rows("events")).select(F.lit(side).alias("side"), r("eps").alias("eps"), r("bound").alias("bound"))
        out = one if out is None else out.unionByName(one)
    return out


ALPHAS = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20)


@query("C7_calibration_curve", f"""
WITH {SD}, cal AS (SELECT d_mean FROM sd WHERE label = 0 AND win % 2 = 0), tst AS (SELECT * FROM sd WHERE win % 2 = 1), n AS (SELECT count(*) AS n FROM cal),
o AS (SELECT d_mean, row_number() OVER (ORDER BY d_mean) AS rk FROM cal),
p AS (SELECT a AS target, least(1, (1 - a) * (n + 1) / n) * (n - 1) AS pos, n FROM n, (SELECT unnest([{', '.join(f'CAST({a} AS DOUBLE)' for a in ALPHAS)}]) AS a)),
g AS (SELECT target, a + 1.0 / (n + 1) AS bound, x.d_mean + (pos - floor(pos)) * (y.d_mean - x.d_mean) AS eps FROM (SELECT *, target AS a FROM p) JOIN o x ON x.rk = floor(pos) + 1 JOIN o y ON y.rk = ceil(pos) + 1)
SELECT {R('target')} AS target, {R('bound')} AS bound, {R('eps')} AS eps, count(*) FILTER (label = 1 AND d_mean < eps) AS tp, count(*) FILTER (label = 0 AND d_mean < eps) AS fp,
  count(*) FILTER (label = 1 AND d_mean >= eps) AS fn, count(*) FILTER (label = 0 AND d_mean >= eps) AS tn FROM g, tst GROUP BY g.target, g.bound, g.eps""")
def _(t: Tables):
    s = materialise(scored(t))
    out = calibrate.calibration_curve(s.where("label = 0 AND win % 2 = 0"), s.where("win % 2 = 1"), "d_mean", F.col("label") == 1, ALPHAS, rows=t.rows("events"))
    return out.select(r("target").alias("target"), r("bound").alias("bound"), r("eps").alias("eps"), "tp", "fp", "fn", "tn")


FINAL = "fin AS (SELECT obj, arg_max(d_mean, win) AS d, max(rul) AS far FROM sd GROUP BY obj), fo AS (SELECT *, obj % 3 = 0 AS due FROM fin)"


def finals(t: Tables):
    f = detect.distance_profile(scored(t), ["obj"], "win", "d_mean")
    return materialise(f.select("obj", F.col("d_final").alias("d"), (F.col("obj") % 3 == 0).alias("due")))


def sweep_sql(sd: str) -> str:
    return f"""{sd}, {FINAL}, mm AS (SELECT min(d) * 0.5 AS a, max(d) * 1.1 AS b FROM fo),
g AS (SELECT i AS idx, CASE WHEN i = 199 THEN b ELSE a + (b - a) / 199 * i END AS eps FROM mm, range(200) x(i)),
cf AS (SELECT idx, eps, count(*) FILTER (d < eps AND due) AS tp, count(*) FILTER (d < eps AND NOT due) AS fp, count(*) FILTER (d >= eps AND due) AS fn FROM g, fo GROUP BY ALL),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS rc FROM cf),
sw AS (SELECT *, CASE WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END AS f1 FROM pr)"""


@query("C8_precision_recall_sweep", f"WITH {sweep_sql(SD)} SELECT CAST(idx AS INTEGER) AS idx, {R('eps')} AS eps, {R('p')} AS precision, {R('rc')} AS recall, {R('f1')} AS f1 FROM sw")
def _(t: Tables):
    out = calibrate.precision_recall_sweep(finals(t), "d", F.col("due"))
    return out.select("idx", *[r(c).alias(c) for c in ("eps", "precision", "recall", "f1")])


@query("C9_midpoint", f"WITH {SD}, {FINAL} SELECT {R('(max(d) FILTER (due) + min(d) FILTER (NOT due)) / 2')} AS eps, {R('max(d) FILTER (due)')} AS max_positive, {R('min(d) FILTER (NOT due)')} AS min_negative FROM fo")
def _(t: Tables):
    out = calibrate.midpoint(finals(t), "d", F.col("due"))
    return out.select(*[r(c).alias(c) for c in out.columns])


SWEEP = [(w, b, k) for w in (20, 30) for b in (5.0, 9.0) for k in (3, 5)]


@query("C10_parameter_sweep", " UNION ALL ".join(
    f"SELECT * FROM (WITH {sweep_sql(scored_sql(w, b, k))} SELECT {w} AS width, CAST({b} AS DOUBLE) AS basin, {k} AS k, {R('f1')} AS best_f1, {R('eps', 5)} AS best_eps FROM sw ORDER BY round(f1, 9) DESC, idx LIMIT 1)"
    for w, b, k in SWEEP))
def _(t: Tables):
    of_width = {w: projected(t, w) for w in sorted({w for w, _, _ in SWEEP})}
    out = None
    for w, b, k in SWEEP:
        near = knn.distance_on_line(of_width[w], of_width[w].where(F.col("rul") <= b), "proj", k=k, kth=None)
        f = detect.distance_profile(near, ["obj"], "win", "d_mean").select(F.col("d_final").alias("d"), (F.col("obj") % 3 == 0).alias("due"))
        sweep = calibrate.precision_recall_sweep(materialise(f), "d", F.col("due")).withColumn("f1", F.round("f1", 9))
        best = calibrate.best_row(sweep).select(F.lit(w).alias("width"), F.lit(b).alias("basin"), F.lit(k).alias("k"), r("f1").alias("best_f1"), r("eps", 5).alias("best_eps"))
        out = best if out is None else out.unionByName(best)
    return out


# ---- E: detection -------------------------------------------------------------

FIRED = f"{SD}, ep AS (SELECT {P5} AS eps), fr AS (SELECT sd.*, d_mean < eps AS fired FROM sd, ep)"


def fired(t: Tables, p: float = 0.05):
    s = materialise(scored(t))
    return s, calibrate.quantile_threshold(s.where("label = 0"), "d_mean", p, rows=t.rows("events"))


@query("E1_first_fire", f"""
WITH {FIRED} SELECT obj, count(*) AS n_windows, count(*) FILTER (fired) AS n_fired, min(win) FILTER (fired) AS first_fire,
  {R('arg_min(rul, win) FILTER (fired)')} AS lead, coalesce(arg_min(rul, win) FILTER (fired) > 0, false) AS detected FROM fr GROUP BY obj""")
def _(t: Tables):
    monitor, near = fit_monitor(t.history(), flow(t), coef=COEF, weights=WEIGHTS)
    out = detect.first_fire(near, ["user_id"], "win", "rul", detect.fire("d_mean", monitor.epsilon))
    return out.withColumnRenamed("user_id", "obj").withColumn("lead", r("lead"))


@query("E2_sustained_fire", f"""
WITH {SD}, ep AS (SELECT quantile_cont(d_mean, CAST(0.6 AS DOUBLE)) AS eps FROM sd WHERE label = 0),
x AS (SELECT obj, win, rul, row_number() OVER w - 1 AS pos, sum(CASE WHEN d_mean < eps THEN 1 ELSE 0 END) OVER (w ROWS 2 PRECEDING) AS run FROM sd, ep WINDOW w AS (PARTITION BY obj ORDER BY win))
SELECT obj, count(*) AS n_windows, min(pos) FILTER (run = 3) AS fire_pos, {R('arg_min(rul, pos) FILTER (run = 3)')} AS lead FROM x GROUP BY obj""")
def _(t: Tables):
    s, eps = fired(t, 0.6)
    out = detect.sustained_fire(s, ["obj"], ["win"], "rul", detect.fire("d_mean", eps), 3, rows=t.rows("events"))
    return out.withColumn("lead", r("lead"))


@query("E3_runs", f"""
WITH {SD}, ep AS (SELECT quantile_cont(d_mean, CAST(0.6 AS DOUBLE)) AS eps FROM sd WHERE label = 0),
x AS (SELECT obj, win, t_end, d_mean < eps AS fired, sum(CASE WHEN d_mean < eps THEN 0 ELSE 1 END) OVER (PARTITION BY obj ORDER BY win) AS isl FROM sd, ep),
y AS (SELECT obj, isl, count(*) FILTER (fired) AS len, count(*) AS n, min(t_end) FILTER (fired) AS f FROM x GROUP BY obj, isl)
SELECT obj, max(len) AS max_consecutive, CAST(sum(n) AS BIGINT) AS n_windows, {R('min(f)')} AS first_excursion, {R('100 * sum(len) / sum(n)')} AS pct_below FROM y GROUP BY obj""")
def _(t: Tables):
    s, eps = fired(t, 0.6)
    out = detect.runs(s, ["obj"], ["win"], detect.fire("d_mean", eps), "t", rows=t.rows("events"))
    return out.select("obj", "max_consecutive", "n_windows", r("first_excursion").alias("first_excursion"), r("pct_below").alias("pct_below"))


@query("E4_sigma_crossing", f"""
WITH {EV}, s AS (SELECT avg(v) AS mv, stddev_samp(v) AS sv, avg(k) AS mk, stddev_samp(k) AS sk FROM ev WHERE user_id % 2 = 0)
SELECT user_id AS obj, min(pos) FILTER (greatest(abs(v - mv) / sv, abs(k - mk) / sk) > 2.5) AS crossing FROM ev, s GROUP BY user_id""")
def _(t: Tables):
    h = with_position(t.history(), ["user_id"], ["t", "event_id"], rows=t.rows("events"))
    stats = scale.fit_stats(h.where("user_id % 2 = 0"), ["v", "k"], sample=True)
    return detect.sigma_crossing(h, ["user_id"], "pos", ["v", "k"], stats, 2.5).withColumnRenamed("user_id", "obj")


INTERVENTION = f"""{FIRED}, a AS (SELECT obj, min(win) FILTER (fired) AS alert, max(win) + 30 AS total FROM fr GROUP BY obj),
sg AS (SELECT avg(v) AS mv, stddev_samp(v) AS sv FROM ev), b AS (SELECT user_id AS obj, min(pos) FILTER (abs(v - mv) / sv > 2.5) AS crossing FROM ev, sg GROUP BY user_id),
iw AS (SELECT obj, total, CASE WHEN alert IS NULL THEN 0 ELSE total - (alert + 29) END AS alert_lead, CASE WHEN crossing IS NULL THEN 0 ELSE total - crossing END AS threshold_lead, alert IS NOT NULL AS alert_fired, crossing IS NOT NULL AS threshold_fired FROM a JOIN b USING (obj))"""


def intervention(t: Tables):
    s, eps = fired(t)
    a = s.groupBy("obj").agg((F.min(F.when(detect.fire("d_mean", eps), F.col("win"))) + 29).alias("alert"), (F.max("win") + 30).alias("total"))
    h = with_position(t.history(), ["user_id"], ["t", "event_id"], rows=t.rows("events"))
    b = detect.sigma_crossing(h, ["user_id"], "pos", ["v"], scale.fit_stats(h, ["v"], sample=True), 2.5)
    return detect.intervention_window(a.join(b.withColumnRenamed("user_id", "obj"), "obj"), "total", "alert", "crossing")


@query("E5_intervention_window", f"WITH {INTERVENTION} SELECT obj, alert_lead, threshold_lead, alert_fired, threshold_fired, alert_lead - threshold_lead AS recovered FROM iw")
def _(t: Tables):
    return intervention(t).select("obj", "alert_lead", "threshold_lead", "alert_fired", "threshold_fired", "recovered")


@query("E6_distance_profile", f"WITH {SD} SELECT obj, {R('arg_max(d_mean, win)')} AS d_final, {R('min(d_mean)')} AS d_min, {R('avg(d_mean)')} AS d_avg, count(*) AS n_windows FROM sd GROUP BY obj")
def _(t: Tables):
    out = detect.distance_profile(scored(t), ["obj"], "win", "d_mean")
    return out.select("obj", *[r(c).alias(c) for c in ("d_final", "d_min", "d_avg")], "n_windows")


@query("E7_ood_objects", f"""
WITH {scored_sql(corpus=True)}, ep AS (SELECT quantile_cont(d_corpus, CAST(0.95 AS DOUBLE)) AS eps FROM sd)
SELECT obj, count(*) AS n_windows, {R('max(d_corpus)')} AS d_max, {R('avg(d_corpus)')} AS d_avg, {R('avg(CASE WHEN d_corpus > eps THEN 1 ELSE 0 END)')} AS share_ood, max(d_corpus) > any_value(eps) AS is_ood FROM sd, ep GROUP BY obj""")
def _(t: Tables):
    s = materialise(scored(t, corpus=True))
    eps = calibrate.quantile_threshold(s, "d_corpus", 0.95, rows=t.rows("events"))
    out = detect.ood_objects(s, ["obj"], "d_corpus", eps)
    return out.select("obj", "n_windows", *[r(c).alias(c) for c in ("d_max", "d_avg", "share_ood")], "is_ood")


LOOK = f"""{FIRED}, sh AS (SELECT obj, arg_min(rul, win) FILTER (fired AND rul <= 12) AS lead_short FROM fr GROUP BY obj), lg AS (SELECT obj, arg_min(rul, win) FILTER (fired) AS lead_long FROM fr GROUP BY obj)"""


@query("E8_J9_lookback_comparison", f"""
WITH {LOOK} SELECT obj, {R('lead_short')} AS lead_short, {R('lead_long')} AS lead_long, CASE WHEN lead_short IS NULL OR lead_long IS NULL THEN 'undetected'
  WHEN lead_long > lead_short + 7 THEN 'gained' WHEN lead_short > lead_long + 7 THEN 'lost' ELSE 'same' END AS verdict FROM sh JOIN lg USING (obj)""")
def _(t: Tables):
    s, eps = fired(t)
    f = detect.fire("d_mean", eps)
    short = detect.first_fire(s, ["obj"], "win", "rul", f & (F.col("rul") <= 12))
    out = detect.compare_lookbacks(short, detect.first_fire(s, ["obj"], "win", "rul", f), ["obj"])
    return out.withColumns({c: r(c) for c in ("lead_short", "lead_long")})


@query("E9_full_history", f"WITH {FIRED} SELECT obj, count(*) AS n_windows, count(*) FILTER (fired) AS n_fired, {R('max(rul) FILTER (fired)')} AS earliest_lead FROM fr GROUP BY obj")
def _(t: Tables):
    s, eps = fired(t)
    f = detect.fire("d_mean", eps)
    return s.groupBy("obj").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(f).alias("n_fired"), r(F.max(F.when(f, F.col("rul")))).alias("earliest_lead"))


MATCH = f"""{EV}, sm AS (SELECT *, n - 1 - pos AS rul, sum(v) OVER w / 5 AS sv, sum(k) OVER w / 5 AS sk FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
te AS (SELECT user_id AS obj, pos - (n - 30) AS off, sv, sk FROM sm WHERE user_id % 10 = 0 AND pos >= n - 30), tr AS (SELECT * FROM sm WHERE user_id % 10 <> 0),
dd AS (SELECT te.obj, tr.user_id AS uid, tr.pos - te.off AS start, count(*) AS c, sqrt(sum(pow(te.sv - tr.sv, 2) + pow(te.sk - tr.sk, 2)) / 60) AS d, arg_max(tr.rul, te.off) AS rul
  FROM te, tr WHERE tr.pos - te.off >= 0 AND tr.pos - te.off + 30 <= tr.n GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY d) AS rk FROM dd WHERE c = 30 QUALIFY rk <= 5),
pred AS (SELECT obj, min(d) AS min_distance, CASE WHEN max(d) = 0 THEN avg(rul) ELSE sum(rul / (d + 1e-10)) / sum(1 / (d + 1e-10)) END AS predicted_rul FROM top GROUP BY obj)"""


def predictions(t: Tables, **kw):
    h = t.history()
    n = t.rows("events")
    placed = with_position(h, ["user_id"], ["t", "event_id"], rows=n).withColumn("rul", (F.col("n") - 1 - F.col("pos")).cast("double")).drop("pos", "n")
    return match_remaining_life(placed.where("user_id % 10 = 0"), placed.where("user_id % 10 <> 0"), "user_id", ["t", "event_id"], ["v", "k"], "rul", rows=n, **kw)


@query("E10_J7_segment_matching", f"WITH {MATCH} SELECT obj, {R('min_distance', 5)} AS min_distance, {R('predicted_rul', 5)} AS predicted_rul FROM pred")
def _(t: Tables):
    out = predictions(t)
    return out.select(F.col("user_id").alias("obj"), r("min_distance", 5).alias("min_distance"), r("predicted_rul", 5).alias("predicted_rul"))


@query("O5_best_matches", f"WITH {MATCH} SELECT obj, uid AS match_id, CAST(start + 29 AS BIGINT) AS position, {R('d', 5)} AS distance FROM top")
def _(t: Tables):
    from driftline.operators.matching import segment_matches
    n = t.rows("events")
    placed = with_position(t.history(), ["user_id"], ["t", "event_id"], rows=n).withColumn("rul", (F.col("n") - 1 - F.col("pos")).cast("double")).drop("pos", "n")
    out = segment_matches(placed.where("user_id % 10 = 0"), placed.where("user_id % 10 <> 0"), "user_id", ["t", "event_id"], ["v", "k"], "rul", rows=n)
    return out.select(F.col("user_id").alias("obj"), "match_id", "position", r("distance", 5).alias("distance"))


@query("E12_detection_summary", f"""
WITH {INTERVENTION} SELECT count(*) FILTER (alert_fired) AS n_fired, count(*) FILTER (alert_fired AND obj % 3 = 0) AS n_correct,
  {R('avg(alert_lead) FILTER (alert_fired AND obj % 3 = 0)')} AS mean_lead, {R('avg(CASE WHEN alert_lead > threshold_lead THEN 1 ELSE 0 END) FILTER (alert_fired)')} AS earlier_share FROM iw""")
def _(t: Tables):
    f, ok = F.col("alert_fired"), F.col("alert_fired") & (F.col("obj") % 3 == 0)
    earlier = F.when(F.col("alert_lead") > F.col("threshold_lead"), 1.0).otherwise(0.0)
    return intervention(t).agg(F.count_if(f).alias("n_fired"), F.count_if(ok).alias("n_correct"),
                               r(F.avg(F.when(ok, F.col("alert_lead")))).alias("mean_lead"), r(F.avg(F.when(f, earlier))).alias("earlier_share"))
