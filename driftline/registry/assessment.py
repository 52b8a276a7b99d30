"""Evaluation statistics on scored windows, detections and whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.stats import mann_whitney_p_of, spearman_p_of, wilson
from driftline.models import evaluate as Ev
from driftline.operators import matching
from driftline.plans.monitoring import frozen
from driftline.registry.base import EV, R, Tables, query, r
from driftline.registry.records import MESSAGE_TIE, MSG, messages
from driftline.registry.scoring import (COEF, FIRED, MATCH, P5, SD, WEIGHTS, fired, flow, predictions, scored)
from driftline.registry.windowed import EVENT_SQL, MSG_RATES
from driftline.operators import detect
from driftline.plans import conjunction
from driftline.operators.windows import prefix_stats
from driftline.session import materialise


@query("A1_separation", f"""
WITH {SD}, m AS (SELECT median(d_mean) FILTER (label = 1) AS p, median(d_mean) FILTER (label = 0 AND rul > 12) AS n FROM sd)
SELECT {R('p', 8)} AS median_precursor, {R('n', 8)} AS median_nominal, {R('n / (p + 1e-10)', 3)} AS separation FROM m""")
def _(t: Tables):
    out = Ev.separation(scored(t), "d_mean", F.col("label") == 1, (F.col("label") == 0) & (F.col("rul") > 12), rows=t.rows("events"))
    return out.select(r("median_precursor", 8).alias("median_precursor"), r("median_nominal", 8).alias("median_nominal"), r("separation", 3).alias("separation"))


@query("A2_mann_whitney", f"""
WITH {SD}, k AS (SELECT label, d_mean, rank() OVER (ORDER BY round(d_mean, 9)) + (count(*) OVER (PARTITION BY round(d_mean, 9)) - 1) / 2.0 AS rk FROM sd)
SELECT {R('sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0', 2)} AS u, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n2 FROM k""")
def _(t: Tables):
    s = scored(t).withColumn("d", F.round("d_mean", 9))
    out = Ev.mann_whitney(s, "d", F.col("label") == 1, rows=t.rows("events"))
    return out.select(r("u", 2).alias("u"), "n1", "n2")


# numeric integration (Simpson, 2,000 steps) of the normal density above z, and of the t density as cos^(n - 3) above asin|rho|
_NORMAL_TAIL = """(SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z + i * 0.006, 2) / 2)) * 0.006 / 3 / sqrt(2 * pi()) FROM range(2001) t(i))"""
_COS_PART = "(SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos({low} + i * (pi() / 2 - {low}) / 2000), n - 3)) * (pi() / 2 - {low}) / 6000 FROM range(2001) t(i))"
_T_TAILS = f"CASE WHEN n < 3 THEN 1 WHEN abs(rho) >= 1 THEN 0 ELSE {_COS_PART.format(low='asin(least(abs(rho), 1))')} / {_COS_PART.format(low='0')} END"


def _u_sql(by: str) -> str:
    """u, n1, n2, z of the one-sided test per group `by` (a column list with a comma at its end, or nothing)."""
    part = f"PARTITION BY {by[:-2]} " if by else ""
    same = f"PARTITION BY {by}round(d_mean, 9)"
    group = f" GROUP BY {by[:-2]}" if by else ""
    return f"""k AS (SELECT {by}label, d_mean, rank() OVER ({part}ORDER BY round(d_mean, 9)) + (count(*) OVER ({same}) - 1) / 2.0 AS rk, count(*) OVER ({same}) AS c FROM sd),
m AS (SELECT {by}CAST(coalesce(sum(rk) FILTER (label = 1), 0) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0 AS DOUBLE) AS u, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label <> 1) AS n2, CAST(sum(c * c - 1) AS DOUBLE) AS ties FROM k{group}),
v AS (SELECT *, n1 * n2 / CAST(12 AS DOUBLE) * ((n1 + n2 + 1) - coalesce(ties / nullif(CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1), 0), 0)) AS var FROM m), y AS (SELECT *, CASE WHEN var > 0 THEN (n1 * n2 - u - n1 * n2 / 2.0 - 0.5) / sqrt(var) END AS z FROM v)"""


@query("A2_mann_whitney_p", f"""
WITH {SD}, {_u_sql('')} SELECT {R('u', 2)} AS u, n1, n2, {R(f'CASE WHEN z IS NULL THEN 1 ELSE {_NORMAL_TAIL} END', 8)} AS p FROM y""")
def _(t: Tables):
    s = scored(t).withColumn("d", F.round("d_mean", 9))
    out = Ev.mann_whitney(s, "d", F.col("label") == 1, rows=t.rows("events"))
    return out.select(r("u", 2).alias("u"), "n1", "n2", r(mann_whitney_p_of(F.col("u"), F.col("n1"), F.col("n2"), F.col("ties")), 8).alias("p"))


@query("A2_mann_whitney_p_per_object", f"""
WITH {SD}, {_u_sql('obj, ')} SELECT obj, {R('u', 2)} AS u, n1, n2, {R(f'CASE WHEN z IS NULL THEN 1 ELSE {_NORMAL_TAIL} END', 8)} AS p FROM y""")
def _(t: Tables):
    s = scored(t).withColumn("d", F.round("d_mean", 9))
    out = Ev.mann_whitney(s, "d", F.col("label") == 1, ["obj"], rows=t.rows("events"))
    return out.select("obj", r("u", 2).alias("u"), "n1", "n2", r(mann_whitney_p_of(F.col("u"), F.col("n1"), F.col("n2"), F.col("ties")), 8).alias("p"))


@query("A3_spearman", f"""
WITH {SD}, k AS (SELECT rank() OVER (ORDER BY rul) + (count(*) OVER (PARTITION BY rul) - 1) / 2.0 AS a, rank() OVER (ORDER BY round(d_mean, 9)) + (count(*) OVER (PARTITION BY round(d_mean, 9)) - 1) / 2.0 AS b FROM sd WHERE rul < 20)
SELECT {R('corr(a, b)')} AS rho, count(*) AS n FROM k""")
def _(t: Tables):
    s = scored(t).where("rul < 20").withColumn("d", F.round("d_mean", 9))
    return Ev.spearman(s, "rul", "d", rows=t.rows("events")).select(r("rho").alias("rho"), "n")


def _rho_sql(by: str) -> str:
    part = f"PARTITION BY {by[:-2]} " if by else ""
    pair = lambda c: f"rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}{c}) - 1) / 2.0"
    group = f" GROUP BY {by[:-2]}" if by else ""
    return f"""k AS (SELECT {by}{pair('rul')} AS a, {pair('round(d_mean, 9)')} AS b FROM sd WHERE rul < 20),
y AS (SELECT {by}CASE WHEN count(*) < 3 OR stddev_pop(a) * stddev_pop(b) = 0 THEN 0 ELSE covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS rho, count(*) AS n FROM k{group})"""


@query("A3_spearman_p", f"""
WITH {SD}, {_rho_sql('')} SELECT {R('rho')} AS rho, n, {R(_T_TAILS, 8)} AS p FROM y""")
def _(t: Tables):
    s = scored(t).where("rul < 20").withColumn("d", F.round("d_mean", 9))
    out = Ev.spearman(s, "rul", "d", rows=t.rows("events"))
    return out.select(r("rho").alias("rho"), "n", r(spearman_p_of(F.col("rho"), F.col("n")), 8).alias("p"))


@query("A3_spearman_p_per_object", f"""
WITH {SD}, {_rho_sql('obj, ')} SELECT obj, {R('rho')} AS rho, n, {R(_T_TAILS, 6)} AS p FROM y""")
def _(t: Tables):
    s = scored(t).where("rul < 20").withColumn("d", F.round("d_mean", 9))
    out = Ev.spearman(s, "rul", "d", ["obj"], rows=t.rows("events"))
    return out.select("obj", r("rho").alias("rho"), "n", r(spearman_p_of(F.col("rho"), F.col("n")), 6).alias("p"))


@query("A4_per_object_spearman", f"""
WITH {SD}, k AS (SELECT obj, rank() OVER (PARTITION BY obj ORDER BY rul) AS a, rank() OVER (PARTITION BY obj ORDER BY round(d_mean, 9)) + (count(*) OVER (PARTITION BY obj, round(d_mean, 9)) - 1) / 2.0 AS b FROM sd)
SELECT obj, {R('coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0)')} AS rho, count(*) AS n FROM k GROUP BY obj HAVING count(*) >= 5""")
def _(t: Tables):
    s = scored(t).withColumn("d", F.round("d_mean", 9))
    return Ev.spearman(s, "rul", "d", ["obj"], min_rows=5, rows=t.rows("events")).select("obj", r("rho").alias("rho"), "n")


A5 = f"""{EV}, st AS (SELECT avg(v) AS m, stddev_pop(v) AS s, avg(k) AS mk, stddev_pop(k) AS sk FROM ev),
pf AS (SELECT user_id AS obj, pos, n, avg(v) OVER w AS vm, max(k) OVER w AS kx, v FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ps AS (SELECT obj, n - 1 - pos AS left_over, round(abs(0.6 * (vm - m) / s + 0.4 * (kx - mk) / sk + 0.2 * (v - m) / s), 9) AS d FROM pf, st WHERE n >= 5 AND pos >= 1),
k AS (SELECT obj, rank() OVER (PARTITION BY obj ORDER BY left_over) AS a, rank() OVER (PARTITION BY obj ORDER BY d) + (count(*) OVER (PARTITION BY obj, d) - 1) / 2.0 AS b FROM ps),
rh AS (SELECT obj, coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0) AS rho, count(*) AS n FROM k GROUP BY obj)"""


def _prefix_rho(t: Tables):
    from driftline.models.scale import fit_stats, zscore
    h = t.history()
    n = t.rows("events")
    st = fit_stats(h, ["v", "k"])
    p = prefix_stats(h, ["user_id"], ["t", "event_id"], ["v", "k"], rows=n).where("n >= 5 AND step >= 2")
    score = F.lit(0.6) * zscore("v_mean", *st["v"]) + F.lit(0.4) * zscore("k_max", *st["k"]) + F.lit(0.2) * zscore("v", *st["v"])
    d = p.select(F.col("user_id").alias("obj"), (F.col("n") - F.col("step")).alias("left_over"), F.round(F.abs(score), 9).alias("d"))
    return Ev.spearman(d, "left_over", "d", ["obj"], rows=n)


@query("A5_prefix_approach", f"WITH {A5} SELECT obj, {R('rho')} AS rho, n FROM rh")
def _(t: Tables):
    return _prefix_rho(t).select("obj", r("rho").alias("rho"), "n")


@query("A5_prefix_summary", f"""
WITH {A5} SELECT {R('avg(rho)')} AS mean, {R('median(rho)')} AS median, count(*) FILTER (rho > 0) AS n_positive, {R('avg(CASE WHEN rho > 0 THEN 1 ELSE 0 END)')} AS share_positive, count(*) AS n_objects FROM rh""")
def _(t: Tables):
    out = Ev.summary_of(_prefix_rho(t), "rho", rows=t.rows("events"))
    return out.select(r("mean").alias("mean"), r("median").alias("median"), "n_positive", r("share_positive").alias("share_positive"), "n_objects")


CONSISTENT_COEF = {"d_miss_dist_dt_mean": 0.6, "d_miss_dist_dt_last": 0.3, "t_sigma_r_final": -0.5, "d_t_sigma_r_dt": 0.4, "t_cov_det_final": 0.7, "d_t_cov_det_dt": -0.2, "t_cov_late_early_ratio": 0.35,
                   "t_obs_used_final": -0.3, "d_c_obs_used_dt": 0.25, "t_time_lastob_end_final": 0.1, "inter_cdm_dt_mean": 0.45, "inter_cdm_dt_std": -0.15, "inter_cdm_dt_last": 0.2,
                   "n_cdms": 0.8, "corr_miss_c_cov_det": -0.55}
PREFIX_SQL = f"""{MSG_RATES}, big AS (SELECT * FROM rt WHERE n >= 5),
px AS (SELECT p.event_id, p.pos AS last, p.n, p.time_to_tca, i.pos, i.gap, i.t_det, i.miss_distance AS a, i.c_det AS b, i.rate_miss_distance, i.rate_t_sigma_r, i.rate_t_det, i.rate_c_obs_used
  FROM big p JOIN big i ON i.event_id = p.event_id AND i.pos <= p.pos WHERE p.pos >= 1),
pr AS (SELECT event_id, last, rank() OVER (PARTITION BY event_id, last ORDER BY a) + (count(*) OVER (PARTITION BY event_id, last, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY event_id, last ORDER BY b) + (count(*) OVER (PARTITION BY event_id, last, b) - 1) / 2.0 AS rb FROM px WHERE a IS NOT NULL AND b IS NOT NULL),
pc AS (SELECT event_id, last, CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 0) END AS rho FROM pr GROUP BY ALL),
ps AS (SELECT event_id, last, coalesce(avg(rate_miss_distance), 0) AS d_miss_dist_dt_mean, coalesce(arg_max(rate_miss_distance, pos) FILTER (rate_miss_distance IS NOT NULL), 0) AS d_miss_dist_dt_last,
  coalesce(avg(rate_t_sigma_r), 0) AS d_t_sigma_r_dt, coalesce(avg(rate_t_det), 0) AS d_t_cov_det_dt, coalesce(avg(rate_c_obs_used), 0) AS d_c_obs_used_dt,
  coalesce(avg(t_det) FILTER (pos >= (last + 1) // 2) / (abs(avg(t_det) FILTER (pos < (last + 1) // 2)) + 1e-10), 1) AS t_cov_late_early_ratio,
  coalesce(avg(gap), 0) AS inter_cdm_dt_mean, coalesce(stddev_pop(gap), 0) AS inter_cdm_dt_std FROM px GROUP BY ALL),
pf AS (SELECT big.event_id, pos + 1 AS step, n, time_to_tca, ps.* EXCLUDE (event_id, last), t_sigma_r AS t_sigma_r_final, t_det AS t_cov_det_final, t_obs_used AS t_obs_used_final,
  t_time_lastob_end AS t_time_lastob_end_final, coalesce(gap, 0) AS inter_cdm_dt_last, CAST(pos + 1 AS DOUBLE) AS n_cdms, coalesce(rho, 0) AS corr_miss_c_cov_det
  FROM big JOIN ps ON ps.event_id = big.event_id AND ps.last = pos LEFT JOIN pc ON pc.event_id = big.event_id AND pc.last = pos)"""


@query("W4_prefix_features", f"WITH {PREFIX_SQL} SELECT event_id, step, n, {', '.join(f'{R(c, EVENT_SQL[c][1])} AS {c}' for c in CONSISTENT_COEF)} FROM pf")
def _(t: Tables):
    out = conjunction.prefix_features(messages(t), tie=MESSAGE_TIE, rows=t.rows("lineitem"))
    return out.select("event_id", "step", "n", *[r(c, EVENT_SQL[c][1]).alias(c) for c in CONSISTENT_COEF])


_z = lambda f: f"coalesce(({f} - m_{f}) / (CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END), 0)"
_proj = " + ".join(f"CAST({w!r} AS DOUBLE) * {_z(f)}" for f, w in CONSISTENT_COEF.items())
APPROACH_SQL = f"""{PREFIX_SQL}, ef AS (SELECT event_id, {', '.join(f'{EVENT_SQL[f][0]} AS {f}' for f in CONSISTENT_COEF)}, arg_max(risk, pos) >= -5 AS due FROM rt LEFT JOIN sp USING (event_id) WHERE event_id % 2 = 0 GROUP BY event_id),
es AS (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in CONSISTENT_COEF)} FROM ef),
ba AS (SELECT list(p ORDER BY p) AS ps FROM (SELECT {_proj} AS p FROM ef, es WHERE due)),
pp AS (SELECT event_id, time_to_tca, {_proj} AS p FROM pf, es WHERE event_id % 2 = 1),
pd AS (SELECT event_id, time_to_tca, round(list_avg(list_sort(list_transform(ps, lambda x: abs(x - p)))[1:5]), 6) AS d FROM pp, ba),
pk AS (SELECT event_id, rank() OVER (PARTITION BY event_id ORDER BY time_to_tca) + (count(*) OVER (PARTITION BY event_id, time_to_tca) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY event_id ORDER BY d) + (count(*) OVER (PARTITION BY event_id, d) - 1) / 2.0 AS b FROM pd),
ph AS (SELECT event_id, round(coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0), 9) AS rho, count(*) AS n FROM pk GROUP BY event_id HAVING count(*) >= 3)"""


def _approach(t: Tables):
    """A model frozen on the events with even ids; prefixes of the others are walked."""
    train = materialise(conjunction.event_features(messages(t).where("event_id % 2 = 0"), tie=MESSAGE_TIE, rows=t.rows("lineitem")).select(*CONSISTENT_COEF, "label"))
    model = frozen(train, CONSISTENT_COEF)
    basin = model.score(train.where("label = 1")).select("proj")
    prefixes = conjunction.prefix_features(messages(t).where("event_id % 2 = 1"), tie=MESSAGE_TIE, rows=t.rows("lineitem"))
    return conjunction.prefix_approach(prefixes, model, basin, digits=6, rows=t.rows("lineitem")).withColumn("rho", F.round("rho", 9))


@query("A5_model_prefix_approach", f"WITH {APPROACH_SQL} SELECT event_id, {R('rho')} AS rho, n FROM ph")
def _(t: Tables):
    return _approach(t).select("event_id", r("rho").alias("rho"), "n")


@query("A5_model_prefix_summary", f"""
WITH {APPROACH_SQL} SELECT {R('avg(rho)')} AS mean, {R('median(rho)')} AS median, count(*) FILTER (rho > 0) AS n_positive, {R('avg(CASE WHEN rho > 0 THEN 1 ELSE 0 END)')} AS share_positive, count(*) AS n_objects FROM ph""")
def _(t: Tables):
    out = Ev.summary_of(_approach(t), "rho", rows=t.rows("lineitem"))
    return out.select(r("mean").alias("mean"), r("median").alias("median"), "n_positive", r("share_positive").alias("share_positive"), "n_objects")


def _ablated(drop: list[str]) -> str:
    terms = " + ".join(f"CAST({COEF[f] * WEIGHTS.get(f, 1.0)!r} AS DOUBLE) * ({f} - m_{f}) / s_{f}" for f in COEF if f not in drop)
    return f"""(SELECT avg(d) FROM (SELECT s.obj, s.win, abs(s.p - b.p) AS d, row_number() OVER (PARTITION BY s.obj, s.win ORDER BY abs(s.p - b.p)) AS rk
      FROM (SELECT obj, win, {terms} AS p FROM lf, st) s, (SELECT {terms} AS p FROM lf, st WHERE label = 1) b) WHERE rk <= 5)"""


CLASSES = {"time_domain": ["v_mean", "v_std", "v_min", "k_mean", "k_std"], "rate": ["v_slope"], "ratio": ["k_ratio"]}


@query("A6_class_ablation", f"""
WITH {SD}, b AS (SELECT {_ablated([])} AS base) """ + " UNION ALL ".join(
    f"SELECT '{c}' AS feature_class, {R(f'({_ablated(f)} - base) / (base + 1e-10)', 5)} AS change FROM b" for c, f in CLASSES.items()))
def _(t: Tables):
    windows = materialise(flow(t).windows(t.history()).select("label", *COEF))
    model = frozen(windows, COEF, WEIGHTS)
    out = Ev.ablation(windows, CLASSES, model.column, F.col("label") == 1, 5)
    return out.select("feature_class", r("change", 5).alias("change"))


CONF = f"{FIRED}, ob AS (SELECT obj, bool_or(fired) AS f, obj % 3 = 0 AS due FROM fr GROUP BY obj), cf AS (SELECT count(*) FILTER (f AND due) AS tp, count(*) FILTER (f AND NOT due) AS fp, count(*) FILTER (NOT f AND due) AS fn, count(*) FILTER (NOT f AND NOT due) AS tn FROM ob)"


def _confusion(t: Tables):
    s, eps = fired(t)
    ob = s.groupBy("obj").agg(F.max(detect.fire("d_mean", eps)).alias("f"))
    return Ev.confusion(ob, F.col("f"), F.col("obj") % 3 == 0)


@query("A7_confusion", f"""
WITH {CONF} SELECT tp, fp, fn, tn, {R('tp / greatest(1, tp + fp)')} AS precision, {R('tp / greatest(1, tp + fn)')} AS recall,
  {R('2 * tp / greatest(1, 2 * tp + fp + fn)')} AS f1, {R('tn / greatest(1, tn + fp)')} AS specificity FROM cf""")
def _(t: Tables):
    out = Ev.with_rates(_confusion(t))
    return out.select("tp", "fp", "fn", "tn", *[r(c).alias(c) for c in ("precision", "recall", "f1", "specificity")])


@query("A7_window_level_by_fold", f"""
WITH {FIRED} SELECT obj, count(*) FILTER (fired AND label = 1) AS tp, count(*) FILTER (fired AND label = 0) AS fp, count(*) FILTER (NOT fired AND label = 1) AS fn, count(*) FILTER (NOT fired AND label = 0) AS tn FROM fr GROUP BY obj""")
def _(t: Tables):
    s, eps = fired(t)
    return Ev.confusion(s, detect.fire("d_mean", eps), F.col("label") == 1, ["obj"])


_w = lambda s, n: (f"CASE WHEN {n} = 0 THEN 0 ELSE greatest(0, ({s} / {n} + 3.8416 / (2 * {n}) - 1.96 * sqrt({s} / {n} * (1 - {s} / {n}) / {n} + 3.8416 / (4 * {n} * {n}))) / (1 + 3.8416 / {n})) END",
                   f"CASE WHEN {n} = 0 THEN 0 ELSE least(1, ({s} / {n} + 3.8416 / (2 * {n}) + 1.96 * sqrt({s} / {n} * (1 - {s} / {n}) / {n} + 3.8416 / (4 * {n} * {n}))) / (1 + 3.8416 / {n})) END")


@query("A8_wilson", f"""
WITH c AS (SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (l_tax > 0.07) AS DOUBLE) AS s FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, {R(_w('s', 'n')[0])} AS low, {R(_w('s', 'n')[1])} AS high FROM c""")
def _(t: Tables):
    c = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_tax") > 0.07).alias("s"))
    low, high = wilson(F.col("s"), F.col("n"))
    return c.select("l_suppkey", r(low).alias("low"), r(high).alias("high"))


@query("A9_f1_interval", f"""
WITH {CONF}, d AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(tp + fp AS DOUBLE) AS a, CAST(tp + fn AS DOUBLE) AS b FROM cf),
w AS (SELECT {_w('tp', 'a')[0]} AS pl, {_w('tp', 'a')[1]} AS ph, {_w('tp', 'b')[0]} AS rl, {_w('tp', 'b')[1]} AS rh FROM d)
SELECT {R('pl')} AS precision_lo, {R('ph')} AS precision_hi, {R('rl')} AS recall_lo, {R('rh')} AS recall_hi,
  {R('CASE WHEN pl > 0 AND rl > 0 THEN 2 * pl * rl / (pl + rl) ELSE 0 END')} AS f1_lo, {R('CASE WHEN ph > 0 AND rh > 0 THEN 2 * ph * rh / (ph + rh) ELSE 0 END')} AS f1_hi FROM w""")
def _(t: Tables):
    out = Ev.with_intervals(_confusion(t))
    return out.select(*[r(c).alias(c) for c in ("precision_lo", "precision_hi", "recall_lo", "recall_hi", "f1_lo", "f1_hi")])


@query("A9_f1_without_false_alarms", f"""
WITH {CONF}, d AS (SELECT CAST(tp + fp AS DOUBLE) AS tp, CAST(tp + fp + fn + tn AS DOUBLE) AS b FROM cf), w AS (SELECT {_w('tp', 'b')[0]} AS rl, {_w('tp', 'b')[1]} AS rh FROM d)
SELECT {R('rl')} AS recall_lo, {R('rh')} AS recall_hi, {R('2 * rl / (1 + rl)')} AS f1_lo, {R('2 * rh / (1 + rh)')} AS f1_hi FROM w""")
def _(t: Tables):
    s, eps = fired(t)
    ob = s.groupBy("obj").agg(F.max(detect.fire("d_mean", eps)).alias("f"))
    out = Ev.with_intervals(Ev.confusion(ob, F.col("f"), F.lit(True)), "recall")
    return out.select(*[r(c).alias(c) for c in ("recall_lo", "recall_hi", "f1_lo", "f1_hi")])


@query("A10_lead_times", f"""
WITH {FIRED}, ld AS (SELECT obj, arg_min(rul, win) FILTER (fired) AS lead FROM fr GROUP BY obj)
SELECT {R('avg(lead)')} AS mean, {R('median(lead)')} AS median, {R('min(lead)')} AS min, {R('max(lead)')} AS max, {R('quantile_cont(lead, CAST(0.25 AS DOUBLE))')} AS p25, {R('quantile_cont(lead, CAST(0.75 AS DOUBLE))')} AS p75, count(lead) AS n FROM ld""")
def _(t: Tables):
    s, eps = fired(t)
    ld = detect.first_fire(s, ["obj"], "win", "rul", detect.fire("d_mean", eps))
    out = Ev.five_numbers(ld, "lead", rows=t.rows("events"))
    return out.select(*[r(c).alias(c) for c in ("mean", "median", "min", "max", "p25", "p75")], "n")


@query("A11_prediction_errors", f"""
WITH {MATCH}, e AS (SELECT predicted_rul, obj % 40 AS true_rul, predicted_rul - obj % 40 AS e FROM pred)
SELECT {R('sqrt(avg(e * e))', 5)} AS rmse, {R('avg(abs(e))', 5)} AS mae, {R('sum(CASE WHEN e < 0 THEN exp(-e / 13) - 1 ELSE exp(e / 10) - 1 END)', 3)} AS score,
  count(*) FILTER (predicted_rul <= 25 AND true_rul <= 25) AS tp, count(*) FILTER (predicted_rul <= 25 AND true_rul > 25) AS fp,
  count(*) FILTER (predicted_rul > 25 AND true_rul <= 25) AS fn, count(*) FILTER (predicted_rul > 25 AND true_rul > 25) AS tn FROM e""")
def _(t: Tables):
    p = predictions(t).withColumn("true_rul", F.col("user_id") % 40)
    out = matching.errors(p, warning=25.0)
    return out.select(r("rmse", 5).alias("rmse"), r("mae", 5).alias("mae"), r("score", 3).alias("score"), "tp", "fp", "fn", "tn")


@query("A12_error_margins", f"""
WITH {SD}, f AS (SELECT obj, arg_max(d_mean, win) AS d FROM sd GROUP BY obj), ep AS (SELECT {P5} AS eps)
SELECT obj, CASE WHEN d < eps THEN 'false alarm' ELSE 'missed' END AS error, {R('100 * (d - eps) / eps', 3)} AS margin_pct FROM f, ep WHERE (d < eps) <> (obj % 3 = 0)""")
def _(t: Tables):
    s, eps = fired(t)
    f = detect.distance_profile(s, ["obj"], "win", "d_mean")
    hit = F.col("d_final") < eps
    wrong = f.where(hit != (F.col("obj") % 3 == 0))
    return wrong.select("obj", F.when(hit, "false alarm").otherwise("missed").alias("error"), r(100 * (F.col("d_final") - eps) / eps, 3).alias("margin_pct"))


@query("A13_profile", f"""
WITH {MSG} SELECT 'mahalanobis_distance' AS feature, count(*) FILTER (mahalanobis_distance IS NULL) AS missing, {R('min(mahalanobis_distance)')} AS min, {R('max(mahalanobis_distance)')} AS max FROM msg
UNION ALL SELECT 'c_sigma_r', count(*) FILTER (c_sigma_r IS NULL), {R('min(c_sigma_r)')}, {R('max(c_sigma_r)')} FROM msg UNION ALL SELECT 'risk', count(*) FILTER (risk IS NULL), {R('min(risk)')}, {R('max(risk)')} FROM msg""")
def _(t: Tables):
    out = Ev.profile(messages(t), ["mahalanobis_distance", "c_sigma_r", "risk"])
    return out.select("feature", "missing", r("min").alias("min"), r("max").alias("max"))


@query("A14_sequence_lengths", f"""
WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY user_id)
SELECT (SELECT min(n) FROM a) AS min_first, (SELECT max(n) FROM a) AS max_first, {R('(SELECT avg(n) FROM a)')} AS mean_first, {R('(SELECT avg(n) FROM b) / (SELECT avg(n) FROM a)')} AS density_ratio""")
def _(t: Tables):
    first = F.col("event_id") % 3 == 0
    per = t.events.groupBy("user_id").agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    a, b = F.when(F.col("a") > 0, F.col("a")), F.when(F.col("b") > 0, F.col("b"))
    return per.agg(F.min(a).alias("min_first"), F.max(a).alias("max_first"), r(F.avg(a)).alias("mean_first"), r(F.avg(b) / F.avg(a)).alias("density_ratio"))


@query("A15_label_distribution", f"""
WITH {MSG}, f AS (SELECT event_id, arg_min(risk, (time_to_tca, -l_linenumber, -l_partkey, -price, -qty)) AS risk FROM msg GROUP BY event_id)
SELECT CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(*) FILTER (risk >= -5) AS n_high FROM f GROUP BY 1""")
def _(t: Tables):
    at = F.struct("time_to_tca", *[(-F.col(c)).alias(c) for c in MESSAGE_TIE])
    f = messages(t).groupBy("event_id").agg(F.min_by("risk", at).alias("risk"))
    split = F.when(F.col("event_id") % 4 == 0, "test").otherwise("train")
    return f.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk") >= -5).alias("n_high"))


def _ks(c: str) -> str:
    return f"""SELECT '{c}' AS feature, {R('max(abs(cx / nx - cy / ny))')} AS ks FROM (SELECT DISTINCT x, count(*) FILTER (f) OVER (ORDER BY x) AS cx, count(*) FILTER (NOT f) OVER (ORDER BY x) AS cy,
      count(*) FILTER (f) OVER () AS nx, count(*) FILTER (NOT f) OVER () AS ny FROM (SELECT {c} AS x, l_suppkey % 4 = 0 AS f FROM lineitem))"""


@query("A16_two_sample_ks", " UNION ALL ".join(_ks(c) for c in ("l_quantity", "l_discount", "l_extendedprice")))
def _(t: Tables):
    out = Ev.two_sample_ks(t.lineitem, ["l_quantity", "l_discount", "l_extendedprice"], F.col("l_suppkey") % 4 == 0, rows=t.rows("lineitem"))
    return out.select("feature", r("ks").alias("ks"))


@query("A17_log_histogram", """
WITH b AS (SELECT log10(o_totalprice) AS x FROM orders WHERE o_totalprice > 0)
SELECT CAST(CASE WHEN x < 3 THEN 0 WHEN x >= 6 THEN 61 ELSE floor((x - 3) / (CAST(3 AS DOUBLE) / 60)) + 1 END AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY 1""")
def _(t: Tables):
    return Ev.log_histogram(t.orders, "o_totalprice", 3.0, 6.0, 60)


@query("A17_lead_histogram", """
SELECT CAST(CASE WHEN p_size >= 50 THEN 26 ELSE floor(p_size / CAST(2 AS DOUBLE)) + 1 END AS BIGINT) AS bin, count(*) AS n FROM part GROUP BY 1""")
def _(t: Tables):
    return Ev.histogram(t.part.withColumn("x", F.col("p_size").cast("double")), "x", 0.0, 50.0, 25)


@query("A18_yearly_onset", f"""
WITH y AS (SELECT year(o_orderdate) AS yr, month(o_orderdate) AS mo, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), e AS (SELECT year(l_shipdate) AS yr, month(l_shipdate) AS mo, round(avg(l_quantity), 9) AS x FROM lineitem GROUP BY ALL),
k AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS a, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS b FROM y JOIN e USING (yr, mo))
SELECT {R('corr(a, b)')} AS rho, count(*) AS n FROM k""")
def _(t: Tables):
    onset = t.orders.where("o_orderstatus = 'F'").groupBy(F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo")).agg(F.count(F.lit(1)).alias("n"))
    other = t.lineitem.groupBy(F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mo")).agg(F.round(F.avg("l_quantity"), 9).alias("x"))
    # one row per calendar month on both sides
    return Ev.spearman(onset.withColumnRenamed("n", "cnt").join(other, ["yr", "mo"]), "cnt", "x", rows=0).select(r("rho").alias("rho"), "n")
