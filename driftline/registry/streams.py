"""The stream jobs, run over all available records and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.models.scale import fit_stats, zscore
from driftline.registry.base import EV, R, Tables, query, r, windows_sql
from driftline.session import shared_path
from driftline.streaming import monitor as M
from driftline.streaming.split import SplitMonitor


def stream_of(t: Tables):
    schema = t.events.schema
    raw = M.new_files(M.stateful_session(t.spark), t.folder, schema, pattern="events.parquet")
    ts = F.col("ts").cast("timestamp")
    return raw.select("user_id", "event_id", ts.alias("epoch"), (F.unix_micros(ts) / F.lit(86400000000.0)).alias("t"),
                      F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k"))


STREAM_WIN = f"""{EV}, {windows_sql('ev', 'user_id', 30, 1)}, dw AS (SELECT *, v - lag(v) OVER w AS d1v FROM wr WINDOW w AS (PARTITION BY obj, win ORDER BY off)),
wf AS (SELECT obj, win, max(t) AS t_end, avg(v) AS v_mean, stddev_pop(v) AS v_std, stddev_pop(d1v) AS v_d1_std, regr_slope(v, off) AS v_slope,
  avg(k) FILTER (off >= 15) / (abs(avg(k) FILTER (off < 15)) + 1e-10) AS k_ratio FROM dw GROUP BY obj, win)"""


@query("Z1_stream_windows", f"WITH {STREAM_WIN} SELECT obj, win, {', '.join(f'{R(c)} AS {c}' for c in ('t_end', 'v_mean', 'v_std', 'v_d1_std', 'v_slope', 'k_ratio'))} FROM wf")
def _(t: Tables):
    out = M.run_available(M.windowed(stream_of(t), "user_id", "t", ["v", "k"], 30), "windows")
    return out.select(F.col("user_id").alias("obj"), "win", *[r(c).alias(c) for c in ("t_end", "v_mean", "v_std", "v_d1_std", "v_slope", "k_ratio")])


def _alerts(t: Tables):
    """Windows of the stream, scored with frozen statistics; alert above a fixed score."""
    m, s = fit_stats(t.history(), ["v"])["v"]
    win = M.windowed(stream_of(t), "user_id", "t", ["v", "k"], 30)
    score = zscore("v_mean", m, s) + F.lit(0.1) * (F.col("k_ratio") - 1)
    return win.select(F.col("user_id").alias("obj"), "win", "t_end", score.alias("score"), (score > 0.15).alias("fired"))


ALERTS = f"{STREAM_WIN}, ss AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM ev), al AS (SELECT obj, win, t_end, (v_mean - m) / s + 0.1 * (k_ratio - 1) AS score FROM wf, ss)"


@query("Z2_stream_scores", f"WITH {ALERTS} SELECT obj, win, {R('score')} AS score, score > CAST(0.15 AS DOUBLE) AS fired FROM al")
def _(t: Tables):
    return M.run_available(_alerts(t), "scores").select("obj", "win", r("score").alias("score"), "fired")


@query("Z3_stream_sustained", f"""
WITH {ALERTS}, f AS (SELECT *, score > CAST(0.15 AS DOUBLE) AS fired FROM al), g AS (SELECT *, sum(CASE WHEN fired THEN 0 ELSE 1 END) OVER (PARTITION BY obj ORDER BY win) AS isl FROM f),
h AS (SELECT *, count(*) FILTER (fired) OVER (PARTITION BY obj, isl ORDER BY win) AS run FROM g)
SELECT obj, win, {R('t_end')} AS t_end FROM h WHERE fired AND run = 3""")
def _(t: Tables):
    out = M.run_available(M.sustained(_alerts(t), "obj", "win", "fired", "t_end", 3), "sustained")
    return out.select("obj", "win", r("t_end").alias("t_end"))


@query("Z4_stream_dedupe", "SELECT user_id, epoch_us(ts) AS micros, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables):
    s = stream_of(t)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = M.run_available(M.deduplicated(twice, ["user_id", "epoch"], "epoch", "60 days"), "dedupe")
    return out.groupBy("user_id", F.unix_micros("epoch").alias("micros")).agg(F.count(F.lit(1)).alias("n"))


@query("Z6_late_records", f"""
WITH {EV}, b AS (SELECT user_id, t, event_id % 10 = 0 AS second FROM ev), f AS (SELECT *, max(t) FILTER (NOT second) OVER (PARTITION BY user_id) AS newest,
  count(*) FILTER (NOT second) OVER (PARTITION BY user_id ORDER BY t DESC) >= 30 AS behind FROM b),
c AS (SELECT user_id, count(*) FILTER (NOT second) AS n, count(*) FILTER (second AND NOT behind) AS inserted, count(*) FILTER (second AND NOT behind AND t < newest) AS n_late,
  count(*) FILTER (second AND behind) AS dropped FROM f GROUP BY user_id)
SELECT user_id, n - 29 + inserted AS n_windows, n_late, CASE WHEN inserted > 0 THEN dropped ELSE 0 END AS dropped FROM c WHERE n >= 30""")
def _(t: Tables):
    # two runs: one record of ten comes a micro-batch late
    folder, base = shared_path(t.spark, "late"), shared_path(t.spark, "late-run")
    second = F.col("event_id") % 10 == 0
    for part in (~second, second):
        t.events.where(part).write.mode("append").parquet(folder)
        raw = M.new_files(M.stateful_session(t.spark), folder, t.events.schema)
        s = raw.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400000000.0)).alias("t"), F.col("value").alias("v"))
        out = M.run_available(M.windowed(s, "user_id", "t", ["v"], 30), "late", base)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if("late").alias("n_late"), F.max("dropped").alias("dropped"))


@query("Z6_event_time", f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, value AS v, event_id % 10 = 0 AS second FROM events),
w AS (SELECT max(us) FILTER (NOT second) // 1000 - 172800000 AS w1, max(us) // 1000 - 172800000 AS w2 FROM e),
s AS (SELECT user_id, us, v, row_number() OVER o - 1 AS pos, avg(v) OVER f AS m, stddev_pop(v) OVER f AS d, min(v) OVER f AS low FROM e, w
  WHERE (NOT second OR us > w1 * 1000) AND us <= w2 * 1000 WINDOW o AS (PARTITION BY user_id ORDER BY us, v), f AS (PARTITION BY user_id ORDER BY us, v ROWS 29 PRECEDING))
SELECT user_id, pos - 29 AS win, us AS t_end, {R('m')} AS v_mean, {R('d')} AS v_std, {R('low')} AS v_min FROM s WHERE pos >= 29""")
def _(t: Tables):
    # as above, by event time, in two runs: what the watermark has passed is dropped, the rest takes its place
    folder, base = shared_path(t.spark, "event-time"), shared_path(t.spark, "event-time-run")
    second = F.col("event_id") % 10 == 0
    for part in (~second, second):
        t.events.where(part).write.mode("append").parquet(folder)
        raw = M.new_files(M.stateful_session(t.spark), folder, t.events.schema)
        s = raw.select("user_id", F.col("ts").cast("timestamp").alias("epoch"), F.col("value").alias("v"))
        out = M.run_available(M.settled_windows(s, "user_id", "epoch", ["v"], 30, delay="2 days", idle_seconds=3_650 * 86_400), "event-time", base)
    return out.select("user_id", "win", "t_end", *[r(c).alias(c) for c in ("v_mean", "v_std", "v_min")])


# one object with a third of all records, in three micro-batches, cut above a thirtieth of them
HOT = f"""{EV.replace('FROM events', 'FROM (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id) FROM events)')},
ed AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY pos) AS d1v FROM ev),
wf AS (SELECT user_id AS obj, pos - 29 AS win, t AS t_end, avg(v) OVER f AS v_mean, stddev_pop(v) OVER f AS v_std, stddev_pop(d1v) OVER d AS v_d1_std, regr_slope(v, pos) OVER f AS v_slope,
  avg(k) OVER l / (abs(avg(k) OVER e) + 1e-10) AS k_ratio FROM ed
  WINDOW f AS (PARTITION BY user_id ORDER BY pos ROWS 29 PRECEDING), d AS (PARTITION BY user_id ORDER BY pos ROWS 28 PRECEDING), l AS (PARTITION BY user_id ORDER BY pos ROWS 14 PRECEDING),
         e AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 29 PRECEDING AND 15 PRECEDING) QUALIFY pos >= 29)"""


def _hot_run(t: Tables, fired=None) -> tuple[SplitMonitor, str]:
    folder = shared_path(t.spark, "hot")
    low, high = t.events.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    third = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * 3 / F.lit(max(high - low, 1) + 1))
    for part in range(3):
        t.events.where(third == part).coalesce(1).write.mode("append").parquet(folder)
    raw = M.new_files(t.spark, folder, t.events.schema, per_trigger=1)
    s = raw.select(F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).alias("user_id"), "event_id",
                   (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400000000.0)).alias("t"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    monitor = SplitMonitor("user_id", ["t", "event_id"], ["v", "k"], 30, fired=fired, limit=t.rows("events") // 30 + 1)
    return monitor, monitor.run(s)


@query("Z1_hot_object", f"WITH {HOT} SELECT obj, win, {', '.join(f'{R(c)} AS {c}' for c in ('t_end', 'v_mean', 'v_std', 'v_d1_std', 'v_slope', 'k_ratio'))} FROM wf")
def _(t: Tables):
    monitor, base = _hot_run(t)
    out = monitor.windows(t.spark, base)
    return out.select(F.col("user_id").cast("long").alias("obj"), "win", *[r(c).alias(c) for c in ("t_end", "v_mean", "v_std", "v_d1_std", "v_slope", "k_ratio")])


@query("Z3_hot_object", f"""
WITH {HOT}, ss AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM ev), f AS (SELECT obj, win, t_end, (v_mean - m) / s + 0.1 * (k_ratio - 1) > CAST(0.15 AS DOUBLE) AS fired FROM wf, ss),
g AS (SELECT *, sum(CASE WHEN fired THEN 0 ELSE 1 END) OVER (PARTITION BY obj ORDER BY win) AS isl FROM f), h AS (SELECT *, count(*) FILTER (fired) OVER (PARTITION BY obj, isl ORDER BY win) AS run FROM g)
SELECT obj, win, {R('t_end')} AS t_end FROM h WHERE fired AND run = 3""")
def _(t: Tables):
    m, s = fit_stats(t.history(), ["v"])["v"]
    monitor, base = _hot_run(t, zscore("v_mean", m, s) + F.lit(0.1) * (F.col("k_ratio") - 1) > 0.15)
    return monitor.sustained(t.spark, base).select(F.col("user_id").cast("long").alias("obj"), "win", r("t_end").alias("t_end"))


@query("Z5_new_files", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_events FROM events")
def _(t: Tables):
    out = M.run_available(stream_of(t), "files")
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_events"))
