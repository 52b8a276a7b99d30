"""The forms for groups too large for one task, forced by a small limit, on NULL keys, NULL and NaN values and a date that most rows share.

`LIMIT` only moves the point where groups are cut into pieces; the SQL is that of the plain form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.models import evaluate as Ev
from driftline.operators import ordering as O
from driftline.operators import windows as W
from driftline.registry.base import R, Tables, query, r

LIMIT = 1_500

ROUGH = """g AS (
  SELECT CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 4 END AS obj, CASE WHEN l_quantity > 10 THEN DATE '1995-01-01' ELSE CAST(l_shipdate AS DATE) END AS day,
         l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS d, CAST(l_extendedprice AS DOUBLE) AS e, CAST(l_quantity AS DOUBLE) AS q,
         CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN 'NaN'::DOUBLE ELSE CAST(l_tax AS DOUBLE) END AS x
  FROM lineitem)"""
ORDER = ["day", "a", "b", "c", "d", "e", "q"]
BY = "PARTITION BY obj ORDER BY day NULLS FIRST, a, b, c, d, e, q"


def rough(t: Tables):
    li = t.lineitem
    x = F.when(F.col("l_partkey") % 3 == 0, None).when(F.col("l_partkey") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax").cast("double"))
    return li.select(F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey") % 4).alias("obj"),
                     F.when(F.col("l_quantity") > 10, F.lit("1995-01-01").cast("date")).otherwise(F.col("l_shipdate").cast("date")).alias("day"),
                     F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c"), F.col("l_suppkey").alias("d"),
                     F.col("l_extendedprice").cast("double").alias("e"), F.col("l_quantity").cast("double").alias("q"), x.alias("x"))


KEYS = ["obj", "a", "b", "c", "d"]
SAME = ", ".join(KEYS)


@query("O_large_position", f"WITH {ROUGH} SELECT {SAME}, row_number() OVER ({BY}) - 1 AS pos, count(*) OVER (PARTITION BY obj) AS n FROM g")
def _(t: Tables):
    return O.with_position(rough(t), ["obj"], ORDER, limit=LIMIT).select(*KEYS, "pos", "n")


@query("O_large_running", f"""
WITH {ROUGH} SELECT {SAME}, {R('sum(q) OVER w')} AS total, {R('sum(CASE WHEN c % 3 = 0 THEN NULL ELSE b END) OVER w')} AS part, {R('min(e) OVER w')} AS low, {R('max(e) OVER w')} AS high,
  {R("last_value(CASE WHEN isnan(x) THEN NULL ELSE x END IGNORE NULLS) OVER w")} AS latest FROM g WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)""")
def _(t: Tables):
    m = {"total": ("sum", F.col("q")), "part": ("sum", F.when(F.col("c") % 3 != 0, F.col("b"))), "low": ("min", F.col("e")), "high": ("max", F.col("e")),
         "latest": ("last", F.when(~F.isnan("x"), F.col("x")))}
    out = O.running(rough(t), ["obj"], ORDER, m, limit=LIMIT)
    return out.select(*KEYS, *[r(n).alias(n) for n in m])


@query("O_large_fill", f"""
WITH {ROUGH}, f AS (SELECT *, CASE WHEN isnan(x) THEN NULL ELSE x END AS y FROM g)
SELECT {SAME}, {R(f'coalesce(last_value(y IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING), first_value(y IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))')} AS filled FROM f""")
def _(t: Tables):
    df = rough(t).withColumn("y", F.when(~F.isnan("x"), F.col("x")))
    return W.fill_gaps(df, ["obj"], ORDER, "y", "filled", limit=LIMIT).select(*KEYS, r("filled").alias("filled"))


@query("O_large_ranks", f"""
WITH {ROUGH} SELECT {SAME}, {R('rank() OVER (PARTITION BY obj ORDER BY x NULLS FIRST) + (count(*) OVER (PARTITION BY obj, x) - 1) / CAST(2 AS DOUBLE)')} AS rank_x,
  {R('rank() OVER (PARTITION BY obj ORDER BY q) + (count(*) OVER (PARTITION BY obj, q) - 1) / CAST(2 AS DOUBLE)')} AS rank_q FROM g""")
def _(t: Tables):
    out = O.average_ranks(rough(t), ["obj"], ["x", "q"], limit=LIMIT)
    return out.select(*KEYS, r("rank_x").alias("rank_x"), r("rank_q").alias("rank_q"))


@query("O_large_quantiles", f"""
WITH {ROUGH} SELECT obj, {R('quantile_cont(e, CAST(0.37 AS DOUBLE))')} AS low, {R('quantile_cont(e, CAST(0.9 AS DOUBLE))')} AS high, count(e) AS n FROM g GROUP BY obj""")
def _(t: Tables):
    out = O.quantiles(rough(t), "e", {"low": 0.37, "high": 0.9}, ["obj"], limit=LIMIT)
    return out.select("obj", r("low").alias("low"), r("high").alias("high"), "n")


@query("O_large_frames", f"WITH {ROUGH} SELECT {SAME}, {R(f'avg(e) OVER ({BY} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS smooth FROM g")
def _(t: Tables):
    f = O.framed(rough(t), ["obj"], ORDER, 6, limit=LIMIT)
    return f.finish(f.df.withColumn("smooth", F.avg("e").over(f.rows(-6, 0)))).select(*KEYS, r("smooth").alias("smooth"))


@query("O_large_group_totals", f"WITH {ROUGH} SELECT {SAME}, {R('max(e) OVER (PARTITION BY obj)')} AS top, count(x) OVER (PARTITION BY obj) AS known FROM g")
def _(t: Tables):
    out = O.per_group(rough(t), ["obj"], {"top": F.max("e"), "known": F.count("x")}, limit=LIMIT)
    return out.select(*KEYS, r("top").alias("top"), "known")


@query("O_large_spearman", f"""
WITH {ROUGH}, p AS (SELECT obj, q, x FROM g WHERE x IS NOT NULL AND NOT isnan(x)), k AS (
  SELECT obj, rank() OVER (PARTITION BY obj ORDER BY q) + (count(*) OVER (PARTITION BY obj, q) - 1) / CAST(2 AS DOUBLE) AS rq,
         rank() OVER (PARTITION BY obj ORDER BY x) + (count(*) OVER (PARTITION BY obj, x) - 1) / CAST(2 AS DOUBLE) AS rx FROM p)
SELECT obj, {R('corr(rq, rx)')} AS rho, count(*) AS n FROM k GROUP BY obj""")
def _(t: Tables):
    out = Ev.spearman(rough(t), "q", "x", ["obj"], limit=LIMIT)
    return out.select("obj", r("rho").alias("rho"), "n")
