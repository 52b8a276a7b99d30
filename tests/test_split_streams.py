"""Streams with split objects against the rule written out for one object at a time."""

import random

import numpy as np
import pytest

from driftline.session import shared_path
from driftline.streaming import monitor as M
from driftline.streaming.split import SplitMonitor, attach

WIDTH = 4


def brute(batches):
    """windows {(obj, win): (t_end, mean, slope)}, counts {obj: (seen, dropped)}"""
    held, seen, dropped, out = {}, {}, {}, {}
    for batch in batches:
        for obj in {r[0] for r in batch}:
            have = held.get(obj, [])
            newest, oldest = (have[-1][0], have[0][0]) if have else (None, None)
            late = lambda r: bool(have) and r[1] < newest
            gone = [r for r in batch if r[0] == obj and late(r) and len(have) >= WIDTH and r[1] < oldest]
            mine = [r for r in batch if r[0] == obj and r not in gone]
            rows = sorted([(t, i, v, True) for t, i, v in have] + [(r[1], r[2], r[3], late(r)) for r in mine])
            before = seen.get(obj, 0) - len(have)
            for p, (t, _, _, skip) in enumerate(rows):
                if not skip and p >= WIDTH - 1:
                    x = np.array([q[2] for q in rows[p - WIDTH + 1:p + 1]])
                    out[obj, before + p - WIDTH + 1] = (t, x.mean(), np.polyfit(np.arange(WIDTH), x, 1)[0])
            seen[obj] = before + len(rows)
            dropped[obj] = dropped.get(obj, 0) + len(gone)
            held[obj] = [q[:3] for q in rows[-WIDTH:]]
    return out, {o: (seen[o], dropped[o]) for o in seen}


def streamed(spark, batches, folder, monitor, base=None):
    kinds = "obj string, t double, id long, v double"
    for part in (batches[:-1], batches[-1:]):                 # two runs: the second goes on from the first
        for b in part:
            spark.createDataFrame(b, kinds).coalesce(1).write.mode("append").parquet(folder)
        base = monitor.run(M.new_files(spark, folder, spark.read.parquet(folder).schema, per_trigger=1), base)
    return base


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_late_records_null_objects_and_a_hot_one(spark, limit):
    rnd = random.Random(5)
    batches, n = [], 0
    for b in range(4):
        rows = []
        for _ in range(60 if b else 0):
            n += 1
            obj = rnd.choice(["hot"] * 6 + ["a", "b", None])
            rows.append((obj, b * 10 + rnd.choice([rnd.random() * 10, -rnd.random() * 12 if rnd.random() < 0.4 else 5.0]), n, rnd.random()))
        batches.append(rows)
    monitor = SplitMonitor("obj", ["t", "id"], ["v"], WIDTH, limit=limit, every=2)
    base = streamed(spark, batches, shared_path(spark, "in"), monitor)
    want, counts = brute(batches)
    got = {(r.obj, r.win): (r.t_end, r.v_mean, r.v_slope) for r in monitor.windows(spark, base).collect()}
    assert got.keys() == want.keys() and sum(d for _, d in counts.values()) > 0
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)
    assert {r.obj: (r.seen, r.dropped) for r in monitor.counts(spark, base).collect()} == counts


def test_runs_go_on_over_batches_and_a_repeated_batch_counts_once(spark):
    from pyspark.sql import functions as F
    values = [1, 1, 0, 1, 1, 1, 1, 0, 1, 1, 1]
    rows = [("x", float(i), i, float(v)) for i, v in enumerate(values)]
    batches = [rows[:5], rows[5:6], rows[6:]]
    monitor = SplitMonitor("obj", ["t", "id"], ["v"], 1, fired=F.col("v_max") > 0.5, k=3, limit=2)
    folder = shared_path(spark, "in")
    base = streamed(spark, batches, folder, monitor)
    assert sorted(r.win for r in monitor.sustained(spark, base).collect()) == [5, 10]
    monitor._step(base)(spark.createDataFrame(rows[6:], "obj string, t double, id long, v double"), 2)
    assert sorted(r.win for r in monitor.sustained(spark, base).collect()) == [5, 10]
    assert monitor.windows(spark, base).count() == len(values)


def test_facts_of_hot_keys_are_broadcast(spark):
    rows = spark.range(100).selectExpr("CASE WHEN id < 60 THEN NULL WHEN id < 90 THEN 1 ELSE id END AS k")
    facts = spark.createDataFrame([(None, 7), (1, 8), (95, 9)], "k long, f long")
    out = attach(rows, facts, ["k"], 20)
    assert {r.f: r["count"] for r in out.groupBy("f").count().collect()} == {7: 60, 8: 30, 9: 1, None: 9}
