"""Windows by event time: late records take their place or are dropped and counted, ended objects leave no state."""

import datetime as dt

from driftline.streaming import monitor as M

SCHEMA = "obj long, at timestamp, v double"


def test_settled_windows(spark, tmp_path):
    M.stateful_session(spark)
    src, day = str(tmp_path / "in"), lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    put = lambda rows: spark.createDataFrame([(o, day(d), v) for o, d, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    put([(1, d, float(d)) for d in (0, 1, 2, 4, 5)] + [(2, 0, 7.0), (2, 1, 8.0)])
    schema, progress = spark.createDataFrame([], SCHEMA).schema, []

    def run():
        stream = M.settled_windows(M.new_files(spark, src, schema, pattern="*.parquet"), "obj", "at", ["v"], 3, delay="2 days", idle_seconds=5 * 86_400)
        q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        q.awaitTermination()
        progress.extend(q.recentProgress)
        return sorted((r.obj, r.win, r.v_mean, r.v_min) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(1, 0, 1.0, 0.0)]                                 # the watermark is at day 3: only days 0 to 2 are final
    put([(1, 3.5, 3.5), (1, 2.5, 100.0), (1, 9, 9.0)])                 # one takes its place, one is too late, one moves the watermark to day 7
    assert run() == [(1, 0, 1.0, 0.0), (1, 1, (1 + 2 + 3.5) / 3, 1.0), (1, 2, (2 + 3.5 + 4) / 3, 2.0), (1, 3, (3.5 + 4 + 5) / 3, 3.5)]
    assert sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) == 1
    put([(3, 30, 1.0)])                                                # far on: objects 1 and 2 have ended
    assert run()[-1] == (1, 4, (4 + 5 + 9) / 3, 4.0)
    put([(3, 31, 1.0)])
    run()
    put([(1, 31, 1.0), (1, 30, 2.0), (1, 29.5, 3.0), (3, 40, 2.0)])    # object 1 comes back and counts from 0
    assert [x for x in run() if x[0] == 1 and x[2] == 2.0] == [(1, 0, 2.0, 1.0)]
