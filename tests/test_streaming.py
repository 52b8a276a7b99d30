"""Late records in the stream: inserted while the window still holds their place, else dropped and counted."""

from driftline.streaming import monitor as M

SCHEMA = "obj long, t double, v double"


def test_late_records(spark, tmp_path):
    M.stateful_session(spark)
    src = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    put([(1, float(i), float(i * i)) for i in (0, 1, 2, 4, 5)])
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        q = (M.windowed(M.new_files(spark, src, schema, pattern="*.parquet"), "obj", "t", ["v"], 4).writeStream.format("parquet")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).orderBy("win").collect()

    first = run()
    assert [(r["win"], r["t_end"], r["v_mean"]) for r in first] == [(0, 4.0, 21 / 4), (1, 5.0, 46 / 4)]
    put([(1, 3.0, 9.0)])                     # belongs inside the held window 1..5
    second = run()
    assert (second[2]["late"], second[2]["v_mean"], second[2]["t_end"]) == (True, (4 + 9 + 16 + 25) / 4, 5.0)
    put([(1, 0.5, 1.0)])                     # older than everything held
    put([(1, 6.0, 36.0)])
    third = run()
    assert len(third) == 4 and third[3]["dropped"] == 1 and third[3]["v_mean"] == (9 + 16 + 25 + 36) / 4


def test_order_within_a_micro_batch(spark, tmp_path):
    """Records of one object arrive shuffled and in many Arrow batches: none is lost."""
    import random

    M.stateful_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        times = list(range(120))
        random.Random(3).shuffle(times)
        src = str(tmp_path / "in")
        spark.createDataFrame([(1, float(t), float(t)) for t in times], SCHEMA).coalesce(1).write.parquet(src)
        stream = M.new_files(spark, src, spark.createDataFrame([], SCHEMA).schema, pattern="*.parquet")
        rows = M.run_available(M.windowed(stream, "obj", "t", ["v"], 4), "shuffled").orderBy("win").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["win"], r["t_end"], r["dropped"], r["v_mean"]) for r in rows] == [(k, k + 3.0, 0, k + 1.5) for k in range(117)]
