"""Windows and sustained alerts of streams in which one object may hold a large share of the records.

A stateful operator keyed by object sends all of an object's new records to one task. Here every micro-batch is an ordinary
distributed job: the records an earlier batch left behind (the last `width` of each object) are joined with the new ones, objects
above `limit` rows are cut into time ranges, and every range gets copies of the `width - 1` records in front of it
(`operators/ordering`). So no task holds more than about `limit` rows of an object, however much of a batch is one object's.

State is a table in the shared folder, one folder per batch id with the objects that the batch touched; every `every` batches the
whole table is written anew, so that a batch reads at most `every` folders. Results go to a folder per batch id as well. A batch
that is run again reads the same earlier state and overwrites its own folders: each record counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.ordering import ROWS_PER_TASK, framed, layout_of, running, same_key, with_position
from driftline.operators.windows import Span
from driftline.session import ensure_checkpoint_dir


def attach(rows: DataFrame, facts: DataFrame, key: Sequence[str], limit: int = ROWS_PER_TASK) -> DataFrame:
    """Left join of `rows` with `facts` (one row per key); facts of keys above `limit` rows, at most total / limit, are broadcast."""
    hot = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > limit).select(*key)
    if hot.isEmpty():
        return same_key(rows, facts, key, "left")
    flagged = same_key(rows, F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    of_hot = same_key(facts, F.broadcast(hot), key)
    cold = same_key(flagged.where("_hot IS NULL"), facts, key, "left")
    return cold.unionByName(same_key(flagged.where("_hot"), F.broadcast(of_hot), key, "left")).drop("_hot")


def window_values(span: Span, channel: str, width: int) -> dict[str, Column]:
    """The stream's window features of one channel as frame aggregates; unknown where a value of the window is."""
    x, d = F.col(channel).cast("double"), F.col(f"_d_{channel}")
    values = {
        "mean": span.agg(F.avg, x), "std": span.agg(F.stddev_pop, x), "min": span.agg(F.min, x), "max": span.agg(F.max, x),
        "d1_mean": span.agg(F.avg, d, skip=1), "d1_std": span.agg(F.stddev_pop, d, skip=1),
        "d2_mean": (span.agg(F.last, d, skip=1) - span.agg(F.first, d, skip=1)) / F.lit(max(width - 2, 1)),
        "slope": span.agg(F.regr_slope, x, F.col("pos")),
        "ratio": span.agg(F.avg, x, half="late") / (F.abs(span.agg(F.avg, x, half="early")) + F.lit(1e-10)),
    }
    whole = span.agg(F.count, x) == width
    return {f"{channel}_{n}": F.when(whole, v) for n, v in values.items()}


@dataclass
class SplitMonitor:
    """Windows of the last `width` records per object over a stream, and completed runs of `k` alerts.

    `order` are the columns that order an object's records, the time first. Records of a batch are put in order before use. A record
    whose time lies before the newest one of earlier batches is late: inside the held range it takes its place in the windows that
    end after it (it ends none itself), in front of a full range it is dropped and counted. `win` numbers an object's windows from
    0 without gaps when nothing is late. `fired` is an alert expression over the window columns.
    """

    key: str
    order: Sequence[str]
    channels: Sequence[str]
    width: int = 30
    fired: Column | None = None
    k: int = 3
    limit: int = ROWS_PER_TASK
    every: int = 20

    # ---- state tables ----
    def _state(self, spark: SparkSession, base: str, name: str, batch: int) -> DataFrame | None:
        """The newest rows of every object before `batch`."""
        if batch == 0:
            return None
        first = (batch - 1) - (batch - 1) % self.every
        table = spark.read.parquet(*[f"{base}/{name}/batch={i}" for i in range(first, batch)])
        if first == batch - 1:
            return table
        return same_key(table, table.groupBy(self.key).agg(F.max("_batch").alias("_last")), [self.key]).where("_batch = _last").drop("_last")

    def _save(self, rows: DataFrame, before: DataFrame | None, base: str, name: str, batch: int) -> None:
        rows = rows.withColumn("_batch", F.lit(batch).cast("long"))
        if before is not None and batch % self.every == 0:
            touched = rows.select(self.key).distinct().withColumn("_in", F.lit(True))
            rest = same_key(before, touched, [self.key], "left").where("_in IS NULL").drop("_in")
            rows = rows.unionByName(rest)
        rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")

    # ---- one micro-batch ----
    def _merged(self, new: DataFrame, held: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Held and accepted records of the objects in this batch, and (key, _now) the dropped ones by object."""
        key, time, cols = self.key, self.order[0], [self.key, *self.order, *self.channels]
        new = new.select(*cols)
        none = [F.lit(0).cast("long").alias(c) for c in ("_seen", "_kept", "_dropped")]
        if held is None:
            rows = new.select(*cols, *none, F.lit(False).alias("_old"), F.lit(False).alias("_late"))
            return rows, new.select(key, F.lit(1).cast("long").alias("_now")).where(F.lit(False))
        facts = held.groupBy(key).agg(F.max("_seen").alias("_seen"), F.count(F.lit(1)).alias("_kept"), F.min(time).alias("_oldest"),
                                      F.max(time).alias("_newest"), F.max("_dropped").alias("_dropped"))
        joined = attach(new, facts, [key], self.limit)
        late = F.coalesce(F.col(time) < F.col("_newest"), F.lit(False))
        out = late & (F.col("_kept") >= self.width) & F.coalesce(F.col(time) < F.col("_oldest"), F.lit(False))
        joined = joined.withColumn("_late", late).withColumn("_out", out)
        number = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("_seen", "_kept", "_dropped")]
        fresh = joined.where("NOT _out").select(*cols, *number, F.lit(False).alias("_old"), "_late")
        touched = same_key(facts, new.select(key).distinct(), [key])
        kept = same_key(held.select(*cols), touched.select(key, "_seen", "_kept", "_dropped"), [key])
        old = kept.select(*cols, "_seen", "_kept", "_dropped", F.lit(True).alias("_old"), F.lit(False).alias("_late"))
        return fresh.unionByName(old), joined.where("_out").groupBy(key).agg(F.count(F.lit(1)).alias("_now"))

    def _windows(self, rows: DataFrame) -> DataFrame:
        """Every record with its place in its object and the features of the window it ends."""
        f = framed(rows, [self.key], list(self.order), self.width - 1, limit=self.limit)
        df = f.df.withColumns({f"_d_{c}": F.col(c).cast("double") - F.lag(F.col(c).cast("double")).over(f.ordered) for c in self.channels})
        span = Span(self.width, f)
        values = {n: v for c in self.channels for n, v in window_values(span, c, self.width).items()}
        return f.finish(df.withColumns(values)).drop(*[f"_d_{c}" for c in self.channels])

    def _runs(self, windows: DataFrame, before: DataFrame | None) -> DataFrame:
        """Windows with `run`, the alerts in a row that end with each, going on from the runs of earlier batches."""
        rows = windows.select(self.key, "win", "t_end", F.coalesce(self.fired, F.lit(False)).alias("_fired"))
        if before is None:
            rows = rows.withColumn("_run", F.lit(0).cast("long"))
        else:
            rows = attach(rows, before.select(self.key, "_run"), [self.key], self.limit).withColumn("_run", F.coalesce("_run", F.lit(0).cast("long")))
        layout = layout_of(rows, [self.key], ["win"], self.limit)
        placed = with_position(rows, [self.key], ["win"], size=None, layout=layout)
        marked = running(placed, [self.key], ["win"], {"_quiet": ("max", F.when(~F.col("_fired"), F.col("pos")))}, layout=layout)
        return marked.withColumn("run", F.col("pos") - F.coalesce(F.col("_quiet"), F.lit(-1).cast("long") - F.col("_run")))

    def _step(self, base: str):
        names = [f"{c}_{n}" for c in self.channels for n in ("mean", "std", "min", "max", "d1_mean", "d1_std", "d2_mean", "slope", "ratio")]

        def step(new: DataFrame, batch: int) -> None:
            spark, key, time = new.sparkSession, self.key, self.order[0]
            held = self._state(spark, base, "held", batch)
            rows, dropped = self._merged(new, held)
            rows = rows.persist()
            done = self._windows(rows).persist()
            ends = done.where(f"NOT _old AND NOT _late AND pos >= {self.width - 1}")
            # an object's records before those held, and its place among those held
            win = (F.col("_seen") - F.col("_kept") + F.col("pos") - (self.width - 1)).alias("win")
            ends.select(key, win, F.col(time).alias("t_end"), *names).write.mode("overwrite").parquet(f"{base}/windows/batch={batch}")
            last = done.where(F.col("pos") >= F.col("n") - self.width).select(key, *self.order, *self.channels, (F.col("_seen") - F.col("_kept") + F.col("n")).alias("_seen"), "_dropped")
            last = same_key(last, dropped, [key], "left").withColumn("_dropped", F.col("_dropped") + F.coalesce("_now", F.lit(0).cast("long"))).drop("_now")
            self._save(last, held, base, "held", batch)
            if self.fired is not None:
                before = self._state(spark, base, "runs", batch)
                runs = self._runs(spark.read.parquet(f"{base}/windows/batch={batch}"), before).persist()
                runs.where(F.col("run") == self.k).select(key, "win", "t_end").write.mode("overwrite").parquet(f"{base}/sustained/batch={batch}")
                self._save(runs.groupBy(key).agg(F.max_by("run", "win").alias("_run")), before, base, "runs", batch)
                runs.unpersist()
            done.unpersist()
            rows.unpersist()
        return step

    def run(self, stream: DataFrame, base: str | None = None) -> str:
        """Run over everything that is there and return the folder; with the `base` of an earlier run it goes on from there."""
        base = base or f"{ensure_checkpoint_dir(stream.sparkSession)}/split-{uuid.uuid4().hex}"
        q = (stream.writeStream.foreachBatch(self._step(base)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
        q.awaitTermination()
        return base

    @staticmethod
    def windows(spark: SparkSession, base: str) -> DataFrame:
        return spark.read.parquet(f"{base}/windows").drop("batch")

    @staticmethod
    def sustained(spark: SparkSession, base: str) -> DataFrame:
        return spark.read.parquet(f"{base}/sustained").drop("batch")

    def counts(self, spark: SparkSession, base: str) -> DataFrame:
        """(key, seen, dropped) of every object after the last batch."""
        table = spark.read.parquet(f"{base}/held")
        return table.groupBy(self.key).agg(F.max_by("_seen", "_batch").alias("seen"), F.max_by("_dropped", "_batch").alias("dropped"))
