"""Result tables, feature tables and frozen models on shared storage."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalar import row_digest
from driftline.models.lda import Projection
from driftline.operators.relations import dedupe
from driftline.session import materialise


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Content digest of a table of any size, independent of row order.

    Row digests are grouped by their first byte; sums of the digests' halves are
    order-free, so only 256 rows meet at the end.
    """
    rows = df.select(row_digest(columns).alias("_d"))
    half = lambda a: F.conv(F.substring("_d", a, 12), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy(F.substring("_d", 1, 2).alias("_g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(half(1)).alias("a"), F.sum(half(13)).alias("b"))
    line = F.concat_ws(":", "_g", "n", "a", "b")
    return sums.agg(F.sum("n").alias("n_rows"), F.md5(F.concat_ws("|", F.array_sort(F.collect_list(line)))).alias("digest"))


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_records(df: DataFrame, path: str, key: str, buckets: int = 64, mode: str = "append", rows: int | None = None,
                  rows_per_file: int = 5_000_000) -> None:
    """Append records by id range: a bounded number of folders instead of one file per object, as many files as the rows need."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("id_bucket")
    spread = max(1, -(-(df.count() if rows is None else rows) // (buckets * rows_per_file)))
    # a row hash next to the bucket keeps one large object from filling a single task
    out = df.withColumn("id_bucket", bucket).withColumn("_spread", F.pmod(F.xxhash64(*df.columns), F.lit(spread)))
    out.repartition(buckets * spread, "id_bucket", "_spread").drop("_spread").write.mode(mode).partitionBy("id_bucket").parquet(path)


def merge_records(new: DataFrame, path: str, key: str, time: str, tie: Sequence[str] = (), *, buckets: int = 64, rows_per_file: int = 5_000_000) -> list[int]:
    """Merge a load into the record cache: one record per (key, time), the existing one wins, of a load the first by `tie`; records without
    key or time are dropped. Returns the buckets that were rewritten.

    Only buckets with new records are read and rewritten; the others keep their files. Files are ordered by key and time and cut by ranges of them, so a
    large object fills several. The merged buckets are written next to the cache first and replace the old ones at the commit of the second write.
    """
    spark = new.sparkSession
    columns = new.columns
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    load = materialise(new.dropna(subset=[key, time]).withColumn("id_bucket", bucket))
    touched = sorted(r[0] for r in load.select("id_bucket").distinct().collect())          # at most `buckets`
    if not touched:
        return []
    both = load.withColumn("_load", F.lit(1))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        old = spark.read.schema(load.schema).parquet(path).where(F.col("id_bucket").isin(touched))
        both = both.unionByName(old.withColumn("_load", F.lit(0)))
    merged = dedupe(both, [key, time], "_load", tie).drop("_load").select(*columns, "id_bucket")
    merged = materialise(merged)
    files = max(len(touched), -(-merged.count() // rows_per_file))
    ordered = merged.repartitionByRange(files, "id_bucket", key, time).sortWithinPartitions("id_bucket", key, time)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id_bucket").parquet(path)
    return touched


def write_ordered(df: DataFrame, path: str, key: str, time: str) -> None:
    """Records by numeric id, then by falling time, as CSV with a header."""
    df.orderBy(F.col(key).cast("int"), F.col(time).desc()).write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("overwrite").option("header", True).format(form).save(path)


def save_model(spark: SparkSession, path: str, model: Projection, basin: DataFrame, epsilon: float,
               config: Mapping[str, object]) -> str:
    """Coefficients, basin and settings as tables, with content digests; returns the model digest."""
    coefs = model.table(spark)
    write_table(coefs, f"{path}/coefficients")
    write_table(basin, f"{path}/basin")
    names = ["feature", "mean", "std", "weight", "coef"]
    marks = {"coefficients": table_digest(spark.read.parquet(f"{path}/coefficients"), names).first()["digest"],
             "basin": table_digest(spark.read.parquet(f"{path}/basin"), basin.columns).first()["digest"]}
    meta = spark.createDataFrame([(model.offset, float(epsilon), json.dumps(dict(config), sort_keys=True),
                                   json.dumps(marks, sort_keys=True))],
                                 "offset double, epsilon double, config string, digests string")
    write_table(meta, f"{path}/meta")
    return marks["coefficients"]


def load_model(spark: SparkSession, path: str, config: Mapping[str, object] | None = None):
    """(projection, basin, epsilon, drifted settings); altered content is an error. Nothing is ever fitted here."""
    coefs, basin = spark.read.parquet(f"{path}/coefficients"), spark.read.parquet(f"{path}/basin")
    meta = spark.read.parquet(f"{path}/meta").first()
    marks = json.loads(meta["digests"])
    found = {"coefficients": table_digest(coefs, ["feature", "mean", "std", "weight", "coef"]).first()["digest"],
             "basin": table_digest(basin, basin.columns).first()["digest"]}
    if found != marks:
        raise ValueError(f"model content changed: {[k for k in marks if found[k] != marks[k]]}")
    rows = coefs.orderBy("idx").collect()
    model = Projection([r["feature"] for r in rows], {r["feature"]: (r["mean"], r["std"]) for r in rows},
                       {r["feature"]: r["weight"] for r in rows}, {r["feature"]: r["coef"] for r in rows}, meta["offset"])
    saved = json.loads(meta["config"])
    drift = sorted(k for k in {*saved, *(config or {})} if config is not None and saved.get(k) != config.get(k))
    return model, basin, meta["epsilon"], drift
