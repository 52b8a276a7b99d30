"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  name: str = "driftline") -> SparkSession:
    """A single-machine session with the settings the library is tested under."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(name)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from `spark.checkpoint.dir`. Only a single machine may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder once, so that several jobs can read it.

    Used where fitting, calibration and scoring all read the same features. Readers take only the columns they need,
    and the copy survives the loss of executors.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
