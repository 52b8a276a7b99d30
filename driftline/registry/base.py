"""Registered queries: a Spark callable, and the same result as plain SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The input tables of one folder, with row counts taken from the file footers."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder
        self._rows: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, name: str) -> int:
        if name not in self._rows:
            self._rows[name] = getattr(self, name).count()
        return self._rows[name]

    # ---- stand-in histories ----
    def history(self) -> DataFrame:
        """events as object histories: time in days, channels v and k."""
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.events.select(
            "user_id", "event_id", (micros / F.lit(86400000000.0)).alias("t"), F.col("value").alias("v"),
            F.get_json_object("props", "$.k").cast("double").alias("k"), "event_type")

    def supply(self) -> DataFrame:
        """lineitem as dense multi-channel histories per supplier (ties broken by order and line)."""
        return self.lineitem.select(
            "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(86400000000.0)).alias("day"))


SUPPLY_ORDER = ["day", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]

EV = """ev AS (
  SELECT user_id, event_id, epoch_us(ts) / CAST(86400000000 AS DOUBLE) AS t, value AS v,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events)"""

LI = """li AS (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax,
         epoch_us(l_shipdate) / CAST(86400000000 AS DOUBLE) AS day,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
                            l_extendedprice, l_quantity) - 1 AS pos,
         count(*) OVER (PARTITION BY l_suppkey) AS n
  FROM lineitem)"""


def windows_sql(source: str, key: str, width: int, stride: int) -> str:
    """wr: the rows of each complete window with their offset."""
    return f"""wr AS (
  SELECT s.{key} AS obj, s.pos AS win, e.*, e.pos - s.pos AS off
  FROM (SELECT {key}, pos FROM {source} WHERE pos % {stride} = 0 AND pos + {width} <= n) s
  JOIN {source} e ON e.{key} = s.{key} AND e.pos BETWEEN s.pos AND s.pos + {width - 1})"""


# Both engines round after the same small shift: values that lie exactly half way
# between two results (many test columns have two decimals) then round alike.
def r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(3.7 * 10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def R(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + CAST({3.7 * 10.0 ** -(digits + 3)!r} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add
