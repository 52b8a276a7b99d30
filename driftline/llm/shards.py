"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows are dealt to source partitions by a hash of their content, so that a task run again gives the same rows. The number of
rows that each partition sends to each shard is drawn from the exact multivariate hypergeometric law; each
partition permutes its rows and cuts them by those counts, the rows move to their shards, and each shard permutes again.
A shard is permuted in blocks that are ranges of the random key, so no task holds a shard whole.

Defined cases: null ids, texts and other columns are values like any other; equal rows are told apart by nothing, so any
assignment of theirs is the same; an empty table gives no rows; with fewer rows than shards some shards are empty.
The copy of a text does not pull other copies with it: a uniform shuffle with exact sizes cannot keep groups together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import fresh


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of (partition -> shard) counts with the given row sums and column sums at most one apart."""
    total = sum(counts)
    left = np.array([total // shards + (j < total % shards) for j in range(shards)], np.int64)
    rng, rows = np.random.default_rng(seed), []
    for n in counts:
        row, rest, pool = np.zeros(shards, np.int64), n, int(left.sum())
        for j in range(shards):             # one hypergeometric draw per shard: their chain is the multivariate law
            pool -= int(left[j])
            row[j] = _draw(rng, int(left[j]), pool, rest)
            rest -= int(row[j])
        left -= row
        rows.append(row.tolist())
    return rows


def _draw(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    if take == 0 or good == 0:
        return 0
    if bad == 0:
        return take
    if good + bad < 10 ** 9:
        return int(rng.hypergeometric(good, bad, take))
    # beyond the generator's range (10^9) binomial lots stand in: the sums stay exact, the law is then an approximation
    got = 0
    while take:
        lot = min(take, 10 ** 8)
        share = min(good, max(lot - bad, int(rng.binomial(lot, good / (good + bad)))))
        got, good, bad, take = got + share, good - share, bad - (lot - share), take - lot
    return got


def shuffle_into_shards(df: DataFrame, key: list[str], shards: int = 24, seed: int = 7, rows_per_task: int = 5_000,
                        max_partitions: int = 65_536) -> DataFrame:
    """`df` with `shard` (0 to shards - 1, counts at most one apart) and `slot` (0, 1, ... in each shard), with underscores if taken.

    `key` are the columns whose hash deals and permutes. `max_partitions` bounds the matrix on the driver; beyond
    `max_partitions * rows_per_task` rows the partitions grow, and nothing else changes.
    """
    names = fresh(df, "shard", "slot")
    kept = df.columns
    df = df.select(F.struct(*kept).alias("row"), *[F.col(c).alias(f"_key{k}") for k, c in enumerate(key)])
    key = [f"_key{k}" for k in range(len(key))]
    spark, mark = df.sparkSession, [F.col(c) for c in key]
    final = [*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("shard").alias(names[0]), F.col("slot").cast("long").alias(names[1])]
    n = df.count()
    parts = min(max_partitions, -(-n // rows_per_task) * 4 or 1)

    def rnd(salt: int):
        return F.xxhash64(F.lit(seed * 1000 + salt), *mark)

    dealt = df.withColumns({"_part": F.pmod(rnd(1), F.lit(parts)).cast("int"), "_one": rnd(2), "_two": rnd(3)})
    found = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}   # one number per partition
    matrix = communication_matrix([found.get(p, 0) for p in range(parts)], shards, seed)
    plan = spark.createDataFrame([(p, np.cumsum(row).tolist()) for p, row in enumerate(matrix)], "_part int, _upto array<long>")
    local = dealt.withColumn("_rn", F.row_number().over(W.partitionBy("_part").orderBy("_one", *key)))
    sent = (local.join(F.broadcast(plan) if parts * shards <= 1_000_000 else plan, "_part")
            .withColumn("shard", F.size(F.filter("_upto", lambda x: x < F.col("_rn"))).cast("int")))
    # the second permutation: blocks are ranges of the random key, numbered on from one another
    blocks = max(1, -(-n // (shards * rows_per_task)))
    block = F.expr(f"shiftrightunsigned(_two, 1) div {(2 ** 63 - 1) // blocks + 1}").cast("int") if blocks > 1 else F.lit(0)
    sent = sent.withColumn("_block", block)
    slot = F.row_number().over(W.partitionBy("shard", "_block").orderBy("_two", *key)) - 1
    if blocks == 1:
        return sent.withColumn("slot", slot).select(*final)
    sizes = sent.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("shard", "_block", (F.sum("_n").over(W.partitionBy("shard").orderBy("_block")) - F.col("_n")).alias("_first"))
    return (sent.withColumn("slot", slot).join(first, ["shard", "_block"]).withColumn("slot", F.col("slot") + F.col("_first")).select(*final))


def sharded_documents(docs: DataFrame, shards: int = 24, seed: int = 7, rows_per_task: int = 5_000) -> DataFrame:
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(rows, ["doc_id", "text_crc32", "size"], shards, seed, rows_per_task)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
