"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
documents. All stages but the last return the columns of `documents`; each works on all that its predecessor kept.

Defined cases are those of the operators. Besides: a document with a null id is kept by the filters and treated as an id before all
others; documents that share an id are judged row by row; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, decontaminate, lines, quality, simhash
from driftline.llm.common import discard, fresh, needs, store


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, = fresh(docs, "score")
    return quality.scored(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines and line runs are deleted from the texts; n_chars follows the text."""
    found = lines.deduplicated(docs)
    out = found.select(*docs.columns)
    return needs(out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out, found)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; texts without words are one group.

    Texts are linked if their sets of five-word shingles have Jaccard similarity 0.8 or more; fingerprints find the candidates. Of rows with
    equal id and text the one whose columns have the smallest hash stays.
    """
    return simhash.distinct_texts(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and proof that they decode to it."""
    import public_tokenizers

    return bpe.tokenized(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_filter", filter_quality),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("bpe_encoding", encode),
]

#: A trained classifier cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = stage(spark, docs, sf_dir)
        docs, before = store(rows, name), docs
        discard(rows, before)                           # scratch tables of the stage, and its input
    return docs
