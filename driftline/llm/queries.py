"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import agenda, bpe, bytes_dedup, decontaminate, fim, lines, near_vectors, quality, shards, simhash, substrings, vector_codes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op3_warc", warc.SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_pages(spark, table(spark, folder, "pages"))


@query("op5_sharding")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return shards.sharded_documents(table(spark, folder, "documents"))


@query("op8_simhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.groups(table(spark, folder, "documents"))


@query("op9_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.report(table(spark, folder, "documents"))


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return bytes_dedup.report(table(spark, folder, "documents"))


@query("op4_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op2_embedding_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, folder, "embeddings"))


@query("op6_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_line_dedup", lines.SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return lines.report(table(spark, folder, "documents"))


@query("op11_fill_in_middle")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return fim.report(table(spark, folder, "documents"))


@query("op12_sentencepiece")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return agenda.round_trip(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_vector_codes")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.report(table(spark, folder, "embeddings"))
