"""The queries with SQL against DuckDB, and the pipeline's contract, on the small tables."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from driftline.llm import queries
from tests.oracle_check import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_all_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    result = compare(spark, connect(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLE[name])
    assert result.startswith("ok (") and "types" not in result, result


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    start, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs.cache(), FOLDER)
        assert docs.columns == start
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() == seen[-1] and out.where("NOT round_trip").count() == 0


def test_pipeline_takes_missing_values(spark):
    start = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("score", F.lit(0))
    extra = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, "one line\ntwo lines", None, "s", 5, 3), (2, "one line\ntwo lines", None, "s", 5, 3),
                                  (3, "word " * 30_000, "en", "s", 5, 4)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    docs, ends = start.unionByName(extra), []
    for rows in (docs, docs.where("false"), extra):
        for name, stage in corpus_pipeline.STAGES[1 if rows is extra else 0:]:             # the classifier needs labelled rows, or none
            rows = stage(spark, rows, FOLDER)
            found = rows.select("doc_id", "score").collect()
            assert name == "bpe_encoding" or set(rows.columns) == set(docs.columns)
        ends.append(found)
    assert ends[0] and ends[1] == [] and Counter(r.doc_id for r in ends[2]) == Counter([None, 2, 3])


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on its own input: SQL for the lines, plain Python for the rest."""
    import hashlib
    import re

    import duckdb

    from driftline.llm import lines

    docs, kept = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).coalesce(1).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    right = [(i in kept[0]) == bool(labels[i]) for i in {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()} if i in labels]
    assert sum(right) >= 0.95 * len(right)

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/0/*.parquet')")
    expect = {row[0]: row[4] for row in con.execute(lines.SQL).fetchall()}
    assert {i: hashlib.sha256((r.text or "").encode()).hexdigest() for i, r in kept[1].items()} == expect

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: shingles(r.text) for i, r in kept[1].items()}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s or [None]:
            holders.setdefault(x, []).append(i)
    for i, s in sorted(sets.items()):
        for j, both in Counter(j for x in s or [None] for j in holders[x]).items():
            if j < i and (not s or 5 * both >= 4 * (len(s) + len(sets[j]) - both)):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    assert set(kept[2]) == {i for i in sets if find(i) == i}

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[p:p + 10]) for p in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[p:p + n]) in windows for n in sizes for p in range(len(w) - n + 1))
    assert set(kept[3]) == {i for i, r in kept[2].items() if not hit(split(r.text))}

    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    from driftline.llm import bpe
    ranks = {t: k for k, t in enumerate(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(list(r["ids"]) == ref.encode_ordinary(kept[3][i].text or "") and r.round_trip for i, r in kept[4].items())
