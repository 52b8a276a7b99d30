"""What the substring dedup sends: the filter of repeated anchors, hashes before bytes, only texts that lose bytes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import bytes_dedup, common, repeated


def test_pack():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        a, b, c = rng.integers(0, 2 ** 63, n).astype(np.uint64), rng.integers(-9, 9, n), rng.integers(0, 300, n).astype(np.uint32)
        got = common.unpack(common.binary([common.pack([a, b, c])])[0], [np.uint64, np.int64, np.uint32])
        assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(got, (a, b, c)))


@pytest.mark.parametrize("flush", [2_000_000, 700])
def test_filter_holds_repeated_keys_only(spark, flush, monkeypatch):
    """More keys than the filter has bits: those that occur once do not fill it."""
    monkeypatch.setattr(repeated, "FLUSH", flush)
    monkeypatch.setattr(repeated, "LEAST_BITS", 10)
    n = 2 ** 18
    keys = np.random.default_rng(2).integers(0, 2 ** 63, n).astype(np.uint64)
    df = spark.createDataFrame([(str(k),) for k in range(n)] + [(str(k),) for k in range(0, n, 64)], "text string").repartition(5)
    shared = repeated.repeated(df, lambda part: keys[[int(t) for t in part.column("text").to_pylist()]], n, 2 ** 17).value
    assert len(shared.table) * 8 == 2 ** 17
    got, twice = shared.maybe(keys), np.arange(n) % 64 == 0
    assert got[twice].all() and got[~twice].mean() < 0.02


def written(spark):
    executors = spark._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_shuffles_less_than_the_text(spark):
    """Half of the texts are copies or hold a shared passage; neither they nor the others are sent several times over."""
    rng = random.Random(5)

    def text(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))

    passage = text(600)
    rows = [(k, text(3000)) for k in range(400)]
    rows += [(1000 + k, rows[k][1]) for k in range(100)] + [(2000 + k, f"{text(1000)}{passage}{text(1000)}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    docs = common.store(docs, "texts")
    before = written(spark)
    got = {r.doc_id: r for r in bytes_dedup.report(docs).collect()}
    assert written(spark) - before < 0.8 * sum(len(t) for _, t in rows)
    assert all(got[k].n_removed == 0 and got[k].n_spans == 0 for k in range(400)) and got[2000].n_removed == 0
    assert all(got[1000 + k].n_removed == 3000 and got[1000 + k].kept_sha256 == hashlib.sha256(b"").hexdigest() for k in range(100))
    assert all(600 <= got[2000 + k].n_removed < 610 and got[2000 + k].n_spans == 1 for k in range(1, 100))


@pytest.mark.parametrize("hot", [50_000, 1])
def test_equal_rows_keep_their_bytes(spark, hot):
    """Rows of equal id and text are one place: they do not remove each other's bytes, and lose what starts earlier in the text itself."""
    rng = random.Random(6)
    once = "".join(rng.choice("abcdefghij") for _ in range(400))
    rows = [(1, once), (1, once), (2, "tail " + once[50:] + "x"), (2, "tail " + once[50:] + "x"), (3, "y" + once[:90]), (4, "z" * 20 + (q := once[::-1]) + "w" + q), (4, "z" * 20 + q + "w" + q)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = bytes_dedup.deduplicated(docs, hot_segments=hot).groupBy("doc_id").agg(F.collect_list("n_removed").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: [0, 0], 2: [350, 350], 3: [0], 4: [400, 400]}
