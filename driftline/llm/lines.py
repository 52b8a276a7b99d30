"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling; later copies of repeated runs go.

Blank lines (spaces, tabs, carriage returns) are no part of the sequences and stay. A line is named by its place in the order of
line ids; only names that occur more than once go on. Each round names runs twice as long by the pair of names they consist of,
in pair order: names are ranks of suffixes by their first 1, 2, 4 ... lines. A run that repeats has halves that repeat, so every round
works on what the last one left, and naming goes on until no name repeats.

The LCP intervals are then cut out from the longest names down. A class holds the places that share a run, and its first place in
(doc_id, position) order. The places of a class whose runs go on with one name of 2^k lines share a run longer by 2^k; all but the first of them move to a class of
their own, in which the first one stands as a witness; the first itself stays, since that longer run does not start before it. So a place ends with the longest
run that also starts earlier, whatever its length: a later copy. Copies of `min_lines` lines or more are deleted, overlapping ones as one maximal run.

A line that a large share of documents hold is no hot spot: names are counted map-side first, and those above a ten-thousandth of all places (so at
most 10,000) are broadcast with their first place instead of being joined by a shuffle.

Names come from a range-partitioned sort that is written to the shared folder before its row numbers are used, so no task
sees all names and none changes when a task is run again.

Defined cases: a null text has no lines and stays null; a null id counts as before all others; rows that share an id are ordered by their text's
hash; equal rows are treated alike and do not delete each other's lines; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import discard, fresh, map_arrow, needs, pieces, row_id, store

MIN_LINES, HOT_ROWS, HOT_SHARE = 1, 1_000, 10_000
_BLANK = " \t\r"
PLACE = ["_doc", "_txt", "_pos"]


def _sequences(docs: DataFrame) -> DataFrame:
    """(_doc, _txt, _pos, a, b): the non-blank lines of every text in order, with a 128-bit id."""
    ids = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(_BLANK)) != ""),
                      lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    return docs.select(*row_id(), F.posexplode(ids).alias("_pos", "line")).select(*PLACE, "line.a", "line.b")


def _attached(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """rows.join(keys, ["a", "b"]); keys (a, b, n, ...; written) have one row for each pair. Pairs with many rows are broadcast."""
    many = F.col("n") > max(HOT_ROWS, total // HOT_SHARE)
    if keys.where(many).isEmpty():
        return rows.join(keys, ["a", "b"])
    hot = keys.where(many)
    flag = hot.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    same = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    cold = rows.join(F.broadcast(flag), same, "left_anti").join(keys.where(~many), ["a", "b"])
    return cold.unionByName(rows.join(F.broadcast(hot), ["a", "b"]))


def _repeated(rows: DataFrame, label: str) -> DataFrame:
    """(a, b, n, first) of the pairs that occur at two places or more, with their first place; written."""
    keys = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last"))
    return store(keys.where("first != last").drop("last"), f"{label}-pairs")


def _named(rows: DataFrame, label: str, total: int) -> DataFrame:
    """Rows (place, a, b) whose (a, b) occurs at two places or more, with its rank in (a, b) order as `name`; written."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _repeated(rows, label)
    order = store(keys.select("a", "b", "n").repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()), f"{label}-order")
    out = store(_attached(rows, order, total).select(*PLACE, "name").dropDuplicates(PLACE), label)
    discard(keys, order)
    return out


def _ranks(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Names (place, name) of the runs of 1, 2, 4 ... lines that start at two places or more, until there are none; what was written; all places."""
    pairs = store(_sequences(docs), "line-ids")         # written once: the counts and the join both read the ids, not the texts
    total, used, levels = pairs.count(), [pairs], []
    while True:
        ranks = _named(pairs, f"lines-{1 << len(levels)}", total)
        used.append(ranks)
        if ranks.isEmpty():
            return levels, used, total
        ahead = ranks.select("_doc", "_txt", (F.col("_pos") - (1 << len(levels))).alias("_pos"), F.col("name").alias("b"))
        levels.append(ranks)
        pairs = ranks.withColumnRenamed("name", "a").join(ahead, PLACE)


def later_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(_doc, _txt, _pos, lines): the longest run from each place that also starts earlier, where it has `min_lines` lines or more."""
    levels, used, total = _ranks(docs)
    if not levels:
        return needs(used[0].select(*PLACE, F.lit(0).cast("long").alias("lines")).where("false"), *used)
    # places with a copy so far: a, their class, and lines, the length of its run; all others are in class 0, of no lines
    held = witnesses = None
    for k in reversed(range(len(levels))):
        names = levels[k].withColumnRenamed("name", "b")
        rows = names.select(*PLACE, F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("lines"), "b", F.lit(True).alias("_copy"))
        if held is not None:
            both = held.withColumn("_copy", F.lit(True)).unionByName(witnesses.withColumn("_copy", F.lit(False))).withColumn("_at", F.col("_pos") + F.col("lines"))
            both = both.join(names.withColumnRenamed("_pos", "_at"), ["_doc", "_txt", "_at"]).drop("_at")
            rows = rows.join(held.select(*PLACE), PLACE, "left_anti").unionByName(both)
        going = store(rows, f"lines-going-{k}")
        keys = going.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first"), (F.first("lines") + (1 << k)).alias("reach"))
        keys = store(keys.where("n > 1").withColumn("id", F.monotonically_increasing_id() * len(levels) + k + 1), f"lines-classes-{k}")
        moved = _attached(going.where("_copy"), keys, total).where(F.struct(*PLACE) != F.col("first")).select(*PLACE, F.col("id").alias("a"), F.col("reach").alias("lines"))
        if held is not None:
            moved = held.unionByName(moved).groupBy(*PLACE).agg(F.max(F.struct("lines", "a")).alias("_s")).select(*PLACE, "_s.a", "_s.lines")
        held = store(moved, f"lines-held-{k}")
        first = keys.select("first.*", F.col("id").alias("a"), F.col("reach").alias("lines"))
        witnesses = first if witnesses is None else witnesses.unionByName(first)
        used += [going, keys, held]
    return needs(held.where(F.col("lines") >= min_lines).select(*PLACE, "lines"), *used)


def _cut(text: str | None, starts: list[int] | None, lengths: list[int] | None) -> tuple[str | None, int, int, int, str]:
    """What stays of a text, its lines, removed lines and removed runs, and the lengths of the copies that no other holds, in order."""
    if text is None:
        return None, 0, 0, 0, ""
    lines = text.split("\n")
    real = [k for k, x in enumerate(lines) if x.strip(_BLANK)]
    if not starts:
        return text, len(real), 0, 0, ""
    order = np.argsort(starts)
    starts, lengths = np.asarray(starts)[order], np.asarray(lengths)[order]
    ends = starts + lengths
    whole = np.concatenate([[True], ends[1:] > np.maximum.accumulate(ends)[:-1]])
    delta = np.zeros(len(real) + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    gone = np.cumsum(delta[:-1]) > 0
    drop = {real[k] for k in np.flatnonzero(gone).tolist()}
    begins = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return "\n".join(x for k, x in enumerate(lines) if k not in drop), len(real), len(drop), begins, ",".join(map(str, lengths[whole].tolist()))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, *, lengths: str | None = None) -> DataFrame:
    """The rows of `docs` with their columns, `text` without the later copies, and n_lines, n_removed, n_runs (with underscores if
    taken).

    `lengths` names a further column: lines of the later copies that no other copy holds, in text order, comma-joined."""
    own, (doc, txt, starts, spread, *added) = docs.columns, fresh(docs, "_doc", "_txt", "_starts", "_lengths", "n_lines", "n_removed", "n_runs")
    later = later_runs(docs, min_lines)
    spans = later.groupBy("_doc", "_txt").agg(F.collect_list(F.struct("_pos", "lines")).alias("s")).select(F.col("_doc").alias(doc), F.col("_txt").alias(txt), F.col("s._pos").alias(starts), F.col("s.lines").alias(spread))
    marked = docs.withColumns(dict(zip((doc, txt), row_id())))
    joined = marked.join(spans.hint("shuffle_hash"), [doc, txt], "left").select(*own, starts, spread)
    told = [lengths] if lengths else []
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + "".join(f", {n} long" for n in added) + "".join(f", `{n}` string" for n in told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = [_cut(*x) for x in zip(*(part.column(c).to_pylist() for c in ("text", starts, spread)))]
                cols = [pa.array([x[0] for x in out], pa.string()) if c == "text" else part.column(c) for c in own]
                cols += [pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3)] + [pa.array([x[4] for x in out], pa.string()) for _ in told]
                yield pa.RecordBatch.from_arrays(cols, [*own, *added, *told])

    return needs(map_arrow(joined, run, schema), later)


def report(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    out = deduplicated(docs.select(F.col("doc_id").cast("long"), "text"), min_lines, lengths="copy_lengths")
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "copy_lengths")


SQL = """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos, dense_rank() OVER (ORDER BY line) AS id FROM l WHERE translate(line, ' ' || chr(9) || chr(13), '') <> ''),
g AS (SELECT doc_id, pos, 1 AS k, min({'d': doc_id, 'p': pos}) OVER (PARTITION BY id) AS f, count(*) OVER (PARTITION BY id) AS c FROM s
  UNION ALL
  SELECT g.doc_id, g.pos, g.k + 1, min({'d': g.doc_id, 'p': g.pos}) OVER (PARTITION BY g.f, s.id), count(*) OVER (PARTITION BY g.f, s.id) FROM g JOIN s ON s.doc_id = g.doc_id AND s.pos = g.pos + g.k WHERE g.c > 1),
m AS (SELECT doc_id, pos, max(k) AS len FROM g WHERE f <> {'d': doc_id, 'p': pos} GROUP BY doc_id, pos),
w AS (SELECT s.*, m.len, max(s.pos + m.len) OVER (PARTITION BY s.doc_id ORDER BY s.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM s LEFT JOIN m ON m.doc_id = s.doc_id AND m.pos = s.pos),
c AS (SELECT *, coalesce(greatest(held, pos + len), 0) > pos AS gone FROM w),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM c),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs,
  string_agg(CAST(len AS VARCHAR), ',' ORDER BY pos) FILTER (len IS NOT NULL AND pos + len > coalesce(held, 0)) AS copy_lengths FROM r GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) AS kept FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.no = l.no WHERE NOT coalesce(r.gone, false) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_runs, 0) AS n_runs, sha256(coalesce(t.kept, '')) AS kept_sha256, coalesce(k.copy_lengths, '') AS copy_lengths
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
