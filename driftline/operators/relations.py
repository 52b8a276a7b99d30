"""Set relations, deduplication, splits and folds over identities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalar import row_digest
from driftline.operators.ordering import ROWS_PER_TASK, framed, with_position


def dedupe(df: DataFrame, key: Sequence[str], load_no: str, tie: Sequence[str]) -> DataFrame:
    """One record per key, the earliest load winning and within it the first by `tie`; records with an incomplete key are dropped.

    A partial aggregate keeps one candidate per task, so a large group of copies
    collapses before the shuffle.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    known = df.dropna(subset=list(key))
    return known.groupBy(*key).agg(F.min_by(whole, F.struct(load_no, *tie)).alias("_r")).select("_r.*")


def set_relations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every identity of either side with the sides it occurs on."""
    both = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    sides = both.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    where = F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both").when(F.col("_a") == 1, "first").otherwise("second")
    return sides.select(key, where.alias("side"))


def duplicated_rows(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of `b` whose digest over `columns` also occurs in `a` for the same key."""
    left = a.select(key, row_digest(columns).alias("digest")).distinct()
    return b.withColumn("digest", row_digest(columns)).join(left, [key, "digest"], "left_semi")


def interleave(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Union of record streams with the source in a column."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def interleaving(a: DataFrame, b: DataFrame, key: str, time: str) -> DataFrame:
    """Per shared object: `clean` when every time of `a` lies before every time of `b`."""
    left = a.groupBy(key).agg(F.max(time).alias("max_first"))
    right = b.groupBy(key).agg(F.min(time).alias("min_second"))
    kind = F.when(F.col("max_first") < F.col("min_second"), "clean").otherwise("interleaved")
    return left.join(right, key).withColumn("pattern", kind)


def monotonicity(df: DataFrame, key: str, time: str, order: Sequence[str], *,
                 limit: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """First record per object whose time does not exceed the one before, by file order."""
    frames = framed(df, [key], order, 1, limit=limit, rows=rows)
    before = F.lag(time).over(frames.ordered)
    checked = frames.finish(frames.df.withColumn("_before", before))
    bad = F.col(time) <= F.col("_before")
    kind = F.when(F.col(time) == F.col("_before"), "duplicate").otherwise("reversal")
    out = checked.groupBy(key).agg(
        F.min(F.when(bad, F.col("pos"))).alias("violation_pos"),
        F.min_by(kind, F.when(bad, F.col("pos"))).alias("violation"))
    return out


# ---- splits -------------------------------------------------------------------

def _ticket(key: str, seed: int) -> Column:
    """Pseudo-random, order-free ticket of an identity."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def _ranked(ids: DataFrame, key: str, by: Sequence[str], seed: int, **kw) -> DataFrame:
    t = ids.withColumn("_ticket", _ticket(key, seed))
    # the leading hex digits as a number give the order column its slices
    t = t.withColumn("_lead", F.conv(F.substring("_ticket", 1, 12), 16, 10).cast("double"))
    return with_position(t, by, ["_lead", "_ticket", key], pos="_rank", size="_n", **kw)


def split_identities(ids: DataFrame, key: str, *, seed: int = 42, most: int = 200, share: float = 0.8, **kw) -> DataFrame:
    """Seeded train/test split: min(most, floor(share·n)) identities train."""
    ranked = _ranked(ids.select(key).distinct(), key, [], seed, **kw)
    size = F.least(F.lit(most), F.floor(F.col("_n") * F.lit(share)))
    return ranked.select(key, F.when(F.col("_rank") < size, "train").otherwise("test").alias("split"))


def split_stratified(ids: DataFrame, key: str, stratum: str, *, seed: int = 42, share: float = 0.7, **kw) -> DataFrame:
    """Seeded split with the same training share in every stratum."""
    ranked = _ranked(ids.select(key, stratum).distinct(), key, [stratum], seed, **kw)
    size = F.floor(F.col("_n") * F.lit(share))
    return ranked.select(key, stratum, F.when(F.col("_rank") < size, "train").otherwise("test").alias("split"))


def sample_identities(ids: DataFrame, key: str, n: int, *, seed: int = 42) -> DataFrame:
    """n identities without replacement."""
    return ids.select(key).distinct().orderBy(_ticket(key, seed), key).limit(n)


def holdout_folds(df: DataFrame, fold: str) -> DataFrame:
    """Test rows of every fold: the fold is the value of its own group column.

    Training rows of a fold are all other rows; they are selected with
    `fold <> value` (or by subtracting the fold's aggregate from the total), not
    copied once per fold.
    """
    return df.withColumn("fold", F.col(fold))


def leave_out_means(df: DataFrame, fold: str, columns: Sequence[str]) -> DataFrame:
    """Training mean and deviation per fold, as total minus the held-out group.

    Counts, means and centred squares are combined, so large means do not cancel.
    """
    def moments(prefix, frame):
        return frame.agg(F.count(F.lit(1)).alias(f"{prefix}_rows"), *[x for c in columns for x in (
            F.count(c).alias(f"{prefix}_n_{c}"), F.avg(c).alias(f"{prefix}_m_{c}"), F.var_pop(c).alias(f"{prefix}_v_{c}"))])

    both = moments("o", df.groupBy(fold)).crossJoin(F.broadcast(moments("t", df)))          # the total is one row
    out = {"n_train": F.col("t_rows") - F.col("o_rows"), "n_test": F.col("o_rows")}
    for c in columns:
        n_all, n_own = F.col(f"t_n_{c}"), F.col(f"o_n_{c}")
        n = F.nullif((n_all - n_own).cast("double"), F.lit(0.0))
        m_all, m_own = F.col(f"t_m_{c}"), F.coalesce(f"o_m_{c}", f"t_m_{c}")
        mean = m_all + (m_all - m_own) * n_own / n
        squares = F.col(f"t_v_{c}") * n_all - F.coalesce(F.col(f"o_v_{c}") * n_own, F.lit(0.0)) - (m_own - mean) * (m_own - mean) * n * n_own / n_all
        out[f"{c}_mean"] = mean
        out[f"{c}_std"] = F.sqrt(F.greatest(squares / n, F.lit(0.0)))
    return both.select(fold, *[v.alias(k) for k, v in out.items()])


def cross_folds(datasets: Sequence[str], pairs: Sequence[tuple[str, ...]]) -> list[tuple[str, tuple[str, ...], bool]]:
    """(evaluated data set, fitted on, held out?) for each fit group and data set."""
    return [(d, p, d not in p) for p in pairs for d in datasets]


# ---- object attributes --------------------------------------------------------

def classify_objects(df: DataFrame, key: str, epoch: str, decay: str, cutoff: str) -> DataFrame:
    """`reentry` when any record carries a decay date, else by the last epoch."""
    agg = df.groupBy(key).agg(F.max(decay).alias("_decay"), F.max(epoch).alias("last_epoch"),
                              F.count(F.lit(1)).alias("n_records"))
    kind = (F.when(F.col("_decay").isNotNull(), "reentry")
            .when(F.col("last_epoch").cast("date") >= F.lit(cutoff).cast("date"), "operational").otherwise("ambiguous"))
    return agg.select(key, "last_epoch", "n_records", kind.alias("class"))


def latest_known(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Last non-empty value of each attribute per object."""
    place = F.struct(*[F.col(c) for c in order])

    def known(c):
        return F.col(c).isNotNull() & (F.col(c).cast("string") != "")

    return df.groupBy(key).agg(*[F.max_by(c, F.when(known(c), place)).alias(c) for c in columns])


def holdout_objects(df: DataFrame, key: str, designator: str, epoch: str, prefix: str, cutoff: str) -> DataFrame:
    """Objects whose designator starts with `prefix` and whose last epoch is not after the cutoff."""
    known = F.col(designator).isNotNull() & (F.col(designator) != "")
    first = F.min_by(designator, F.when(known, F.col(epoch)))
    agg = df.groupBy(key).agg(first.alias("designator"), F.max(epoch).alias("last_epoch"))
    return agg.where(F.col("designator").startswith(prefix)
                     & (F.col("last_epoch").cast("date") <= F.lit(cutoff).cast("date")))


def enough_history(df: DataFrame, key: Sequence[str], at_least: int) -> DataFrame:
    """Records of objects with at least `at_least` records."""
    big = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least).drop("_n")
    return df.join(big, list(key), "left_semi")


def row_accounting(inputs: Sequence[DataFrame], outputs: Sequence[DataFrame]) -> DataFrame:
    """Rows in, rows out, and whether they agree."""
    def total(frames, name):
        one = None
        for f in frames:
            c = f.agg(F.count(F.lit(1)).alias("_c"))
            one = c if one is None else one.unionByName(c)
        return one.agg(F.sum("_c").alias(name)).withColumn("_one", F.lit(1))
    both = total(inputs, "rows_in").join(total(outputs, "rows_out"), "_one").drop("_one")
    return both.withColumn("balanced", F.col("rows_in") == F.col("rows_out"))
