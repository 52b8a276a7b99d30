"""Exact nearest neighbours of query rows in a reference set (the "basin").

The reference set is fetched with a row limit first. Within the bound it is
broadcast; beyond it the work is partitioned:

* one dimension: reference values are ranked in slices and stored in blocks with
  `k` copied border values; each distinct query value finds its rank and reads
  one block;
* many dimensions: points are assigned to the nearest of about sqrt(n) pivots,
  and neighbouring cells make up a pack. A query searches its own pack first;
  the distance found there bounds the answer, and it then goes once to every
  pack with a cell that the triangle inequality leaves open. Both rounds are
  a co-grouped join of bounded tiles, and points are copied only to tiles
  that queries visit. A side is cut into about `_CUTS` tiles, more only where a
  tile would hold above `_SEND` values, so copies do not grow with the cells.
  No bound on neighbours or candidates: the result is always exact.

NULL and NaN values, and vectors that hold some, are no neighbours and have none,
whatever the size. Ids may be of any type that has an order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from driftline.operators.ordering import ROWS_PER_TASK, running, with_position
from driftline.session import materialise

BROADCAST_VALUES = 2_000_000        # 16 MB of doubles
_BLOCK = 1_024
_PIVOTS = 4_096                     # at most; they are broadcast
_TILE = 8_192                       # least rows of a tile
_CUTS, _SEND = 8, 4_000_000         # tiles of a side, and most values (32 MB of doubles) of one
_ROUGH = 2_000_000                  # rounded distances held at a time


# ---- one dimension ------------------------------------------------------------

def _nearest_on_line(ref: np.ndarray, x: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and largest of the k smallest distances from each x to sorted `ref`."""
    n = len(ref)
    take = min(k + skip, n)
    at = np.searchsorted(ref, x)
    offsets = np.arange(-take, take)
    place = at[:, None] + offsets[None, :]
    inside = (place >= 0) & (place < n)
    gap = np.where(inside, np.abs(ref[np.clip(place, 0, n - 1)] - x[:, None]), np.inf)
    near = np.sort(gap, axis=1)[:, skip:take]
    if near.shape[1] == 0:
        none = np.full(len(x), np.nan)
        return none, none
    return near.mean(axis=1), near[:, -1]


def distance_on_line(queries: DataFrame, points: DataFrame, x: str, px: str | None = None, k: int = 5, *,
                     exclude_self: bool = False, mean: str | None = "d_mean", kth: str | None = "d_kth",
                     bound: int = BROADCAST_VALUES, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Attach the mean (and k-th) distance to the k nearest reference values.

    `exclude_self` leaves the query's own entry out; the queries must then be
    members of the reference set.
    """
    px = px or x
    skip = 1 if exclude_self else 0
    ref = points.select(F.col(px).cast("double").alias("_p")).where("_p IS NOT NULL AND NOT isnan(_p)")
    local = ref.limit(bound + 1).toArrow()["_p"].to_numpy()
    if len(local) <= bound:
        values = queries.sparkSession.sparkContext.broadcast(np.sort(local))

        @F.pandas_udf("struct<m double, k double>")
        def nearest(col: pd.Series) -> pd.DataFrame:
            arr = col.to_numpy(dtype=float, na_value=np.nan)
            m, last = _nearest_on_line(values.value, arr, k, skip)
            bad = np.isnan(arr)
            return pd.DataFrame({"m": np.where(bad, np.nan, m), "k": np.where(bad, np.nan, last)})

        out = queries.withColumn("_nn", nearest(F.col(x).cast("double")))
        clean = lambda c: F.when(~F.isnan(c), c)
        if mean:
            out = out.withColumn(mean, clean(F.col("_nn.m")))
        if kth:
            out = out.withColumn(kth, clean(F.col("_nn.k")))
        return out.drop("_nn")
    return _distance_on_line_ranked(queries, ref, x, k, skip, mean, kth, limit)


def _distance_on_line_ranked(queries, ref, x, k, skip, mean, kth, limit):
    want = k + skip
    ranked = with_position(ref, [], ["_p"], limit=limit, pos="_r", size=None)
    blocks = ranked.withColumn("_blk", F.explode(F.sequence(
        F.floor(F.greatest(F.col("_r") - want, F.lit(0)) / _BLOCK), F.floor((F.col("_r") + want) / _BLOCK))))
    blocks = blocks.groupBy("_blk").agg(F.sort_array(F.collect_list("_p")).alias("_vals"),
                                        F.min("_r").alias("_first"))
    n_ref = ref.count()
    asked = queries.select(F.col(x).cast("double").alias("_q")).where("_q IS NOT NULL AND NOT isnan(_q)").distinct()
    merged = (ref.groupBy(F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_c"))
              .unionByName(asked.select("_q", F.lit(0).cast("long").alias("_c"))))
    merged = merged.groupBy("_q").agg(F.sum("_c").alias("_c"), F.min("_c").alias("_asked"))
    ranks = running(merged, [], ["_q"], {"_at": ("sum", F.col("_c"))}, limit=limit).where("_asked = 0")
    last_block = F.lit((n_ref - 1) // _BLOCK)
    ranks = ranks.withColumn("_blk", F.least(F.floor(F.greatest(F.col("_at") - 1, F.lit(0)) / _BLOCK), last_block))
    near = ranks.join(blocks, "_blk")
    start = F.greatest(F.col("_at") - F.col("_first") - want, F.lit(0)).cast("int") + 1
    gaps = F.array_sort(F.transform(F.slice("_vals", start, 2 * want), lambda v: F.abs(v - F.col("_q"))))
    near = near.withColumn("_d", F.slice(gaps, skip + 1, k)).where(F.size("_d") > 0)
    cols = [F.col("_q")]
    if mean:
        cols.append((F.aggregate("_d", F.lit(0.0), lambda a, v: a + v) / F.size("_d")).alias(mean))
    if kth:
        cols.append(F.array_max("_d").alias(kth))
    found = near.select(*cols)
    return queries.join(found, queries[x].cast("double") == found["_q"], "left").drop("_q")


# ---- many dimensions ----------------------------------------------------------

def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in col]) if len(col) else np.zeros((0, 1))


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    if not len(column):
        return np.zeros((0, 1))
    return np.concatenate([np.asarray(c.flatten().to_numpy(zero_copy_only=False), float) for c in column.chunks]).reshape(len(column), -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product (rounded; exact ones are taken for the few that matter)."""
    return np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * x @ y.T + np.einsum("ij,ij->i", y, y)[None, :]


def _top(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, exclude_self: bool, upper: np.ndarray | None = None):
    """(query index, rank, point id, distance) of the k nearest, ties by smaller id; those beyond `upper` may be left out."""
    order = np.argsort(p_ids, kind="stable")
    p, p_ids = np.ascontiguousarray(p[order]), p_ids[order]
    want = k + (1 if exclude_self else 0)
    # of equal points only the first by id can be among the nearest
    same = np.unique(p.view(f"V{p.shape[1] * 8}").ravel(), return_inverse=True)[1] if p.shape[1] else np.zeros(len(p), int)
    by = np.argsort(same, kind="stable")
    place = np.arange(len(p)) - np.searchsorted(same[by], same[by])
    keep = np.sort(by[place < want])
    p, p_ids = p[keep], p_ids[keep]
    want = min(want, len(p))
    most = np.einsum("ij,ij->i", p, p).max(initial=0.0)
    parts, step = [], max(16, min(512, _ROUGH // max(len(p), 1)))
    columns = np.hstack([p, 0.5 * np.einsum("ij,ij->i", p, p)[:, None]]).T
    for lo in range(0, len(q), step):
        block, ids = q[lo:lo + step], q_ids[lo:lo + step]
        # p p / 2 - q p in one product: half the squared distance less half the square of q
        own = np.einsum("ij,ij->i", block, block)
        half = np.hstack([-block, np.ones((len(block), 1))]) @ columns
        edge = np.full(len(block), np.inf) if upper is None else upper[lo:lo + step] ** 2
        new = np.flatnonzero(~np.isfinite(edge))
        if len(new):
            edge[new] = 2.0 * np.partition(half[new], want - 1, axis=1)[:, want - 1] + own[new] if want else 0.0
        slack = 1e-9 * (1.0 + np.abs(edge) + most)
        qi, pi = np.divmod(np.flatnonzero(half <= ((edge + slack - own) / 2.0)[:, None]), max(len(p), 1))
        exact = np.sqrt(((block[qi] - p[pi]) ** 2).sum(axis=1))
        if exclude_self:
            keep = ids[qi] != p_ids[pi]
            qi, pi, exact = qi[keep], pi[keep], exact[keep]
        by = np.lexsort((pi, exact, qi))
        qi, pi, exact = qi[by], pi[by], exact[by]
        first = np.searchsorted(qi, np.arange(len(block)))
        rank = np.arange(len(qi)) - first[qi]
        keep = rank < k
        parts.append((qi[keep] + lo, rank[keep] + 1, p_ids[pi[keep]], exact[keep]))
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 4


def _usable(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("vec").cast("array<double>").alias("vec")).where(
        F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v)))


def neighbours(queries: DataFrame, points: DataFrame, k: int = 5, *, exclude_self: bool = False,
               bound: int = BROADCAST_VALUES, tile: int = _TILE, pivots: int = _PIVOTS) -> DataFrame:
    """The k nearest reference points of every query.

    Both sides have columns `id` and `vec ARRAY<DOUBLE>`. Returns
    `id, rank, neighbour, distance`.
    """
    spark = queries.sparkSession
    kind = lambda df: df.schema["id"].dataType.simpleString()
    schema = f"id {kind(queries)}, rank int, neighbour {kind(points)}, distance double"
    queries, points = _usable(queries), _usable(points)
    first = points.select(F.size("vec").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    most = max(1, bound // max(first["d"], 1))
    local = points.limit(most + 1).toPandas()
    if len(local) <= most:
        shared = spark.sparkContext.broadcast((_matrix(local["vec"]), local["id"].to_numpy()))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p, p_ids = shared.value
            for pdf in batches:
                if len(pdf):
                    ids = pdf["id"].to_numpy()
                    qi, rank, nid, d = _top(_matrix(pdf["vec"]), ids, p, p_ids, k, exclude_self)
                    yield pd.DataFrame({"id": ids[qi.astype(int)], "rank": rank.astype("int32"),
                                        "neighbour": nid, "distance": d})

        return queries.mapInPandas(near, schema)
    return _neighbours_partitioned(queries, points, k, exclude_self, tile, pivots, schema)


def _packs(pivots: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The pack of each cell: neighbouring cells of about `most` points together."""
    out, count = np.zeros(len(pivots), np.int32), 0
    left = [(np.arange(len(pivots)), max(1, math.ceil(sizes.sum() / most)))]
    while left:
        at, parts = left.pop()
        if parts == 1 or len(at) == 1:
            out[at], count = count, count + 1
            continue
        away = pivots[at] - pivots[at].mean(axis=0)
        by = at[np.argsort(away @ np.linalg.svd(away, full_matrices=False)[2][0], kind="stable")]
        grown = np.cumsum(sizes[by])
        cut = int(np.clip(np.searchsorted(grown, grown[-1] * (parts // 2) / parts) + 1, 1, len(by) - 1))
        left += [(by[:cut], parts // 2), (by[cut:], parts - parts // 2)]
    return out


def _neighbours_partitioned(queries, points, k, exclude_self, tile, pivots, schema):
    spark = queries.sparkSession
    want = k + (1 if exclude_self else 0)
    n_points, n_queries = points.count(), queries.count()
    n_pivots = max(want, min(pivots, math.ceil(math.sqrt(n_points))))
    chosen = points.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n_pivots).toPandas()
    anchor = spark.sparkContext.broadcast(_matrix(chosen["vec"]))
    most = max(1, _SEND // anchor.value.shape[1])
    p_most, q_most = (min(most, max(tile, math.ceil(n / _CUTS))) for n in (n_points, n_queries))

    def to_pivots(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        for lo in range(0, len(x), 512):
            rough = np.sqrt(np.maximum(_squares(x[lo:lo + 512], anchor.value), 0.0))
            yield slice(lo, lo + 512), rough

    @F.pandas_udf("struct<cell int, gap double>")
    def assign(vec: pd.Series) -> pd.DataFrame:
        x = _matrix(vec)
        cell = np.concatenate([d.argmin(axis=1) for _, d in to_pivots(x)]) if len(x) else np.zeros(0, int)
        gap = np.sqrt(((x - anchor.value[cell]) ** 2).sum(axis=1))
        return pd.DataFrame({"cell": cell.astype("int32"), "gap": gap})

    placed = materialise(points.select("id", "vec", assign("vec").alias("a")).select("id", "vec", "a.cell", "a.gap"))
    radius, sizes = np.full(len(chosen), -np.inf), np.zeros(len(chosen), np.int64)
    for c in placed.groupBy("cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("m")).collect():     # at most `pivots` rows
        radius[c["cell"]], sizes[c["cell"]] = c["radius"], c["m"]
    pack = _packs(anchor.value, sizes, p_most)
    reach = spark.sparkContext.broadcast((radius, pack))
    # a cell may hold more than a tile
    pieces = np.maximum(1, np.ceil(np.bincount(pack, sizes) / (1.5 * p_most)).astype(int))
    of_cell = spark.createDataFrame([(c, int(p), int(pieces[p])) for c, p in enumerate(pack)], "cell int, pack int, pieces int")

    def search(asked: DataFrame) -> DataFrame:
        """The best of each (query, pack) of `asked` (id, vec, best, pack), in tiles of both sides."""
        salts = asked.groupBy("pack").agg(F.ceil(F.count(F.lit(1)) / q_most).cast("int").alias("salts"))
        plan = of_cell.join(F.broadcast(salts), "pack")                          # at most `pivots` rows
        q_side = (asked.join(F.broadcast(plan.drop("cell").distinct()), "pack").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
                  .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("pack", "piece", "salt", "id", "vec", "best"))
        p_side = (placed.join(F.broadcast(plan), "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
                  .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
                  .select(F.col("pack").alias("p_pack"), F.col("piece").alias("p_piece"), F.col("salt").alias("p_salt"),
                          F.col("id").alias("p_id"), F.col("vec").alias("p_vec")))
        kinds = [to_arrow_type(q_side.schema["id"].dataType), pa.int32(), to_arrow_type(p_side.schema["p_id"].dataType), pa.float64()]

        def tile_top(q: pa.Table, p: pa.Table) -> pa.Table:
            cols = [[]] * 4
            if q.num_rows and p.num_rows:
                ids, p_ids = q.column("id").to_pandas().to_numpy(), p.column("p_id").to_pandas().to_numpy()
                qi, rank, nid, d = _top(_rows(q.column("vec")), ids, _rows(p.column("p_vec")), p_ids, k, exclude_self,
                                        q.column("best").to_pandas().to_numpy(dtype=float, na_value=np.inf))
                cols = [ids[qi.astype(int)], rank.astype("int32"), nid, d]
            return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "rank", "neighbour", "distance"])

        left, right = q_side.groupBy("pack", "piece", "salt"), p_side.groupBy("p_pack", "p_piece", "p_salt")
        return left.cogroup(right).applyInArrow(tile_top, schema)

    @F.pandas_udf("int")
    def home(vec: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([reach.value[1][d.argmin(axis=1)] for _, d in to_pivots(_matrix(vec))]) if len(vec) else np.zeros(0), dtype="int32")

    own = queries.select("id", "vec", F.lit(None).cast("double").alias("best"), home("vec").alias("pack"))
    near = materialise(search(own))
    kth = near.groupBy("id").agg(F.array_sort(F.collect_list("distance")).alias("d"))     # k distances per tile of one pack
    kth = kth.select(F.col("id").alias("_id"), F.when(F.size("d") >= k, F.get("d", F.lit(k - 1))).alias("_kth"))

    @F.pandas_udf("struct<best double, packs array<int>>")
    def visits(vec: pd.Series, own: pd.Series, best: pd.Series) -> pd.DataFrame:
        known, mine, (far, of) = best.to_numpy(dtype=float, na_value=np.inf), own.to_numpy(), reach.value
        known = np.where(np.isnan(known), np.inf, known)
        bound, out, member = [], [], (of[:, None] == np.arange(of.max() + 1)).astype(np.float32)
        for at, d in to_pivots(_matrix(vec)):
            # the pivots are points themselves: their want-th distance bounds the answer too
            upper = np.minimum(known[at], np.partition(d, want - 1, axis=1)[:, want - 1]) * (1 + 1e-6) + 1e-6
            needed = (d - far[None, :] <= upper[:, None]).astype(np.float32) @ member > 0
            needed[np.arange(len(d)), mine[at]] = False
            bound.append(upper)
            out += [np.nonzero(row)[0].astype("int32") for row in needed]
        return pd.DataFrame({"best": np.concatenate(bound) if bound else np.zeros(0), "packs": pd.Series(out, dtype=object)})

    more = own.drop("best").join(kth, F.col("id") == F.col("_id"), "left").select("id", "vec", visits("vec", "pack", "_kth").alias("v"))
    rest = search(more.select("id", "vec", "v.best", F.explode("v.packs").alias("pack")))
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return (near.unionByName(rest).drop("rank").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("id", "rank", "neighbour", "distance"))


def neighbour_summary(near: DataFrame) -> DataFrame:
    """Mean and k-th neighbour distance per query."""
    return near.groupBy("id").agg(F.avg("distance").alias("d_mean"), F.max("distance").alias("d_kth"))


def four_state(df: DataFrame, eps_failure: float, eps_nominal: float, eps_ood: float, *,
               failure: str = "d_failure", nominal: str = "d_nominal", ood: str = "d_ood") -> DataFrame:
    """Priority: outside known territory, approaching failure, nominal, watch."""
    state = (F.when(F.col(ood) > eps_ood, "TERRA_INCOGNITA").when(F.col(failure) < eps_failure, "FAILURE_APPROACH")
             .when(F.col(nominal) < eps_nominal, "NOMINAL").otherwise("WATCH"))
    return df.withColumn("state", state)
