"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius through BK-trees.

Fingerprints are sharded so that any two within the radius share a shard: 64 bits are cut into `blocks` parts, and two values
that differ in at most `radius` bits agree on at least `blocks - radius` whole parts; each choice of that many parts is a
table, its bits are the shard's key. Every shard holds BK-trees (children keyed by their Hamming distance to the parent), and a query
follows only edges whose distance is within the radius of its own. A tree goes to the tasks of its shard; sending every tree
to every executor would grow with the data. Shards above `tree_rows` distinct fingerprints become several trees and
query blocks, one pair of blocks per unit, so no task holds a shard whole.

Defined cases: a null text has no words; no words give fingerprint zero, linked like any other; null ids sort before all
others and are returned as null; equal rows fall together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import (LOWER, MISSING_ID, NOT_SPACE, components, discard, find_words, flat, fresh, map_arrow, mix, needs, pieces, ragged, row_id,
                                  store, union_find)
from driftline.llm.members import FEW, matched

SHINGLE, RADIUS, BLOCKS, SEED = 4, 4, 6, 42


def _shingles(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of every text in order, and how many each text has."""
    from xxhash import xxh64_intdigest

    data = LOWER[data]
    starts, ends, first = find_words(data, at, NOT_SPACE)
    n_words = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    lengths = ends - starts
    joined = np.full(int(lengths.sum()) + len(starts), 32, np.uint8)            # words, each followed by one space
    ws = np.cumsum(lengths + 1) - (lengths + 1)
    joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(starts)), lengths)] = ragged(data, starts, lengths)
    we = ws + lengths
    count = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)      # shingles of each text
    begin = np.repeat(first[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(begin + shingle - 1, np.repeat(first[1:], count) - 1)
    buf = joined.tobytes()
    return np.array([xxh64_intdigest(buf[a:b], SEED) for a, b in zip(ws[begin].tolist(), we[last].tolist())], np.uint64), count


def _sets(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different shingle hashes, ascending, and how many there are."""
    doc = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(count))


def _fingerprints(hashes: np.ndarray, count: np.ndarray, bands: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of every text, and `bands` keys of two minimum shingle hashes each."""
    out, keys = np.zeros(len(count), np.uint64), np.zeros((len(count), bands), np.uint64)
    have = np.flatnonzero(count)
    if not len(have):
        return out, keys
    edge = np.cumsum(count) - count
    for lo in range(0, len(have), 256):                                         # bits of a few texts at a time
        some = have[lo:lo + 256]
        a, b = int(edge[some[0]]), int(edge[some[-1]] + count[some[-1]])
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for d in some.tolist():
            s = int(edge[d]) - a
            ones = bits[s:s + int(count[d])].sum(axis=0, dtype=np.int32)
            out[d] = np.packbits(ones * 2 > int(count[d]), bitorder="little").view(np.uint64)[0]
    for k in range(bands):
        low = [np.minimum.reduceat(mix(hashes + np.uint64((2 * k + m + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)), edge[have]) for m in (0, 1)]
        keys[have, k] = mix(low[0] * np.uint64(31) + low[1])
    return out, keys


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """Columns `keep` of docs and the fingerprint `fp` of every text."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                fp, _ = _fingerprints(*_shingles(*flat(part.column("text")), shingle))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fp.view(np.int64))], [*keep, "fp"])

    return map_arrow(docs.select(*keep, "text"), run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", fp long")


def _lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values.view(np.int64)))


def set_prints(docs: DataFrame, shingle: int, bands: int) -> DataFrame:
    """doc, txt of every text, `cls` (a hash that names its set of shingles), their number `n`, the fingerprint `fp` of the set, and `keys` (array of `bands` longs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                hashes, n = _sets(*_shingles(*flat(part.column("text")), shingle))
                fp, keys = _fingerprints(hashes, n, bands)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(0x9E3779B97F4A7C15)))])   # modulo 2^64
                edge = np.concatenate([[0], np.cumsum(n)])
                cls = mix((total[edge[1:]] - total[edge[:-1]]) ^ n.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("txt"), pa.array(cls.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(fp.view(np.int64)),
                                                  _lists(keys.ravel(), np.full(len(n), bands))], ["doc", "txt", "cls", "n", "fp", "keys"])

    return map_arrow(docs.select("doc", "txt", "text"), run, "doc long, txt long, cls long, n long, fp long, keys array<long>")


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """cls of docs and the sorted set of its text's shingle hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column("cls"), _lists(*_sets(*_shingles(*flat(part.column("text")), shingle)))], ["cls", "set"])

    return map_arrow(docs.select("cls", "text"), run, "cls long, set array<long>")


# ---------------------------------------------------------------- BK-trees (many at once)
def bk_build(values: np.ndarray, roots: np.ndarray, items: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trees over values[items]; tree[i] is the tree of items[i], roots[t] the item that is the root of tree t.

    Returned: sorted keys parent * 65 + distance, and the child of each. All trees grow a level at a time.
    """
    parent = roots[tree]
    rest = items != parent
    items, parent = items[rest], parent[rest]
    keys, children = [], []
    while len(items):
        key = parent * 65 + np.bitwise_count(values[items] ^ values[parent])
        order = np.argsort(key, kind="stable")
        items, key = items[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        child = items[new]
        keys.append(key[new])
        children.append(child)
        parent = child[np.cumsum(new) - 1][~new]
        items = items[~new]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, children = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(keys)
    return keys[order], children[order]


def bk_search(values: np.ndarray, keys: np.ndarray, children: np.ndarray, query: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query item, tree item) within the radius; query[i] starts at root[i]."""
    node = root
    while len(query):
        d = np.bitwise_count(values[query] ^ values[node]).astype(np.int64)
        near = d <= radius
        yield query[near], node[near]
        lo = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
        hi = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64) + 1)
        many = hi - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        query, node = np.repeat(query, many), children[at]


def _link_units(radius: int):
    """Rows (unit key, i, j, b, cls, fp) of whole units -> links (src, dst) that join each unit's components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        order = np.lexsort((col["cls"], col["j"], col["i"], col["key"], col["tab"]))
        tab, key, i, j, b, cls = (col[c][order] for c in ("tab", "key", "i", "j", "b", "cls"))
        values = col["fp"][order].view(np.uint64)
        new = np.ones(len(order), bool)
        new[1:] = (tab[1:] != tab[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        unit = np.cumsum(new) - 1
        in_tree, in_query = b == i, b == j
        items = np.flatnonzero(in_tree)
        some_tree = np.zeros(unit[-1] + 1, bool)
        some_tree[unit[items]] = True
        roots = np.zeros(unit[-1] + 1, np.int64)
        roots[unit[items][::-1]] = items[::-1]                                   # the first item of each unit
        keys, children = bk_build(values, roots, items, unit[items])
        queries = np.flatnonzero(in_query & some_tree[unit])
        step = max(1, 4_000_000 // int(np.bincount(unit).max()))
        label = np.arange(len(values))
        for lo in range(0, len(queries), step):
            q = queries[lo:lo + step]
            found = list(bk_search(values, keys, children, q, roots[unit[q]], radius))
            a, c = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            keep = a != c
            if keep.any():
                label = union_find(len(values), np.concatenate([np.arange(len(values)), a[keep]]), np.concatenate([label, c[keep]]))
        linked = np.flatnonzero(label != np.arange(len(values)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(cls[linked]), pa.array(cls[label[linked]])], ["src", "dst"])
    return run


def _sharded(classes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Rows (cls, fp, tab, key): every choice of `blocks - radius` parts of the 64 bits is a table, those bits the shard's key."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]
    signed = [m - 2 ** 64 if m >= 2 ** 63 else m for m in masks]
    tables = F.array(*[F.struct(F.lit(t).alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])
    return classes.select("cls", "fp", F.explode(tables).alias("t")).select("cls", "fp", "t.tab", "t.key")


def near_links(rows: DataFrame, n: int, radius: int = RADIUS, tree_rows: int = 16_384) -> DataFrame:
    """Links (src, dst) between the classes of `rows` (cls, fp, tab, key; about n rows; fp names cls) whose components are those of all
    pairs within the radius that share a shard (tab, key)."""
    spark = rows.sparkSession
    units = _units(rows, F.ceil(F.count(F.lit(1)) / tree_rows), "fp").select("tab", "key", "i", "j", "b", "cls", "fp")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 400_000))
    return map_arrow(units.repartition(parts, "tab", "key", "i", "j"), _link_units(radius), "src long, dst long")


def _units(rows: DataFrame, blocks: Column, by: str) -> DataFrame:
    """`rows` of shards (tab, key) with two rows or more, cut into `blocks` (an aggregate) blocks b by a hash of `by`; one copy for each pair (i, j) of blocks."""
    sizes = rows.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("_n"), blocks.cast("int").alias("nb")).where("_n > 1")
    shared = rows.join(sizes, ["tab", "key"])
    shared = shared.withColumn("b", F.when(F.col("nb") > 1, F.pmod(F.xxhash64(by), F.col("nb")).cast("int")).otherwise(0))
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(F.col("b"), o).alias("i"), F.greatest(F.col("b"), o).alias("j")))
    return shared.withColumn("p", F.explode(pair)).select("p.i", "p.j", *shared.columns)


# ---------------------------------------------------------------- exact similarity of candidates
def similar(a: int, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of a and b members with `both` in common have Jaccard 4/5 or more, in whole numbers."""
    return 9 * both >= 4 * (a + b)


def _verified(values: np.ndarray, sets: np.ndarray, edge: np.ndarray, b: np.ndarray, i: int, j: int, radius: int, bands: np.ndarray | None = None, tab: int = -1) -> np.ndarray:
    """The component of every item of one unit, by links of pairs (block i, block j) within the radius whose sets are similar.

    A pair already in one component is not compared again, so a group of m near copies takes about m comparisons of sets. With `bands` (the
    keys of every item) only pairs whose first band in common is `tab` are compared.
    """
    n, label = np.diff(edge), np.arange(len(values))
    tree = np.flatnonzero(b == i)
    for q in np.flatnonzero(b == j).tolist():
        rest = tree[tree < q] if i == j else tree
        d = np.bitwise_count(values[rest] ^ values[q])
        near = (d <= radius) & similar(n[q], n[rest], np.minimum(n[rest], n[q])) & (label[rest] != label[q])
        if bands is not None:
            near[near] = (bands[rest[near]] == bands[q]).argmax(axis=1) == tab
        rest = rest[near]
        rest = rest[np.argsort(d[near], kind="stable")]                          # nearest first
        own, some = sets[edge[q]:edge[q + 1]], 0
        while len(rest):
            take = np.unique(label[rest], return_index=True)[1] if not some else np.arange(min(some, len(rest)))
            take, some = take[:256], 64                                          # one of each component, then the others
            t = rest[take]
            at = ragged(np.arange(len(sets)), edge[t], n[t])
            place = np.minimum(np.searchsorted(own, sets[at]), len(own) - 1)
            both = np.add.reduceat(own[place] == sets[at], np.cumsum(n[t]) - n[t], dtype=np.int64)
            for x in t[similar(n[q], n[t], both)].tolist():
                low, high = sorted((label[q], label[x]))
                label[label == high] = low
            rest = np.delete(rest, take)
            rest = rest[label[rest] != label[q]]
    return label


def _verify_units(radius: int):
    """Rows (tab, key, i, j, b, cls, fp, set, bands) of whole units -> links (src, dst) that join each unit's components of similar sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        col = {c: table.column(c).to_numpy() for c in ("tab", "key", "i", "j", "b", "cls", "fp")}
        lists, bands = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (table.column(c).combine_chunks() for c in ("set", "bands")))
        offsets, flat_sets = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        order = np.lexsort((col["cls"], col["j"], col["i"], col["key"], col["tab"]))
        unit = np.stack([col[c][order] for c in ("tab", "key", "i", "j")])
        bounds = [0, *(np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1).tolist(), len(order)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            rows = order[lo:hi]
            n = offsets[rows + 1] - offsets[rows]
            edge = np.concatenate([[0], np.cumsum(n)])
            tab = int(unit[0, lo])
            keys = None if tab < 0 else np.array(bands.take(pa.array(rows)).to_pylist(), np.int64)
            label = _verified(col["fp"][rows].view(np.uint64), ragged(flat_sets, offsets[rows], n), edge, col["b"][rows], int(unit[2, lo]), int(unit[3, lo]), radius, keys, tab)
            linked = np.flatnonzero(label != np.arange(len(rows)))
            if len(linked):
                cls = col["cls"][rows]
                yield pa.RecordBatch.from_arrays([pa.array(cls[linked]), pa.array(cls[label[linked]])], ["src", "dst"])
    return run


def similar_links(named: DataFrame, classes: DataFrame, shards: DataFrame, n: int, shingle: int, radius: int, tree_rows: int, unit_rows: int, unit_hashes: int, few: int, copies: int = 2_000_000) -> DataFrame:
    """Links (src, dst) between classes whose components are those of all pairs with Jaccard 0.8 or more that are candidates: within the
    radius, and in one shard. Written, as are the tables it is made from, which are deleted.

    Candidates are first joined to components. One of up to `unit_rows` classes is a unit and each of its sets is sent once; a larger one is compared
    shard by shard, in blocks, each pair in the first shard it shares. Only texts of candidates leave their place (`members.matched`)."""
    spark = classes.sparkSession
    near = components(near_links(shards, n, radius, tree_rows))
    both = near.unionByName(near.select(F.col("component").alias("node"), "component")).distinct()
    sizes = both.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    live = store(both.join(sizes, "component").join(classes, F.col("node") == F.col("cls")).select("cls", "fp", "n", "component", "size", "doc", "txt"), "candidates")
    discard(near)
    none = F.lit(None).cast("array<long>").alias("bands")
    small = live.where(F.col("size") <= unit_rows).select(F.lit(-1).alias("tab"), F.col("component").alias("key"), "cls", "fp", "n", none)
    wide = shards.select("cls", "tab", "key").join(live.where(F.col("size") > unit_rows).select("cls", "fp", "n"), "cls")
    wide = wide.groupBy("cls", "fp", "n").agg(F.array_sort(F.collect_list(F.struct("tab", "key"))).alias("t"))           # as many as there are bands
    large = wide.select("cls", "fp", "n", F.transform("t", lambda x: x["key"]).alias("bands"), F.explode("t").alias("t")).select("t.tab", "t.key", "cls", "fp", "n", "bands")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / unit_rows), F.ceil(F.sum("n") / unit_hashes))
    units = store(_units(small.unionByName(large), blocks, "cls").select("tab", "key", "i", "j", "b", "cls", "fp", "n", "bands"), "units")
    texts = matched(named, live.select("doc", "txt", "cls"), ["doc", "txt"], "inner", few)
    sets = _shingle_sets(texts, shingle).dropDuplicates(["cls"])
    sent = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]               # shingles, with every copy
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sent // copies))
    rows = units.join(sets, "cls").select("tab", "key", "i", "j", "b", "cls", "fp", "set", "bands")
    links = store(map_arrow(rows.repartition(parts, "tab", "key", "i", "j"), _verify_units(radius), "src long, dst long"), "links")
    discard(live, units)
    return links


def _components(fp: DataFrame, shards: DataFrame, n: int, classes: DataFrame, radius: int, tree_rows: int) -> DataFrame:
    """(f, component) of every fingerprint in fp (doc, fp): component is the smallest doc reachable."""
    # a document id may carry several texts: their fingerprints share the id, and so the component
    shared = fp.groupBy("doc").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b")
    own = fp.join(shared.select("doc"), "doc").select("doc", "fp").distinct().join(classes, "fp").select(F.col("doc").alias("src"), F.col("cls").alias("dst"))
    comp = components(near_links(shards, n, radius, tree_rows).unionByName(own))
    return classes.join(comp, F.col("cls") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "cls").alias("component"))


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, tree_rows: int = 16_384) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every document; all fingerprints within the radius are linked."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("doc", F.coalesce("doc_id", F.lit(MISSING_ID)))
    fp = store(fingerprints(rows, ["doc_id", "doc"], shingle), "fingerprints")
    classes = store(fp.groupBy("fp").agg(F.min("doc").alias("cls")), "classes")
    tables = math.comb(blocks, blocks - radius)
    named = _components(fp, _sharded(classes, radius, blocks), classes.count() * tables, classes, radius, tree_rows)
    value = F.col("component")
    return fp.join(named, F.col("fp") == F.col("f")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(value != MISSING_ID, value).alias("component_id"))


def removed(docs: DataFrame, shingle: int = 5, radius: int = 24, bands: int = 12, tree_rows: int = 16_384, unit_rows: int = 2_048, unit_hashes: int = 4_000_000, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Two written tables (doc, txt), as in `row_id`: texts of which a smaller one of their group stays, and texts that stay but are those of several rows.

    Two texts are linked if their sets of shingles have Jaccard 0.8 or more, computed exactly; links are transitive. Only candidates are compared: fingerprints
    of the sets within `radius`, and a shard in common. So wide a radius leaves bits no use as shard keys; here a shard is a pair of minimum
    shingle hashes, and each text is in `bands` of them. Sets that have 0.8 of their shingles in common share none with
    probability (1 - 0.64) ** 12 = 5e-6. Texts that share an id are judged row by row; texts without words are one group. Sets and shingles go by 64-bit hashes.
    """
    doc, txt = row_id()
    named = docs.select(doc.alias("doc"), txt.alias("txt"), "text")
    fp = store(set_prints(named, shingle, bands), "fingerprints")
    keys = fp.groupBy("cls", "doc", "txt").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    named_keys = store(keys, "texts")
    first = F.min(F.struct("doc", "txt")).alias("first")
    classes = store(named_keys.groupBy("cls").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), first).select("cls", "fp", "n", "first.doc", "first.txt"), "classes")
    shards = fp.where("n > 0").select("cls", "fp", F.posexplode("keys").alias("tab", "key")).distinct()
    links = similar_links(named, classes, shards, fp.count() * bands, shingle, radius, tree_rows, unit_rows, unit_hashes, few)
    comp = components(links)
    joined = classes.join(comp, F.col("cls") == F.col("node"), "left").select(F.coalesce("component", "cls").alias("c"), "doc", "txt")
    # of each group the first text stays; texts are marked by their own key, as one class may hold most of them
    stay = joined.groupBy("c").agg(first).select(F.col("first.doc").alias("d"), F.col("first.txt").alias("t"))
    marked = named_keys.join(stay, (F.col("doc") == F.col("d")) & (F.col("txt") == F.col("t")), "left").withColumn("kept", F.col("d").isNotNull())
    gone = store(marked.where("NOT kept").select("doc", "txt"), "removed")
    repeated = store(marked.where("kept AND rows > 1").select("doc", "txt"), "repeated")
    discard(comp, links, classes, named_keys, fp)
    return gone, repeated


def distinct_texts(docs: DataFrame, few: int = FEW, **settings) -> DataFrame:
    """The rows of `docs` whose text is the smallest of its near-duplicate group, by (doc_id, text hash).

    Of rows with equal id and text the one whose columns have the smallest hash stays. Only rows that may go, or are repeated, leave their place.
    """
    doc, txt = fresh(docs, "doc_key", "text_key")
    gone, repeated = removed(docs, few=few, **settings)
    named = lambda keys: keys.select(F.col("doc").alias(doc), F.col("txt").alias(txt))
    marked = docs.withColumns(dict(zip((doc, txt), row_id())))
    out = matched(marked, named(gone), [doc, txt], "left_anti", few).select(*docs.columns, doc, txt)
    if repeated.isEmpty():
        return needs(out.select(*docs.columns), gone, repeated)
    rest = matched(out, named(repeated), [doc, txt], "left_anti", few).select(*docs.columns)
    again = matched(out, named(repeated), [doc, txt], "left_semi", few)
    row, order = F.struct(*docs.columns), F.xxhash64(*[c for c, t in docs.dtypes if not t.startswith("map")])
    one = again.groupBy(doc, txt).agg(F.min_by(row, order).alias(doc + "_row")).select(f"{doc}_row.*")
    return needs(rest.unionByName(one), gone, repeated)
