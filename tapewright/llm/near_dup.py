"""Near-duplicate classes by DartMinHash: weighted MinHash signatures from thrown darts, joined by bands.

A text is the multiset of its five-word shingles; a shingle's weight is how often it stands in the text. Each shingle
owns a region, its weight wide and unbounded in rank. Darts whose number and places are hashes of the shingle and of
the cell of the region are thrown into it; a dart has a coordinate and a rank, and of each coordinate the dart of least
rank is kept. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity, and only about
k log k darts are thrown, however long the text is.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import flat, hash_filter, join_spread, mix, passes, shingles, word_hashes, written

#: 20 bands of 4 coordinates: texts of similarity 0.8 share a band but for 3 in 100,000.
BANDS, ROWS = 20, 4
THRESHOLD = 0.8
#: Signatures of texts of similarity 0.8 agree in less than so much for 4 in a million.
ESTIMATE = 0.6
#: About so many members of a bucket are compared with so many others in one task.
PART = 512
_ID, _KEY = "__kept_id", "__kept_key"
_BASE = 2.0**-6  # the lowest cell's height; the next ones double up to 1, then each is 1 high
_SEED = np.uint64(0xD1B54A32D192ED03)


def _cells(height: float) -> tuple[np.ndarray, np.ndarray]:
    """Bottoms and heights of the cells of a stripe one wide, up to so great a rank."""
    edges = [0.0, _BASE]
    while edges[-1] < height:
        edges.append(edges[-1] * 2 if edges[-1] < 1 else edges[-1] + 1)
    e = np.array(edges)
    return e[:-1], np.diff(e)


def _poisson(area: np.ndarray, most: int = 14) -> np.ndarray:
    """Rows of the cumulative Poisson probabilities for each area."""
    out = np.empty((len(area), most))
    p = np.exp(-area)
    total = p.copy()
    for i in range(most):
        out[:, i] = total
        p = p * area / (i + 1)
        total = total + p
    return out


@lru_cache(64)
def _grid(height: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the cells up to a height: bottoms, heights, seeds of their hashes, and cumulative probabilities of their numbers of darts. Heights are powers of 2, so there are few grids."""
    bottoms, heights = _cells(height)
    return bottoms, heights, mix(np.arange(1, len(bottoms) + 1, dtype=np.uint64) * _SEED), _poisson(heights)


def weighted_elements(grams: np.ndarray) -> np.ndarray:
    """A multiset as a set: its first, second, ... copies of a shingle are elements (stripes of the shingle's region) of their own."""
    values, counts = np.unique(grams, return_counts=True)
    if len(values) == len(grams):
        return values
    copies = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(values, counts) + copies.astype(np.uint64) * _SEED)


def signature(elements: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The ids of the k earliest darts of a non-empty set of elements."""
    ids = np.zeros(k, np.uint64)
    found = np.zeros(k, bool)
    height = 2.0 ** math.ceil(math.log2(k * (math.log(k) + 2) / len(elements)))
    while True:
        bottoms, heights, seeds, chance = _grid(height)
        # cells one by one in blocks, so that memory stays in proportion to the text
        ranks_all, coords_all, ids_all = [], [], []
        block = max(1, 200_000 // len(elements))
        for at in range(0, len(bottoms), block):
            h = mix(elements[None, :] ^ seeds[at : at + block, None])
            u = (h >> np.uint64(11)) * 2.0**-53
            cell, element = np.nonzero(u > chance[at : at + block, :1])
            n, more, value = np.ones(len(cell), np.int64), np.arange(len(cell)), u[cell, element]
            for i in range(1, chance.shape[1]):  # of the cells with i darts, those with one more
                more = more[value[more] > chance[at + cell[more], i]]
                if not len(more):
                    break
                n[more] += 1
            cell, start = np.repeat(cell, n), np.repeat(h[cell, element], n)
            turn = np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(start + (turn.astype(np.uint64) + np.uint64(1)) * _SEED)
            place = mix(dart ^ _SEED)
            rank = bottoms[at + cell] + heights[at + cell] * ((place >> np.uint64(11)) * 2.0**-53)
            keep = rank < height
            ranks_all.append(rank[keep])
            coords_all.append((dart[keep] % np.uint64(k)).astype(np.int64))
            ids_all.append(dart[keep])
        rank, coord, dart = map(np.concatenate, (ranks_all, coords_all, ids_all))
        order = np.argsort(-rank, kind="stable")
        ids[coord[order]] = dart[order]
        found[coord] = True
        if found.all():
            return ids
        height *= 2


def sketches(text: Column, n_bands: int = BANDS, rows: int = ROWS) -> Column:
    """struct(bands array<bigint>, short binary): a hash of each band of the text's signature, and 16 bits of each coordinate. No bands for a text without words."""

    @F.arrow_udf("struct<bands:array<bigint>,short:binary>")
    def sketched(lists: pa.Array) -> pa.Array:
        values, offsets = flat(lists)
        out, short = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if a == b:
                out.append(np.empty(0, np.int64))
                short.append(b"")
                continue
            ids = signature(weighted_elements(shingles(values[a:b])), n_bands * rows)
            short.append((ids >> np.uint64(48)).astype("<u2").tobytes())
            h = np.arange(1, n_bands + 1, dtype=np.uint64) * _SEED
            for column in ids.reshape(n_bands, rows).T:
                h = mix(h + column)
            out.append(h.view(np.int64))
        ends = np.concatenate(([0], np.cumsum([len(x) for x in out])))
        bands = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))
        return pa.StructArray.from_arrays([bands, pa.array(short, pa.binary())], ["bands", "short"])

    return sketched(word_hashes(text))


def elements(text: Column) -> Column:
    """Binary: the sorted elements of a text's shingle multiset, shortened to 32 bits each, to compare two texts exactly but for clashes of these hashes."""

    @F.arrow_udf("binary")
    def packed(lists: pa.Array) -> pa.Array:
        values, offsets = flat(lists)
        return pa.array([np.unique((weighted_elements(shingles(values[a:b])) >> np.uint64(32)).astype("<u4")).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())

    return packed(word_hashes(text))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct elements; 0 for an empty one."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if not len(short):
        return 0.0
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    both = int((long[at] == short).sum())
    return both / (len(x) + len(y) - both)


def similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of two struct(short, items); 0 where the shortened signatures agree in less than ESTIMATE of the coordinates."""

    @F.arrow_udf("double")
    def compared(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            agree = np.frombuffer(x["short"], "<u2") == np.frombuffer(y["short"], "<u2")
            out.append(jaccard(np.frombuffer(x["items"], "<u4"), np.frombuffer(y["items"], "<u4")) if agree.mean() >= ESTIMATE else 0.0)
        return pa.array(out, pa.float64())

    return compared(left, right)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for each node of the edges the least node that it is connected with.

    Alternates large-star and small-star steps (each edge moves to the least neighbour of its end) until nothing
    changes, so rounds grow with the logarithm of the longest chain. All work is joins and grouped minima; a hub's edges
    are spread (join_spread), as its component may hold a third of all nodes.
    """
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct())
    mark, n = None, edges.count()
    nearest = lambda df: written(df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), n)
    with_nearest = lambda df, near: join_spread(df, near, "u", "n", F.lit(64), "v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved = with_nearest(both, nearest(both)).withColumn("m", F.least("u", "m"))
        large = written(moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct(), n)
        small = with_nearest(large, nearest(large)).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where(F.col("u") != F.col("v")).distinct(), n)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark, n = now, now.n
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def links_within(rows: pd.DataFrame, threshold: float, n_bands: int) -> pd.DataFrame:
    """a, b of the links between the leading rows and the others of one part of a bucket.

    rows: lead, key, root, band, short, items. Pairs of one root, and those that an earlier band holds too, are left
    to it.
    """
    leading, others = rows[rows["lead"]], rows[~rows["lead"]]
    if leading.empty or others.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype=object)
    band = int(rows["band"].iloc[0])
    unpack = lambda part: np.frombuffer(b"".join(part["short"]), "<u2").reshape(len(part), n_bands, -1)
    lead_short, short = unpack(leading), unpack(others)
    keys, roots, sets = others["key"].tolist(), others["root"].to_numpy(object), [np.frombuffer(x, "<u4") for x in others["items"]]
    # all sets end to end, as places in the sorted distinct elements: one pass counts what a row shares with every one of them
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(values), bool)
    found = []
    for key, root, own, bits in zip(leading["key"], leading["root"], leading["items"], lead_short, strict=True):
        same = short == bits
        near = (same.mean(axis=(1, 2)) >= ESTIMATE) & (roots != root) & ~same[:, :band].all(axis=2).any(axis=1)
        if not near.any():
            continue
        own = np.frombuffer(own, "<u4")
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        at = at[values[at] == own]
        marked[at] = True
        both = np.add.reduceat(marked[places], starts, dtype=np.int64)
        marked[at] = False
        linked = np.flatnonzero(near & (both / (len(own) + sizes - both) >= threshold))
        # one link to each class is enough
        for i in {roots[i]: i for i in linked}.values():
            found.append((min(key, keys[i]), max(key, keys[i])))
    return pd.DataFrame(found, columns=["a", "b"], dtype=object)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n_bands: int = BANDS, rows: int = ROWS, part: int = PART) -> DataFrame:
    """key (binary, the text's md5), root (binary): the class of each distinct text of docs.text that has a class mate of another text.

    Equal texts are one node, so copies cost nothing beyond their own row. In each band bucket the least member is
    compared with all others, which gives links, and by their components classes. In a bucket whose members are not yet
    of one class, those outside its largest class are then compared with all members of other classes; so no link that
    would join two classes is lost, and a bucket of near copies costs little more than a comparison a member. A large
    bucket is cut into parts of about `part` outsiders by `part` members for that, so no task holds a whole bucket, and
    only links come out. Pairs whose shortened signatures agree in less than ESTIMATE of the coordinates aren't compared
    in full. A text without words has no near duplicate. An empty table gives no row.
    """
    keyed = docs.where(F.col("text").isNotNull()).select(F.unhex(F.md5("text")).alias("key"), "text")
    signed = written(keyed.select("key", sketches(F.col("text"), n_bands, rows).alias("s")).where(F.size("s.bands") > 0).groupBy("key").agg(F.first("s").alias("s")).select("key", "s.*"))
    members = signed.select("key", F.posexplode("bands").alias("band", "bucket"))
    # written, so that the join's sides are plain exchanges and a bucket's members can be split
    buckets = written(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("leader")).where("n > 1"))
    shared = written(members.join(buckets, "bucket"))
    none = keyed.select("key", F.col("key").alias("root")).limit(0)
    if shared.isEmpty():
        return none
    # written in between, so that no task needs the Python workers of both functions at once
    wanted = written(keyed.where(passes(F.col("key"), hash_filter(shared, "key"))))
    sets = written(wanted.select("key", elements(F.col("text")).alias("items")).groupBy("key").agg(F.first("items").alias("items")).join(signed.select("key", "short"), "key"))
    pairs = shared.where(F.col("key") != F.col("leader")).select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    sides = [sets.select(F.col("key").alias(side), F.struct("short", "items").alias(f"of_{side}")) for side in "ba"]
    joined = pairs.join(sides[0], "b").join(sides[1], "a")
    links = written(joined.select("a", "b", similarity(F.col("of_a"), F.col("of_b")).alias("similarity")).where(F.col("similarity") >= threshold).select("a", "b"))
    roots = written(components(links)) if not links.isEmpty() else none.withColumnRenamed("key", "node")
    # a bucket of two has been gone through
    at = shared.where("n > 2").select("bucket", "band", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    at = written(at)
    tops = written(at.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("top")).where(F.col("size") > F.col("top.n")))
    outside = F.col("root") != F.col("top.root")
    cut = lambda n: F.ceil(n / part).cast("int")
    turn = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), n).cast("int")
    rows_in, leads_in = cut(F.col("size")), cut(F.col("size") - F.col("top.n"))
    places = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda i, j, lead: F.struct(i.alias("i"), j.alias("j"), F.lit(lead).alias("lead"))
    as_member = F.transform(places(leads_in), lambda i: place(i, turn(rows_in, 1), False))
    as_leader = F.when(outside, F.transform(places(rows_in), lambda j: place(turn(leads_in, 2), j, True))).otherwise(F.array().cast("array<struct<i:int,j:int,lead:boolean>>"))
    parts = at.join(tops, "bucket").select("bucket", "band", "key", "root", F.explode(F.concat(as_member, as_leader)).alias("p")).select("bucket", "band", "key", "root", "p.*").join(sets, "key")
    more = parts.groupBy("bucket", "i", "j").applyInPandas(lambda rows: links_within(rows, threshold, n_bands), "a binary, b binary").distinct()
    more = written(more)
    if not more.isEmpty():
        roots = written(components(links.unionByName(more)))
    return roots.select(F.col("node").alias("key"), "root").unionByName(roots.select(F.col("root").alias("key"), "root").distinct())


def rooted(docs: DataFrame, **options) -> DataFrame:
    """doc_id, key, root for each row of docs: the text's md5, and its class's root; both null for a text without words."""
    worded = F.col("text").rlike(r"[\p{L}\p{N}]")
    own = docs.select("doc_id", F.when(worded, F.unhex(F.md5("text"))).alias("key"))
    roots = near_duplicates(docs, **options)
    # rows without a key stay out of the join
    found = own.where(F.col("key").isNotNull()).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    return found.select("doc_id", "key", "root").unionByName(own.where(F.col("key").isNull()).select("doc_id", "key", F.col("key").alias("root")))


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, class_docs, kept for each row of docs: documents of one class are near copies of each other, in chains.

    class_id is the least doc_id of the class. kept marks the documents that stay when one of each class stays: those
    with that id (so a repeated row stays with its twin). A row whose text is null or has no words is a class of its
    own, and so is kept; equal texts with words are one class. A null doc_id takes part; a class of such rows only has
    a null class_id and is kept. An empty table gives no row; other columns of docs are left out.
    """
    found = written(rooted(docs, **options))
    groups = written(found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_docs"), F.count("*").alias("n")))
    joined = join_spread(found, groups, "root", "n", F.lit(64), "doc_id")
    alone = F.col("root").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 1).otherwise(F.col("class_docs")).alias("class_docs"), (alone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs less all but one of each class: that with the least doc_id (nulls last), of several the least text hash; of rows that repeat it, one.

    Rows without words each stay.
    """
    rows = rooted(docs, **options).where(F.col("root").isNotNull()).groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "n")).alias("f")
    chosen = written(rows.groupBy("root").agg(first).select(F.col("f.doc_id").alias(_ID), F.col("f.key").alias(_KEY), F.col("f.n").alias("n")))
    names = docs.columns
    worded = F.col("text").rlike(r"[\p{L}\p{N}]")
    keyed = docs.withColumn("__near_key", F.when(worded, F.unhex(F.md5("text"))))
    same = lambda df: (df["__near_key"] == F.col(_KEY)) & df["doc_id"].eqNullSafe(F.col(_ID))
    kept = keyed.join(chosen, same(keyed), "left_semi")
    repeated = chosen.where(F.col("n") > 1)
    if not repeated.isEmpty():
        kept = kept.join(repeated, same(kept), "left_anti").unionByName(kept.join(repeated, same(kept), "left_semi").dropDuplicates(["doc_id", "__near_key"]))
    return kept.select(*names).unionByName(docs.where(~F.coalesce(worded, F.lit(False))))
