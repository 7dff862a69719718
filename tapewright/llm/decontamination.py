"""Benchmark decontamination: MinHash containment search, partitioned by size, and exact shingle containment after it.

A test item is far shorter than a document, so whole documents' signatures say little about it. Items are parted into
size classes (their shingles rounded up to a power of two, S), and for each class a document is seen as windows of 2 S
shingles, one beginning at every S-th: an item's copy lies within one of them, and the two sets' sizes are near enough
for MinHash. A window and an item that agree in one of K least hashes are a candidate; its share of the item's shingles
found anywhere in the document is then counted exactly, and is a leak from 0.8 on. With sizes so near, similarity is
0.19 at least for a leak, so K = 48 misses 4 in 100,000 of the hardest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import SHINGLE_WORDS, flat, mix, shingles, word_hashes, written

HASHES = 48
THRESHOLD = 0.8
SMALLEST = 8
#: Characters of items in one block: the search index of a block is broadcast, and is at most about 30 times that in bytes.
BLOCK_CHARS = 1 << 20
#: Blocks that are broadcast at a time.
GROUP_BLOCKS = 4
_MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TABLE_BITS = 18


class Index:
    """The items of one block. Items below SHINGLE_WORDS words are matched as one run of all their words."""

    def __init__(self, ids: list[int | None], hashes: list[np.ndarray]):
        self.ids, self.short, self.classes, self.sets = ids, {}, {}, []
        for i, h in enumerate(hashes):
            grams = np.unique(shingles(h)) if len(h) else h
            self.sets.append(grams)
            if 0 < len(h) < SHINGLE_WORDS:
                self.short.setdefault(len(h), []).append(i)
            elif len(h):
                size = max(SMALLEST, 1 << (len(grams) - 1).bit_length())
                self.classes.setdefault(size, []).append(i)
        self.tables = {}
        for size, members in self.classes.items():
            least = np.stack([(self.sets[i][None, :] * _MULTIPLIERS[:, None]).min(axis=1) for i in members])
            each = []
            for k in range(HASHES):
                order = np.argsort(least[:, k], kind="stable")
                bits = np.zeros(1 << _TABLE_BITS, bool)
                bits[mix(least[:, k]) >> np.uint64(64 - _TABLE_BITS)] = True
                each.append((least[order, k], np.array(members)[order], bits))
            self.tables[size] = each

    def candidates(self, grams: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of those that share a least hash. grams: the texts' shingles, end to end; starts: their first places, and the end."""
        found: set[tuple[int, int]] = set()
        lengths = np.diff(starts)
        for size, each in self.tables.items():
            blocks = -(-lengths // size)
            first = np.cumsum(blocks) - blocks
            if not blocks.sum():
                continue
            owner = np.repeat(np.arange(len(lengths)), blocks)
            at = np.repeat(starts[:-1], blocks) + (np.arange(len(owner)) - first[owner]) * size
            last = np.append(owner[1:] != owner[:-1], True)
            for k, (values, items, bits) in enumerate(each):
                low = np.minimum.reduceat(grams * _MULTIPLIERS[k], at)
                pair = np.minimum(low, np.append(low[1:], low[-1]))
                pair[last] = low[last]
                hit = np.flatnonzero(bits[mix(pair) >> np.uint64(64 - _TABLE_BITS)])
                if len(hit):
                    a, b = np.searchsorted(values, pair[hit], "left"), np.searchsorted(values, pair[hit], "right")
                    for block, x, y in zip(hit[b > a], a[b > a], b[b > a], strict=True):
                        found.update((int(owner[block]), int(i)) for i in items[x:y])
        return found

    def leaks(self, hashes: np.ndarray, offsets: np.ndarray, threshold: float) -> list[list[tuple]]:
        """For each text: (item_id, item_shingles, shared) of the leaks."""
        out: list[list[tuple]] = [[] for _ in offsets[1:]]
        each = [shingles(hashes[a:b]) if b - a >= SHINGLE_WORDS else hashes[:0] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
        sets: dict = {}
        if self.tables and starts[-1]:
            for text, item in sorted(self.candidates(np.concatenate(each), starts)):
                own = sets.setdefault(text, None)
                if own is None:
                    own = sets[text] = np.unique(each[text])
                q = self.sets[item]
                at = np.minimum(np.searchsorted(own, q), len(own) - 1)
                shared = int((own[at] == q).sum())
                if shared >= threshold * len(q):
                    out[text].append((self.ids[item], len(q), shared))
        for words, items in self.short.items():
            for text, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                if b - a >= words:
                    own = set(shingles(hashes[a:b], words).tolist())
                    out[text] += [(self.ids[i], 1, 1) for i in items if int(self.sets[i][0]) in own]
        return out


def index_groups(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, group: int = GROUP_BLOCKS) -> Iterator[list]:
    """Broadcast indexes of all items (item_id, text), in blocks of about block_chars characters, `group` of them at a time. Items without words are in none.

    The next group is made when it is asked for, so the driver and the executors hold one group at a time, whatever the
    benchmark's size, if the caller has used the last one up.
    """
    spark = benchmark.sparkSession
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for at in range(0, n, group):
        blocks = []
        for i in range(at, min(n, at + group)):
            own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).select("item_id", word_hashes(F.col("text")).alias("h")).distinct().collect()
            blocks.append(spark.sparkContext.broadcast(Index([r.item_id for r in own], [np.array(r.h, np.int64).view(np.uint64) for r in own])))
        yield blocks


def leaks(text: Column, blocks: list, threshold: float = THRESHOLD) -> Column:
    """array of struct(item_id, item_shingles, shared): the items of which a text holds at least that share of the shingles.

    Null texts, and texts without words, hold none. blocks is a group of index_groups; leak_rows and without_leaks go through all.
    """

    @F.arrow_udf("array<struct<item_id:bigint,item_shingles:int,shared:int>>")
    def found(lists: pa.Array) -> pa.Array:
        values, offsets = flat(lists)
        out: list[list[tuple]] = [[] for _ in range(len(lists))]
        step = 256
        for at in range(0, len(lists), step):
            part = offsets[at : at + step + 1]
            for b in blocks:
                for own, more in zip(out[at : at + step], b.value.leaks(values, part, threshold), strict=True):
                    own += more
        flat_rows = [x for own in out for x in own]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
        cols = [pa.array([x[i] for x in flat_rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(cols, ["item_id", "item_shingles", "shared"]))

    return found(word_hashes(text))


def leak_rows(docs: DataFrame, benchmark: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, item_id, item_shingles, shared: a row for each row of docs and each item that its text holds.

    A benchmark of more than one group of blocks takes a pass over docs for each, written before the next one begins.
    An empty benchmark, an empty table and null texts give no row; repeated rows each give theirs; other columns of docs
    are left out.
    """
    out = None
    groups = index_groups(benchmark, **sizes)
    blocks = next(groups, None)
    while blocks:
        found = docs.select("doc_id", F.explode(leaks(F.col("text"), blocks)).alias("x")).select("doc_id", "x.*")
        following = None
        if len(blocks) == sizes.get("group", GROUP_BLOCKS):  # there may be more
            found = written(found)
            for b in blocks:
                b.unpersist()
            following = next(groups, None)
        out = found if out is None else out.unionByName(found)
        blocks = following
    none = docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("item_shingles"), F.lit(0).alias("shared")).limit(0)
    return none if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **sizes: int) -> DataFrame:
    """The rows of docs whose text holds no item of the benchmark. Null texts stay."""
    groups = index_groups(benchmark, **sizes)
    blocks = next(groups, None)
    while blocks:
        docs = docs.where(F.size(leaks(F.col("text"), blocks)) == 0)
        if len(blocks) < sizes.get("group", GROUP_BLOCKS):
            break
        docs = written(docs)
        for b in blocks:
            b.unpersist()
        blocks = next(groups, None)
    return docs
