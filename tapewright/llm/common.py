"""Helpers that the corpus operators share: written intermediate tables, word hashes, shingle hashes."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in shingles: anything but letters and digits.
WORD_GAP = r"[^\p{L}\p{N}]+"
SHINGLE_WORDS = 5
#: A table of so many bytes may be broadcast; beyond it, keys of more rows than HOT_ROWS are spread, and at most HOT_KEYS of them.
BROADCAST_BYTES = 32 << 20
HOT_ROWS, HOT_KEYS = 10_000, 100_000
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
FILE_ROWS = 100_000
#: Powers of 2 of the bits of a filter of hashes that is broadcast (32 MB at most), and bits for each hash below that. What a fuller filter lets through besides, a join drops.
FILTER_LEAST, FILTER_MOST, FILTER_SPREAD = 20, 28, 16


#: The folders of `written` of this driver, for callers that know when they can go.
written_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a new local one in local mode (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return found.rstrip("/")


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders by the file system that they are in."""
    jvm = spark.sparkContext._jvm
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES, so that a Python worker holds few texts at a time, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder and read back: lineage ends here and work isn't repeated.

    rows: about how many it has, if they are short. They then go to a file for each FILE_ROWS of them, or for each core if
    those are more, instead of one for each partition: on a local disk Hadoop starts processes for each file.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written/{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // FILE_ROWS))
    df.write.option("compression", "zstd").parquet(path)
    written_paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def join_spread(rows: DataFrame, facts: DataFrame, key: str, count: str, size: Column, spread: str) -> DataFrame:
    """rows left joined with facts, which has a row a key; its column `count`, the number of rows with the key, is left out.

    facts is broadcast if its measured size (the sum of `size`, in bytes) is at most BROADCAST_BYTES. Else a key of more
    rows than a limit is dealt out to several partitions by a hash of the column `spread`, and its fact is repeated there.
    The limit grows with the rows, so that those keys are HOT_KEYS at most, whatever the table.
    """
    measured = facts.agg(F.sum(size).alias("size"), F.sum(count).alias("rows")).first()
    if (measured.size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts.drop(count)), key, "left")
    limit = max(HOT_ROWS, measured.rows // HOT_KEYS)
    parts = F.greatest(F.ceil(F.col(count) / limit), F.lit(1)).cast("int")
    hot = facts.where(F.col(count) > limit).select(key, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    repeated = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(count)
    return dealt.join(repeated, [key, "_part"], "left").drop("_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_row(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 4, isn't 2. A null id is never learned from."""
    return ~held_out(doc_id) & F.col(doc_id).isNotNull() if isinstance(doc_id, str) else ~held_out(doc_id) & doc_id.isNotNull()


def held_out(doc_id: str | Column = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words of a text in order; null and wordless texts give an empty array."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an Arrow array of lists of 64-bit integers, end to end, and the offsets of the lists in it (a null is empty)."""
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return np.asarray(lists.flatten()).view(np.uint64), offsets


def shingles(hashes: np.ndarray, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of each run of so many words; a shorter non-empty text is one shingle of all its words."""
    n = len(hashes)
    if n == 0:
        return hashes
    words = min(words, n)
    out = np.full(n - words + 1, words, np.uint64)
    for i in range(words):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - words + 1 + i]
    return mix(out)


def sample_threshold(count: int, cap: int) -> int:
    """Of 2**20 hash values, how many take about cap of count rows."""
    return 1 << 20 if count <= cap else max(1, (cap << 20) // count)


def in_sample(threshold: int | Column, *cols: str) -> Column:
    """A fixed pseudo-random choice of rows by their content."""
    return F.xxhash64(*cols).bitwiseAND((1 << 20) - 1) < threshold


def filter_bit(digest: bytes, size: int) -> int:
    """Place of a hash in a filter of 2**size bits."""
    return int.from_bytes(digest[:4], "big") >> (32 - size)


def hash_filter(df: DataFrame, column: str) -> tuple[Broadcast, int]:
    """A broadcast bit table of a binary column of hashes, and its size as a power of 2: FILTER_SPREAD bits for each hash, at most 2**FILTER_MOST."""
    n = df.count()
    size = min(FILTER_MOST, max(FILTER_LEAST, (FILTER_SPREAD * max(n, 1)).bit_length()))
    bit = F.shiftright(F.conv(F.hex(F.substring(column, 1, 4)), 16, 10).cast("long"), 32 - size)
    words = df.select(F.shiftright(bit, 6).cast("int").alias("w"), bit.bitwiseAND(63).cast("int").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toArrow()
    table = np.zeros(1 << (size - 6), np.uint64)
    table[np.asarray(rows.column("w"))] = np.asarray(rows.column("v")).view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(table.tobytes()), size


def passes(hashes: Column, bits: tuple[Broadcast, int]) -> Column:
    """Whether a filter has each of the hashes; false for null."""
    sent, size = bits

    @F.arrow_udf("boolean")
    def inside(digests: pa.Array) -> pa.Array:
        table = sent.value
        return pa.array([d is not None and bool(table[(i := filter_bit(d, size)) >> 3] >> (i & 7) & 1) for d in digests.to_pylist()], pa.bool_())

    return inside(hashes)
