"""Byte-level BPE encoding and decoding of whole texts by a file of token ranks.

Encoding runs in three steps. (1) One pass counts the corpus' distinct pieces (matches of the pattern). (2) The frequent
ones are encoded by Spark higher-order functions: a fold over the array of a piece's bytes merges, in each step, the
neighbouring pair of lowest rank, looked up in a literal rank map. (3) The texts are split by the pattern and each piece
becomes its ids: frequent pieces from the fold's, which are broadcast (at most HEAD_PIECES of them), the others by the
same merges in the task that meets them. So no text is shuffled. Decoding is a fold that concatenates the ids' binary
tokens, looked up in a literal array.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
import zlib
from collections.abc import Iterator
from collections import Counter
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from tapewright.llm.common import written

BUCKETS = 1 << 14
#: Bound of the broadcast pieces: their number and their length in characters.
HEAD_PIECES, HEAD_LENGTH = 1 << 17, 32
#: A task reports the blank-separated words that it met so often at least; the pieces of others can't be frequent ones.
TASK_LEAST = 4
_NONE = 2**31 - 1
_BYTES = [bytes([i]) for i in range(256)]
#: Encoded pieces that a Python worker remembers at most, besides the broadcast ones.
_REMEMBERED = 150_000
#: Rows that are encoded at once, so that a worker holds few texts and ids at a time.
SLICE_ROWS = 256
#: Tokens that the inner fold of decoding puts together: bytes are copied about twice, whatever a text's length.
DECODE_BLOCK = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: an array of small maps from a token in hexadecimal to its rank, placed by the token's crc32 so that a look-up reads one of them."""
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        buckets[zlib.crc32(token) % BUCKETS][token.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def fold_merges(piece: Column, ranks: Column) -> Column:
    """Ids of a piece, array<int>: the fold of ranked merges over the array of its bytes. Null for null, empty for the empty piece.

    Each step merges the neighbouring pair of lowest rank, the first of several; without such a pair nothing changes.
    """
    raw = F.encode(piece, "utf-8")
    one_by_one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1))), lambda i: F.substring(raw, i, F.lit(1)))

    def ids(table: Column) -> Column:
        look = lambda token: F.try_element_at(F.get(table, F.crc32(token).bitwiseAND(BUCKETS - 1).cast("int")), F.hex(token))

        def merged(parts: Column, low: Column) -> Column:
            joined = F.concat(F.get(parts, low["at"]), F.get(parts, low["at"] + 1))
            return F.concat(F.slice(parts, F.lit(1), low["at"]), F.array(joined), F.slice(parts, low["at"] + 3, F.size(parts)))

        def step(parts: Column, _: Column) -> Column:
            pair = lambda a, b: F.coalesce(look(F.concat(a, b)), F.lit(_NONE))
            found = F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts)), pair)
            low = _let(found, lambda r: F.struct(F.array_min(r).alias("rank"), (F.array_position(r, F.array_min(r)) - 1).cast("int").alias("at")))
            return F.when(F.size(parts) < 2, parts).otherwise(_let(low, lambda m: F.when(m["rank"] == _NONE, parts).otherwise(merged(parts, m))))

        parts = F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(raw), F.lit(2))), one_by_one, step)
        return _let(look(raw), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(parts, look)))

    # the literal stands in the expression once, so the plan holds it once
    return F.when(raw.isNull(), None).when(F.length(raw) == 0, F.array().cast("array<int>")).otherwise(_let(ranks, ids))


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, by the same merges, for pieces that the broadcast ones lack."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    get, n = ranks.get, len(piece)
    if n <= 200:
        parts = list(map(_BYTES.__getitem__, piece))
        pairs = list(map(get, map(add, parts, parts[1:]), repeat(_NONE)))
        while pairs and (low := min(pairs)) != _NONE:
            k = pairs.index(low)
            joined = parts[k] = parts[k] + parts.pop(k + 1)
            del pairs[k]
            if k < len(pairs):
                pairs[k] = get(joined + parts[k + 1], _NONE)
            if k:
                pairs[k - 1] = get(parts[k - 1] + joined, _NONE)
        return [ranks[p] for p in parts]
    parts = [piece[i : i + 1] for i in range(n)]
    # long pieces: a heap of pairs, so that time stays near the length
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j], after[i] = joined, None, after[j]
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and (right := after[left]) < n and (r := get(pair := parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (r, left, pair))
    return [ranks[p] for p in parts if p is not None]


class _Pieces(dict):
    """Ids of pieces as little-endian unsigned 32-bit integers; a piece that isn't there is merged, and remembered if short."""

    def __init__(self, ranks: dict[bytes, int], known: dict[str, bytes]):
        super().__init__(known)
        self.ranks, self.known = ranks, known

    def __missing__(self, piece: str) -> bytes:
        out = np.array(merge_bytes(piece.encode("utf-8", "replace"), self.ranks), "<u4").tobytes()
        if len(piece) <= HEAD_LENGTH:
            if len(self) >= len(self.known) + _REMEMBERED:
                self.clear()
                self.update(self.known)
            self[piece] = out
        return out


class _Counts(dict):
    """Numbers of tokens of pieces; a piece that isn't there is merged, and remembered if short.

    Where there are too many, those are forgotten that weren't asked for since the last time; so frequent pieces stay.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> int:
        if (n := self.older.get(piece)) is None:
            n = len(merge_bytes(piece.encode("utf-8", "replace"), self.ranks))
        if len(piece) <= HEAD_LENGTH:
            if len(self) >= _REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n


class Encoder:
    """Texts to ids inside a task, remembering a bounded number of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: dict[str, bytes] | None = None):
        self.split, self.pieces, self.counts = regex.compile(pattern).findall, _Pieces(ranks, known or {}), _Counts(ranks)

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b""


_encoders: dict = {}


def encoder(key: str, ranks_path: str, pattern: str, known=None) -> Encoder:
    """The worker's encoder of that key; known is a broadcast of pieces and ids."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(ranks_path), pattern, known.value if known else None)
    return _encoders[key]


def piece_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """piece, n: about how often each short piece stands in the column text. Whole corpus, counted in tasks first.

    The blank-separated words are counted and each distinct one is split, with a blank before it. That only chooses
    which pieces are frequent.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall

        def rows(words: Counter) -> pa.RecordBatch:
            pieces: Counter = Counter()
            for w, n in words.items():
                if n >= TASK_LEAST:
                    for p in split(" " + w):
                        if len(p) <= HEAD_LENGTH:
                            pieces[p] += n
            return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())], ["piece", "n"])

        c: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for t in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    if t:
                        c.update(t.split(" "))
                if len(c) > 200_000:
                    yield rows(c)
                    c.clear()
        yield rows(c)

    return texts.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_pieces(texts: DataFrame, pattern: str, most: int = HEAD_PIECES) -> DataFrame:
    """The most frequent pieces, at most `most` of them: all that are more frequent than the limit that a histogram of frequencies gives."""
    counts = written(piece_counts(texts, pattern))
    level = F.floor(F.log2("n") * 8).cast("int")
    kept, limit = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        if kept + r["count"] > most:
            break
        kept, limit = kept + r["count"], r.level
    return counts.where(level >= limit).select("piece") if limit is not None else counts.select("piece").limit(0)


def encode_head(pieces: DataFrame, ranks: dict[bytes, int]) -> dict[str, bytes]:
    """Ids of each piece, by the fold. The pieces are a bounded set (frequent_pieces); they come to the driver to be broadcast."""
    spread = pieces.repartition(max(8, pieces.sparkSession.sparkContext.defaultParallelism * 2))
    rows = spread.select("piece", fold_merges(F.col("piece"), rank_map(ranks)).alias("ids")).toArrow()
    ids = rows.column("ids").combine_chunks()
    ends = np.concatenate(([0], np.cumsum(np.asarray(ids.value_lengths())))).tolist()
    packed = np.asarray(ids.flatten()).astype("<u4").tobytes()
    return {p: packed[4 * a : 4 * b] for p, a, b in zip(rows.column("piece").to_pylist(), ends[:-1], ends[1:], strict=True)}


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None, head_pieces: int = HEAD_PIECES) -> DataFrame:
    """The columns `keep` of docs (all, if None) and the ids of docs.text, as `ids` (array<int>) and `packed` (binary).

    Each match of the pattern is encoded by itself, without special tokens; packed holds the ids as little-endian
    unsigned 32-bit integers. Null and empty texts, and an empty table, give no ids; every row stays, repeated rows too.
    Columns of docs named ids or packed are left out. docs is read once more, to count pieces.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(encode_head(frequent_pieces(docs, pattern, head_pieces), read_ranks(ranks_path)))
    key = uuid.uuid4().hex
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "packed")]
    own = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("_text"))
    schema = own.drop("_text").schema.add("ids", ArrayType(IntegerType())).add("packed", BinaryType())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(key, ranks_path, pattern, known)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                each = [own_encoder.text(t) for t in batch.column(len(names)).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in each]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(each), "<i4")))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, pa.array(each, pa.binary())], [*names, "ids", "packed"])

    return own.mapInArrow(rows, schema)


def token_array(ranks: dict[bytes, int]) -> Column:
    """The tokens by id, array<binary>, as a literal; null where no token has the id."""
    tokens: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = base64.b64encode(token).decode()
    return F.from_json(F.lit(json.dumps(tokens)), "array<binary>")


def decode(ids: Column, ranks_path: str) -> Column:
    """The ids' tokens, one after the other: binary. Null and no ids give no bytes; an id without a token is an error."""
    tokens = token_array(read_ranks(ranks_path))
    nothing = F.unhex(F.lit(""))
    token = lambda i: F.coalesce(F.get(tokens, i), F.raise_error(F.lit("an id without a token")).cast("binary"))
    block = lambda k: F.aggregate(F.slice(ids, k * DECODE_BLOCK + 1, F.lit(DECODE_BLOCK)), nothing, lambda done, i: F.concat(done, token(i)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(ids) / DECODE_BLOCK).cast("int")), block)
    return F.when(ids.isNull(), nothing).otherwise(F.aggregate(blocks, nothing, lambda done, b: F.concat(done, b)))
