"""Line dedup by content-defined chunks: repeated passages are removed wherever they stand.

A chunk ends between two lines if a hash of either of them says so: the line before by one part of its hash, the line
after by another. So the first and the last lines of a passage set its boundaries from inside, whatever stands around
it, and the chunks of a passage are the same in every document that holds it. Of each chunk that is found more than once
in the corpus the first copy (least doc_id, then place) stays. The others are compared with it byte by byte, and grow by
the line before and the line after where those are the same too: the outer lines of a passage may lie in chunks that
reach beyond it. What is then two lines or more goes; so does a single line of more than LONG_LINE words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import filter_bit, hash_filter, written

#: Of 10 lines, how many end a chunk, and how many begin one.
ENDS_OF_10 = 7
#: Lines with text that a removed passage has at least, and words that a single line must have more of.
MIN_LINES, LONG_LINE = 2, 50
_HIGH = 2**63 - 1
_KIND = {"at": "int", "end": "int", "low": "int", "high": "int", "enough": "boolean", "hash": "binary"}
_BYTES = ("chunk", "before", "after")


def chunk_ends(lines: list[bytes]) -> list[int]:
    """Ends of the chunks of some lines: after each line whose hash ends one or whose follower's hash begins one, and the last."""
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    return [i for i in range(1, len(lines)) if hashes[i - 1] % 10 < ENDS_OF_10 or (hashes[i] >> 32) % 10 < ENDS_OF_10] + [len(lines)]


def is_long(line: bytes) -> bool:
    return len(line) > 2 * LONG_LINE and len(line.split(None, LONG_LINE)) > LONG_LINE


def text_chunks(text: str | None) -> list[tuple[int, int, int, int, bool, list[bytes]]]:
    """(at, end, low, high, enough, lines of the text) of each chunk, in order: its lines are at to end, those with the neighbours low to high.

    Blank lines belong to no chunk but where they stand between lines of one. enough: the chunk alone may go. A long line
    within a chunk is a chunk of its own besides. None and empty texts have no chunk.
    """
    if not text:
        return []
    lines = text.encode("utf-8", "replace").split(b"\n")
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    if not full:
        return []
    out, first = [], 0

    def chunk(a: int, b: int, enough: bool) -> None:
        low, high = full[max(a - 1, 0)], full[min(b, len(full) - 1)] + 1
        out.append((full[a], full[b - 1] + 1, low, high, enough, lines))

    for last in chunk_ends([lines[i] for i in full]):
        one = last - first == 1
        chunk(first, last, not one or is_long(lines[full[first]]))
        if not one:
            for k in range(first, last):
                if is_long(lines[full[k]]):
                    chunk(k, k + 1, True)
        first = last
    return out


def _chunks(text: Column, with_bytes: bool, bits=None) -> Column:
    """array of struct of _KIND (and _BYTES: the chunk, and what its neighbours add before and after); with bits, only of chunks that the filter lets through."""
    kinds = _KIND | (dict.fromkeys(_BYTES, "binary") if with_bytes else {}) if bits is not None else {"hash": "binary"}
    types = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    sent, size = bits if bits is not None else (None, 0)

    @F.arrow_udf(f"array<struct<{','.join(f'{k}:{v}' for k, v in kinds.items())}>>")
    def found(texts: pa.Array) -> pa.Array:
        table = np.frombuffer(sent.value, np.uint8) if sent is not None else None
        rows: list[tuple] = []
        ends = [0]
        for t in texts.to_pylist():
            for a, b, low, high, enough, lines in text_chunks(t):
                chunk = lines[a] if b == a + 1 else b"\n".join(lines[a:b])
                digest = xxhash.xxh3_128_digest(chunk)
                if table is None:
                    rows.append((digest,))
                elif table[(i := filter_bit(digest, size)) >> 3] >> (i & 7) & 1:
                    more = (chunk, b"\n".join(lines[low:a]) if low < a else None, b"\n".join(lines[b:high]) if b < high else None) if with_bytes else ()
                    rows.append((a, b, low, high, enough, digest, *more))
            ends.append(len(rows))
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, types[k]) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds)))

    return found(text)


def _without(text: Column, at: Column, ends: Column) -> Column:
    @F.arrow_udf("string")
    def rest(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        out = []
        for t, a, b in zip(texts.to_pylist(), starts.to_pylist(), stops.to_pylist(), strict=True):
            if t is not None and a:
                gone = {i for x, y in zip(a, b, strict=True) for i in range(x, y)}
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
            out.append(t)
        return pa.array(out, pa.string())

    return rest(text, at, ends)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """k1, k2 (the row's id and its text's md5), at, end: the lines to remove of the rows of docs (doc_id, text).

    A chunk's copies within one text count too. Rows that repeat with the same id and text count as one. Null ids come
    last in the order of ids. Null texts and an empty table have no chunk.
    """
    full = docs.where(F.length("text") > 0)
    often = written(full.select(F.explode(_chunks(F.col("text"), False)).alias("c")).groupBy("c.hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    # what the filter lets through besides the repeated chunks stands once, and is dropped with the counts below
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_HIGH)).alias("k1"), F.unhex(F.md5("text")).alias("k2")]
    copies = written(full.select(*keys, F.explode(_chunks(F.col("text"), True, hash_filter(often, "hash"))).alias("c")).select("k1", "k2", "c.*"))
    first = F.min(F.struct("k1", "k2", "at", *_BYTES)).alias("first")
    # written, so that both sides of the join are plain exchanges and a hot chunk's copies can be split
    firsts = written(copies.groupBy("hash").agg(F.count("*").alias("n"), first).where("n > 1").select("hash", "first"))
    later = F.struct("k1", "k2", "at") != F.struct("first.k1", "first.k2", "first.at")
    same = lambda c: F.coalesce(F.col(c) == F.col(f"first.{c}"), F.lit(False))
    met = copies.join(firsts, "hash").where(later & same("chunk"))
    grown = met.select("k1", "k2", F.when(same("before"), F.col("low")).otherwise(F.col("at")).alias("from"), F.when(same("after"), F.col("high")).otherwise(F.col("end")).alias("to"), "at", "end", "enough")
    return grown.where(F.col("enough") | (F.col("from") < F.col("at")) | (F.col("to") > F.col("end"))).select("k1", "k2", F.col("from").alias("at"), F.col("to").alias("end")).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with `text` less the repeated chunks, and lines_removed; all rows and other columns stay.

    A text all of whose lines are repeated becomes empty; a null text stays null, with 0 lines removed.
    """
    taken = "lines_removed"
    gone = repeated_chunks(docs).groupBy("k1", "k2").agg(F.collect_list("at").alias("ats"), F.collect_list("end").alias("ends"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(_HIGH)).alias("k1"), F.unhex(F.md5("text")).alias("k2"))
    joined = keyed.join(gone, ["k1", "k2"], "left")
    text = _without(F.col("row.text"), F.col("ats"), F.col("ends")).alias("text")
    # grown chunks overlap: a line is counted once
    places = F.flatten(F.transform(F.arrays_zip("ats", "ends"), lambda c: F.sequence(c["ats"], c["ends"] - 1)))
    removed = F.coalesce(F.array_size(F.array_distinct(places)), F.lit(0)).alias(taken)
    return joined.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != taken], removed)
