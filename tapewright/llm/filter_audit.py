"""Filter interaction audit: what each filter takes away in every order of applying the filters.

Filters as subsets form a lattice: an edge leads from the set of filters already applied to that set and one filter more.
With five filters there are 80 edges. A document counts on every edge by its failures alone, whatever the order, so the
documents are reduced to counts for each (part, failures), those to sums for each edge, and each of the 120 orders is a
path of five edges whose sums are looked up.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import written

FILTERS = "ABCDE"
#: Filters of which all orders are listed, at most: 7! * 7 rows are 35,280 a part.
MOST_FILTERS = 7
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
_SYMBOLS, _CAPITALS = b"#$%&*|", bytes(range(65, 91))
SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails. Words are what stands between ASCII white space."""
    words = text.split()
    short = len(words) < LEAST_WORDS
    repeats = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    points = len(text.decode("utf-8", "replace"))
    loud = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > MOST_CAPITALS * points
    symbols = len(text) != len(text.translate(None, _SYMBOLS))
    return short | repeats << 1 | loud << 2 | symbols << 3


def judged(text: Column) -> Column:
    """struct(fails, digest): failures of A to D and the sha256 of a text; a null is the empty text."""

    @F.arrow_udf("struct<fails:int,digest:binary>")
    def judge(texts: pa.Array) -> pa.Array:
        fails, digests = [], []
        for text in pc.cast(texts, pa.binary()):
            text = text.as_py() or b""
            fails.append(text_failures(text))
            digests.append(hashlib.sha256(text).digest())
        return pa.StructArray.from_arrays([pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], ["fails", "digest"])

    return judge(text)


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), n, good, toxic: documents of each part by what they fail; good and toxic are those of labels.

    docs has doc_id, source and text. E is failed by a text that a smaller doc_id has too, anywhere in the table. Null
    texts are empty, null sources the part ''. A null id is neither smaller nor larger than another: such rows fail no
    E and make none fail; they have no label. Rows that repeat with the same id count each, and not as copies of each
    other. Of several labels of an id a 1 counts. An empty table has no counts.
    """
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), judged(F.col("text")).alias("j"))
    rows = written(texts.select("doc_id", "part", "j.*").groupBy("digest", "doc_id", "part", "fails").agg(F.count("*").alias("n")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    marked = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(marked("quality").alias("good"), marked("toxic").alias("toxic")).withColumn("_spread", F.lit(0))
    # null ids match nothing; by their digest they don't all meet in one task
    spread = F.when(F.col("doc_id").isNull(), F.hash("digest")).otherwise(0)
    labelled = rows.withColumn("_spread", spread).join(known, ["doc_id", "_spread"], "left")
    # copies of a text become one row for each part and label before they meet with the text's first id
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    grouped = labelled.groupBy("digest", "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    copies = grouped.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"), least)
    passed = F.col("unnumbered") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("fails"), passed.alias("n")), F.struct(F.col("fails").bitwiseOR(1 << 4).alias("fails"), (F.col("n") - passed).alias("n")))).alias("c")
    counted = copies.join(first, "digest").select("part", "good", "toxic", both).where("c.n > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("c.n")).otherwise(0)).alias(flag)
    return counted.groupBy("part", "c.fails").agg(F.sum("c.n").alias("n"), of("good"), of("toxic"))


def lattice_edges(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, applied (bits), next (place of the filter) and SUMS for each of the lattice's edges, zeros included, from counts of documents by failures."""
    n = len(filters)
    edges = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for f in range(n) for s in range(1 << n) if not s >> f & 1])
    each = counts.withColumn("e", F.explode(edges))
    bit = F.call_function("shiftleft", F.lit(1), F.col("e.next"))
    reaches = F.col("fails").bitwiseAND(F.col("e.applied")) == 0
    fails = F.col("fails").bitwiseAND(bit) != 0
    of = lambda c, which: F.sum(F.when(which, F.col(c)).otherwise(0))
    sums = {
        "kept": of("n", reaches & ~fails),
        "removed": of("n", reaches & fails),
        "redundant": of("n", ~reaches & fails),
        "unique_fails": of("n", F.col("fails") == bit),
        "good_lost": of("good", reaches & fails),
        "toxic_lost": of("toxic", reaches & fails),
    }
    return each.groupBy("part", "e.applied", "e.next").agg(*[v.alias(k) for k, v in sums.items()])


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """filter_order, step, applied, next: every step of every order as an edge of the lattice."""
    out = []
    for p in permutations(range(len(filters))):
        applied = 0
        for step, f in enumerate(p, 1):
            out.append(("".join(filters[i] for i in p), step, applied, f))
            applied |= 1 << f
    return out


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, SUMS and shapley (what the step's filter removes, summed over all orders) from failure_counts.

    One row for each part and step of each order. shapley weights an edge by the orders that go along it: s! (n-1-s)! for
    s filters applied. The steps are a literal table, broadcast (at most MOST_FILTERS! * MOST_FILTERS rows).
    """
    n = len(filters)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    steps = counts.sparkSession.createDataFrame(orders(filters), "filter_order string, step int, applied int, next int")
    edges = lattice_edges(counts, filters)
    along = F.get(F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)]), F.bit_count("applied"))
    shares = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * along).alias("shapley"))
    return edges.join(F.broadcast(steps), ["applied", "next"]).join(shares, ["part", "next"]).select("part", "filter_order", "step", *SUMS, "shapley")


def sql(filters: str = FILTERS) -> str:
    """The audit of documents in SQL: every order's steps counted from the documents' failures, without the lattice."""
    word = r"[^\x20\x09-\x0D]+"
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(filters))
    names = [f"l{i}" for i in range(len(filters))]
    distinct = " AND ".join(f"{a}.c <> {b}.c" for i, a in enumerate(names) for b in names[:i])
    together = " || ".join(f"{x}.c" for x in names)
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{word}') AS ws FROM d),
m AS (SELECT doc_id, part, CAST(len(ws) < {LEAST_WORDS} AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS fails FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters(c, bit) AS (VALUES {letters}),
orders AS (SELECT {together} AS filter_order FROM {", ".join(f"letters {x}" for x in names)} WHERE {distinct}),
places AS (SELECT filter_order, CAST(unnest(range(1, {len(filters) + 1})) AS INTEGER) AS step FROM orders),
steps AS (SELECT filter_order, step, (SELECT bit FROM letters WHERE c = substr(filter_order, step, 1)) AS bit, coalesce((SELECT sum(bit) FROM letters WHERE position(c IN substr(filter_order, 1, step - 1)) > 0), 0)::INTEGER AS applied FROM places),
r AS (SELECT part, filter_order, step, bit,
 sum(CASE WHEN fails & applied = 0 AND fails & bit = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & applied = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN fails & applied <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN fails & applied = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & applied = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
 FROM c, steps GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in SUMS)}, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
