"""Merkle manifest of a dataset: a tree of digests for each source, a root over the trees, and every row's proof.

Leaves get their place in their tree from a sort by ranges, so one source may hold any share of the rows. Blocks of
BLOCK leaves are aligned with the tree (BLOCK is a power of FANOUT), so a block reduces to one node by itself. In a block
the hexadecimal digests are one contiguous matrix of 64 bytes a row: reshaped by FANOUT its rows are the runs to hash,
level by level, and the siblings of every node come from index arithmetic. The nodes of the blocks are the leaves of the
next round, each of a BLOCK-th of the rows; proofs come down the same way, with the path above a block joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import written

FANOUT, BLOCK_LEVELS = 16, 3
BLOCK = FANOUT**BLOCK_LEVELS
DIGEST = 64
_PATH = "path array<struct<before:string,after:string>>"


def leaf(fields: list[str | Column]) -> Column:
    """The digest of a row: each field `-` if null, else its UTF-8 length in bytes, a colon and the value."""
    texts = [(F.col(f"`{c}`") if isinstance(c, str) else c).cast("string") for c in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def levels_of(size: int) -> int:
    """Levels of a tree of so many leaves: 0 for one."""
    return 0 if size <= 1 else 1 + levels_of(-(-size // FANOUT))


def matrix(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, DIGEST)


def padded(nodes: np.ndarray) -> np.ndarray:
    """The nodes with rows of zeros up to a multiple of FANOUT."""
    return np.concatenate([nodes, np.zeros((-len(nodes) % FANOUT, DIGEST), np.uint8)])


def parents(nodes: np.ndarray) -> np.ndarray:
    """One level up: the digest of each run of FANOUT nodes; the last run may be shorter."""
    runs = padded(nodes).reshape(-1, FANOUT * DIGEST)
    sizes = np.minimum(FANOUT, len(nodes) - FANOUT * np.arange(len(runs))) * DIGEST
    return matrix([sha256(row[:n]).hexdigest() for row, n in zip(runs, sizes, strict=True)])


def siblings(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node the other nodes of its run in order, (FANOUT - 1) * 64 bytes, and how many of the bytes count."""
    at = np.arange(len(nodes))
    run, slot = np.divmod(at, FANOUT)
    place = np.arange(FANOUT - 1)
    others = run[:, None] * FANOUT + place + (place >= slot[:, None])
    sizes = (np.minimum(FANOUT, len(nodes) - run * FANOUT) - 1) * DIGEST
    return np.ascontiguousarray(padded(nodes)[others].reshape(len(nodes), -1)), sizes


def climb(nodes: np.ndarray, levels: int) -> list[np.ndarray]:
    """The nodes and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append(parents(out[-1]))
    return out


class Block:
    """A block's levels, with what stands beside each node."""

    def __init__(self, digests: list[str], size: int):
        self.levels = climb(matrix(digests), min(BLOCK_LEVELS, levels_of(size)))
        self.beside = [(memoryview(s).cast("B"), s.shape[1], n.tolist()) for s, n in map(siblings, self.levels[:-1])]

    def steps(self, at: int) -> Iterator[tuple[memoryview, memoryview]]:
        """The siblings before and after the node above leaf `at`, level by level."""
        for flat, width, sizes in self.beside:
            own, cut = flat[at * width : at * width + sizes[at]], at % FANOUT * DIGEST
            yield own[:cut], own[cut:]
            at //= FANOUT


def fold(node: bytes, steps) -> bytes:
    """The root that a node and its siblings lead to."""
    for before, after in steps:
        h = sha256(before)
        h.update(node)
        h.update(after)
        node = h.hexdigest().encode()
    return node


def placed(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """nodes with pos, the place in its tree (from 0, by `order`), and size, the nodes of the tree. `tree` has no nulls.

    Rows are dealt out by ranges and numbered where they are written; the counts of each task's trees give the rest.
    """
    dealt = nodes.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.spark_partition_id()))
    runs = dealt.groupBy(tree, "_task").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = runs.select(tree, "_task", (before - F.col("_from")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    return dealt.join(shifts, [tree, "_task"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).alias("block")


def block_nodes(nodes: DataFrame) -> DataFrame:
    """The node of each block of nodes (tree, pos, size, digest): a row of the next round, in the same form."""

    def top(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        size, pos = t.column("size")[0].as_py(), t.column("pos")[0].as_py()
        node = climb(matrix(t.column("digest").to_pylist()), min(BLOCK_LEVELS, levels_of(size)))[-1].tobytes().decode()
        return pa.table({"tree": t.column("tree").slice(0, 1), "pos": [pos // BLOCK], "size": [-(-size // BLOCK)], "digest": [node]})

    dealt = nodes.select("tree", "pos", "size", "digest", _block())
    return dealt.groupBy("tree", "block").applyInArrow(top, "tree string, pos long, size long, digest string")


def reduced(nodes: DataFrame) -> list[DataFrame]:
    """The rounds from the leaves up to one node for each tree. A round has a BLOCK-th of the rows of the one below."""
    rounds = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1 or len(rounds) == 1:
        rounds.append(written(block_nodes(rounds[-1])))
        most = -(-most // BLOCK)
    return rounds


def paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """tree, pos, path: the siblings of each node from its own level up to the top. above has the paths of the blocks (tree, pos, path)."""

    def own(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        block = Block(t.column("digest").to_pylist(), t.column("size")[0].as_py())
        rest = up.column("path")[0].as_py()
        each = [[{"before": bytes(a).decode(), "after": bytes(b).decode()} for a, b in block.steps(i)] + rest for i in range(len(t))]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.table({"tree": t.column("tree"), "pos": t.column("pos"), "path": pa.array(each, kind)})

    blocks = nodes.select("tree", "pos", "size", "digest", _block()).groupBy("tree", "block")
    return blocks.cogroup(above.select("tree", F.col("pos").alias("block"), "path").groupBy("tree", "block")).applyInArrow(own, f"tree string, pos long, {_PATH}")


def manifest(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of rows (doc_id, source, leaf, tampered_leaf).

    Per source, leaves ascend by doc_id (a null id first, ties by leaf); every FANOUT consecutive nodes, the last run with
    fewer, become their digest while there are several. What remains, a lone leaf itself, is the subroot. The subroots,
    ordered by source (null first, then by UTF-8 bytes), lead to the root likewise. proof_sha256 is the digest of all
    siblings from the leaf up to the root. folded_root is worked out from tampered_leaf, or the leaf where that is null,
    and the siblings; verified tells whether it is the root. Rows that repeat have a leaf each. An empty table gives no
    rows. Other columns of rows are left out.
    """
    # an empty tree key stands for a null source, and sorts first
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree")
    leaves = placed(written(rows.select(tree, "doc_id", "leaf", "tampered_leaf")), "tree", ["doc_id", "leaf"])
    leaves = written(leaves)
    rounds = reduced(leaves.withColumnRenamed("leaf", "digest"))
    tops = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = written(placed(tops, "tree", ["source"]))
    upper = reduced(sources)
    nothing = F.expr(f"CAST(array() AS {_PATH.removeprefix('path ')})").alias("path")
    above = written(upper[-1].select("tree", "pos", nothing))
    for nodes in reversed(upper[:-1]):
        above = written(paths(nodes, above))
    root = (upper[-1].select("digest").first() or [None])[0]
    named = sources.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "pos").join(above.select("pos", "path"), "pos")
    tree_top = written(named.select("tree", "subroot", "path"))
    above = tree_top.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for nodes in reversed(rounds[1:-1]):
        above = written(paths(nodes, above))
    facts = above.join(tree_top.select("tree", "subroot"), "tree").withColumn("root", F.lit(root))
    schema = f"doc_id {leaves.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def proofs(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        leaf_texts, tampered = t.column("leaf").to_pylist(), t.column("tampered_leaf").to_pylist()
        block = Block(leaf_texts, t.column("size")[0].as_py())
        rest = [(p["before"].encode(), p["after"].encode()) for p in up.column("path")[0].as_py()]
        rest_bytes = b"".join(a + b for a, b in rest)
        subroot, top = up.column("subroot")[0].as_py(), up.column("root")[0].as_py()
        digests, folded = [], []
        for i, (own, changed) in enumerate(zip(leaf_texts, tampered, strict=True)):
            steps = list(block.steps(i))
            h = sha256()
            for before, after in steps:
                h.update(before)
                h.update(after)
            h.update(rest_bytes)
            digests.append(h.hexdigest())
            folded.append(fold((changed or own).encode(), steps + rest).decode())
        n = len(t)
        return pa.table({"doc_id": t.column("doc_id"), "leaf": leaf_texts, "subroot": [subroot] * n, "root": [top] * n, "proof_sha256": digests, "folded_root": folded, "verified": [f == top for f in folded]})

    blocks = leaves.select("tree", "pos", "size", "doc_id", "leaf", "tampered_leaf", _block()).groupBy("tree", "block")
    return blocks.cogroup(facts.select("tree", F.col("pos").alias("block"), "path", "subroot", "root").groupBy("tree", "block")).applyInArrow(proofs, schema)


def sql(levels: int = 8) -> str:
    """op12's rows in SQL, for trees of up to FANOUT ** levels leaves: a CTE a level, with the siblings from windows."""
    names = ("doc_id", "source", "lang", "n_chars", "text")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    digest = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in names) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)"
    run = f"PARTITION BY tree, pos // {FANOUT} ORDER BY pos"

    def grow(name: str, first: str) -> str:
        out = f"{name}0 AS ({first})"
        for k in range(levels):
            beside = f"coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a"
            out += f", {name}s{k} AS (SELECT tree, pos, h, n > 1 AS live, {beside} FROM {name}{k})"
            out += f", {name}{k + 1} AS (SELECT tree, pos // {FANOUT} AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{k} GROUP BY tree, pos // {FANOUT})"
        return out

    def walk(source: str, name: str, at: str) -> str:
        """CTEs that carry f (the folded node) and p (the siblings so far) of each row up a tree."""
        out, before = "", source
        for k in range(levels):
            out += f", {source}_{name}{k} AS (SELECT r.* EXCLUDE (f, p), CASE WHEN s.live THEN sha256(s.b || r.f || s.a) ELSE r.f END AS f, CASE WHEN s.live THEN r.p || s.b || s.a ELSE r.p END AS p FROM {before} r JOIN {name}s{k} s ON s.tree = r.{at}_tree AND s.pos = r.{at}_pos // {FANOUT**k})"
            before = f"{source}_{name}{k}"
        return out

    return f"""WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {digest("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {digest(lower)} END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
{grow("x", "SELECT tree, pos, leaf AS h, n FROM l")},
{grow("y", f"SELECT 'all' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n FROM x{levels}")},
t AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM x{levels}),
r AS (SELECT doc_id, leaf, subroot, tree AS x_tree, l.pos AS x_pos, 'all' AS y_tree, t.pos AS y_pos, coalesce(changed, leaf) AS f, '' AS p FROM l JOIN t USING (tree)){walk("r", "x", "x")}{walk(f"r_x{levels - 1}", "y", "y")}
SELECT doc_id, leaf, subroot, y.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = y.h AS verified FROM r_x{levels - 1}_y{levels - 1}, y{levels} y"""
