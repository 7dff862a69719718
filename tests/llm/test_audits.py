"""The Merkle manifest and the filter audit against brute force, and their edge cases."""

import re
import zlib
from hashlib import sha256
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tapewright.llm import filter_audit, merkle
from tapewright.llm.queries import ORACLES, QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_leaf(*fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((run[: i % 16], run[i % 16 + 1 :]))
        i //= 16
    return out


def brute_manifest(rows):
    """rows: (doc_id, source, leaf, changed leaf or None)."""
    trees: dict = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: brute_tree([r[2] for r in trees[s]]) for s in names}
    top = brute_tree([levels[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, _, leaf, changed) in enumerate(trees[s]):
            path = brute_path(levels[s], i) + brute_path(top, k)
            node = changed or leaf
            for a, b in path:
                node = h(*a, node, *b)
            out.append((doc_id, leaf, levels[s][-1][0], top[-1][0], h(*[x for a, b in path for x in (*a, *b)]), node, node == top[-1][0]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], *map(str, r[2:])))


def test_manifest_equals_brute_force_over_several_rounds(spark):
    """A source of more leaves than two blocks, one of a block and a leaf, lone leaves, null sources and ids, repeated rows."""
    sizes = {"big": 2 * merkle.BLOCK + 17, "edge": merkle.BLOCK + 1, None: 300, "": 16, "é": 17, "z": 1, "eclair": 2}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append(((i * 7919) % 100_003, source, h(str(i)), h("x", str(i)) if i % 5 == 0 else None))
    rows += [(None, "z", h("n"), None), (None, None, h("m"), h("m")), rows[0], rows[0]]
    rows += [(10**6 + k, f"s{k:03}", h("s", str(k)), None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string, tampered_leaf string")
    got = merkle.manifest(df.repartition(5)).collect()
    assert ordered(got) == ordered(brute_manifest(rows))
    assert {r.verified for r in got if r.doc_id is None} == {True}


@pytest.mark.parametrize("size", [1, 2, 15, 16, 17, 255, 256, 257, 4095, 4096])
def test_a_block_is_its_tree_and_every_path_leads_to_the_top(size):
    leaves = [h(str(i)) for i in range(size)]
    block = merkle.Block(leaves, size)
    levels = brute_tree(leaves)
    assert [[bytes(x).decode() for x in level] for level in block.levels] == levels
    for i in {0, size // 2, size - 1}:
        steps = list(block.steps(i))
        assert [(bytes(a).decode(), bytes(b).decode()) for a, b in steps] == [("".join(a), "".join(b)) for a, b in brute_path(levels, i)]
        assert merkle.fold(leaves[i].encode(), steps).decode() == levels[-1][0]


def odd_docs():
    texts = [None, "", " \n\t ", "a\x0bb\x0cc", "Ünï côdé ☃   x", "UPPER lower", "long " * 60_000, "# $ |"]
    rows = [(i, t, "en" if i % 2 else None, [None, "", "s", "ß"][i % 4], None if i % 3 else i) for i, t in enumerate(texts * 3)]
    return rows + [(None, None, None, None, None), (3, "word word", "en", "s", 9), (3, "word word", "en", "s", 9), (None, "word word", "en", "s", 9)]


def test_manifest_query_over_odd_rows(spark, tmp_path):
    rows = odd_docs()
    spark.createDataFrame(rows, DOC).withColumn("leaf", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    leaves = []
    for i, text, lang, source, n in rows:
        low = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        changed = brute_leaf(i, source, lang, n, low) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else None
        leaves.append((i, source, brute_leaf(i, source, lang, n, text), changed))
    got = QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()
    assert ordered(got) == ordered(brute_manifest(leaves))
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op12_merkle_manifest"](spark, f"{tmp_path}/none").collect() == []


def test_audit_equals_brute_force(spark, tmp_path):
    """Every order applied to every document one after the other."""
    clean = " ".join(f"w{i}" for i in range(60))
    texts = [clean, clean, clean + " #", "A" * 50 + clean, "same " * 60, "same " * 60, clean + " Q" * 40, None, "", "|", "B B", clean + " |" * 90, clean]
    rows = [(i * 3 % 31, t, "en", ["s", None, "", "t"][i % 4], 1) for i, t in enumerate(texts)] + [(None, clean, "en", "s", 1), (None, "", "en", "t", 1), (9, "twice", "en", "s", 1), (9, "twice", "en", "s", 1)]
    labels = [(i, i % 2, (i + 1) % 3 // 2) for i in range(0, 31, 2)] + [(0, 1, 0), (None, 1, 1), (9, None, 1)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))

    def failures(i, text):
        text = text or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {"A": len(found) < 50, "B": 100 * len(set(found)) < 65 * len(found), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        return out | {"E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)}

    docs = [(i, source or "", failures(i, t)) for i, t, _, source, _ in rows]
    wanted = {}
    for part in {p for _, p, _ in docs}:
        shares = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, f in docs if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                lost = [(i, f) for i, f in left if f[x]]
                redundant = sum(f[x] for _, f in gone)
                left = [(i, f) for i, f in left if not f[x]]
                gone += lost
                unique = sum(f[x] and sum(f.values()) == 1 for _, p, f in docs if p == part)
                wanted[part, order, step] = [len(left), len(lost), redundant, unique, sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
                shares[x] += len(lost)
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                wanted[part, order, step].append(shares[x])
    got = QUERIES["op13_lattice_audit"](spark, str(tmp_path)).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == wanted and len(got) == len(wanted)
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(db.execute(ORACLES["op13_lattice_audit"]).fetchall())


def test_audit_of_odd_and_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(odd_docs(), DOC).withColumns({"part": F.lit(1), "n": F.lit(2), "fails": F.lit(3)})
    rows = filter_audit.audit(filter_audit.failure_counts(docs, labels)).collect()
    n = {p: sum((r[3] or "") == p for r in odd_docs()) for p in ("", "s", "ß")}
    assert len(rows) == 600 * len(n) and all(r.kept + r.removed + sum(x.removed for x in rows if (x.part, x.filter_order) == (r.part, r.filter_order) and x.step < r.step) == n[r.part] for r in rows if r.filter_order == "CADBE")
    assert filter_audit.audit(filter_audit.failure_counts(docs.limit(0), labels)).count() == 0
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(filter_audit.failure_counts(docs, labels), "ABCDEFGH")
