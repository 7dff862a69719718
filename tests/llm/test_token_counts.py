import random
from collections import Counter

import public_tokenizers as P

import pytest
from pyspark.sql import functions as F

from tapewright.llm import bpe
from tapewright.llm.bpe import Encoder, read_ranks
from tapewright.llm.common import table
from tapewright.llm.queries import QUERIES, three_edits
from tapewright.llm.token_counts import CountTree, edited, edited_text, recount, trees

OWN = Encoder(read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


def test_counts_after_random_edits_equal_a_whole_recount():
    rng = random.Random(5)
    alphabet = ["a", "the ", "  ", "\n", "'s", "'", "é", "9", "##", "\t", " ", "x y"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 300, 2000])))
        tree = CountTree.of(text, OWN)
        assert tree.count == recount(text, OWN)
        for _ in range(12):
            at, gone = rng.randint(0, len(text) + 3), rng.choice([0, 0, 1, 3, 50, 700])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 4, 40, 900])))
            tree.edit(at, gone, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + gone :]
            assert tree.text == text
            assert tree.count == recount(text, OWN) and tree.chars[1] == len(text)
            if rng.random() < 0.3:
                tree = CountTree(text, tree.leaves(), OWN)


def test_a_small_edit_of_a_long_text_encodes_little():
    tree = CountTree.of("some words of a text. " * 5000, OWN)
    tree = CountTree(tree.text, tree.leaves(), OWN)
    tree.edit(50_000, 3, "new")
    assert tree.encoded < 2000


def test_frequent_pieces_are_merged_once_however_many_rare_ones_pass(monkeypatch):
    merged, merge = Counter(), bpe.merge_bytes
    monkeypatch.setattr(bpe, "_REMEMBERED", 100)
    monkeypatch.setattr(bpe, "merge_bytes", lambda piece, ranks: (merged.update([piece]), merge(piece, ranks))[1])
    often = [f" qx{a}vz" for a in "abcdefgh"]
    text = "".join(often[i % 8] + f" zq{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}j" for i in range(1000))
    own = Encoder(OWN.counts.ranks, P.PATTERN)
    tree = CountTree.of(text, own)
    assert [merged[p.encode()] for p in often] == [1] * 8
    assert tree.count == recount(text, OWN)


def test_the_query_counts_every_document_before_and_after(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op8_edited_counts"](spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text", edited_text(F.col("text"), three_edits(F.col("text"))).alias("new")).collect()
    assert len(docs) == len(got)
    for r in docs:
        own = got[r.doc_id]
        assert (own.before, own.after, own.text_chars) == (recount(r.text or "", OWN), recount(r.new, OWN), len(r.new))
    long = [r for r in got.values() if r.text_chars > 5_000]
    assert long and all(r.reencoded_chars < 0.5 * r.text_chars for r in long)


def test_kept_leaves_serve_the_next_edit_and_odd_edits_do_nothing(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    texts = ["one two three " * 200, "", None, "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("leaves", trees(F.col("text"), path, P.PATTERN))
    first = "array(named_struct('at', 5, 'removed', 3, 'added', 'NEW'), null, named_struct('at', -4, 'removed', -1, 'added', string(null)))"
    then = "array(named_struct('at', 99999, 'removed', 7, 'added', ' end'))"
    one = docs.withColumn("c", edited(F.col("text"), F.col("leaves"), F.expr(first), path, P.PATTERN)).withColumn("text", edited_text(F.col("text"), F.expr(first)))
    two = one.select("doc_id", edited(F.col("text"), F.col("c.leaves"), F.expr(then), path, P.PATTERN).alias("c"), edited_text(F.col("text"), F.expr(then)).alias("text"))
    for r in two.collect():
        assert r.text.endswith(" end") and r.c.after == recount(r.text, OWN) and r.c.text_chars == len(r.text)
    none = docs.select(edited(F.col("text"), F.col("leaves"), F.lit(None).cast("array<struct<at:int,removed:int,added:string>>"), path, P.PATTERN).alias("c")).collect()
    assert all(r.c.before == r.c.after and r.c.reencoded_chars == 0 for r in none)
    with pytest.raises(Exception, match="another text"):
        docs.select(edited(F.concat("text", F.lit("x")), F.col("leaves"), F.expr(then), path, P.PATTERN)).collect()
