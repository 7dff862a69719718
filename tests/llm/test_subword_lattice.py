"""The subword lattice against all cuts written out, its base against plain counts, and its edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tapewright.llm import subword_lattice as lattice
from tapewright.llm.common import table
from tapewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PIECES = ["</s>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "c", "é", "▁aba"]


def cuts(word, pieces):
    """All ways to cut a word: lists of pieces, characters that are no piece as their bytes."""
    if not word:
        yield []
        return
    if word[0] not in pieces:
        first = [f"<0x{b:02X}>" for b in word[0].encode("utf-8", "surrogateescape")]
        yield from (first + rest for rest in cuts(word[1:], pieces))
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            yield from ([word[:n]] + rest for rest in cuts(word[n:], pieces))


def test_forward_and_expectations_are_sums_over_all_cuts():
    weights = np.random.default_rng(3).random(len(PIECES)) + 0.1
    probabilities = weights / weights.sum()
    p = dict(zip(PIECES, probabilities, strict=True))
    words = ["▁", "▁a", "▁abab", "▁aababa", "▁xé☃", "▁\x00", "▁" + "ab" * 6, "▁a" + lattice.marked("a▁b".encode())[2:], "▁\udcff"]
    own = lattice.Lattice(PIECES, probabilities)
    got, into = own.forward(words), np.zeros(len(PIECES))
    times = np.arange(1.0, len(words) + 1)
    own.expected(words, times, into)
    wanted = Counter()
    for word, n, log in zip(words, times, got, strict=True):
        all_cuts = [(c, math.prod(p[x] for x in c)) for c in cuts(word, set(PIECES[257:]))]
        total = sum(w for _, w in all_cuts)
        assert log == pytest.approx(math.log(total)), word
        for c, w in all_cuts:
            for x in c:
                wanted[x] += n * w / total
    assert dict(zip(PIECES, into, strict=True)) == pytest.approx({x: wanted[x] for x in PIECES}, abs=1e-9)
    long = "▁" + "abcé" * 30_000
    assert own.forward([long, "▁a"])[1] == pytest.approx(got[1]) and -1e6 < own.forward([long])[0] < 0


def brute_scores(rows):
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for k, (_, t) in enumerate(rows)}
    train = Counter(w for k, (i, _) in enumerate(rows) if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in words[k])
    n, v = sum(train.values()), len(train)
    return [(len(words[k]), sum(train[w] > 0 for w in words[k]), n, sum(math.log10((train[w] + 1) / (n + 1 * (v + 1))) for w in words[k])) for k in range(len(rows))]


def check(rows, got):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    wanted = sorted([(i, *x) for (i, _), x in zip(rows, brute_scores(rows), strict=True)], key=key)
    have = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    assert [w[:4] for w in wanted] == [h[:4] for h in have]
    assert [w[4] for w in wanted] == pytest.approx([h[4] for h in have])


def test_query_equals_plain_counts_and_the_models_own_scores(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op11_subword_lattice"](spark, SF).collect()
    check(list(texts.items()), got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and -math.inf < r.score < 0 for r in got)
    # learned pieces say more of texts that weren't learned from than the vocabulary's ranks alone
    vocabulary = lattice.read_vocabulary(P.path("piece_bpe_32k.model"))
    first = lattice.Lattice(list(vocabulary), lattice.prior(vocabulary))
    held = [r for r in got if r.held_out]
    alone = {r.doc_id: sum(first.forward([lattice.marked(w) for w in lattice.words_of((texts[r.doc_id] or "").encode())])) / math.log(10) for r in held}
    assert sum(r.score for r in held) > 0.8 * sum(alone.values())


def test_a_small_head_gives_the_same_scores(spark):
    """Words that are joined count like those that are broadcast."""
    docs = table(spark, SF, "documents")
    vocabulary = lattice.read_vocabulary(P.path("piece_bpe_32k.model"))
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    rows = [{r.doc_id: list(r)[1:] for r in lattice.score(docs, lattice.learn(docs, train, vocabulary, head=head), ["doc_id"]).collect()} for head in (0, 50, 1 << 17)]
    for i in rows[0]:
        assert rows[0][i] == pytest.approx(rows[1][i]) and rows[0][i] == pytest.approx(rows[2][i])


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " \n\t ", "A\x0bb\x0cC a\x1cb", "É é ☃ \x00", "x" * 100_000, "word " * 60_000, "▁ a▁b"]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(None, "only here"), (3, "twice"), (3, "twice")]
    spark.createDataFrame([(i, t, "en", "s", 1, 0, 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, word int, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_subword_lattice"](spark, str(tmp_path)).collect()
    check(rows, got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2, 8, 9, 10)}) == 1 and not any(r.held_out for r in got if r.doc_id is None)
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op11_subword_lattice"](spark, f"{tmp_path}/none").collect() == []
