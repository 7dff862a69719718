"""Quality rules: base counts of a text, and the divergence of its histograms from those of the languages.

A document's shares of character classes and of a language's most common words are compared with the same shares of
all documents of that language, by Jensen-Shannon distance (base 2: 0 to 1). A document whose distance to the nearest
language is over the limit is rejected; one too short for a histogram to say anything is left alone. For words the limit
is a share of the distance that a text without any of the language's common words has, which is far from 1.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import written

SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")
COMMON_WORDS, COMMON_LENGTH = 40, 6
#: Fewer characters or words than these, and the distance isn't judged.
GUARD_CHARS, GUARD_WORDS = 200, 50
CHAR_LIMIT = 0.25
#: Share of the distance of a text without common words.
WORD_LIMIT = 0.9
_class: np.ndarray | None = None
_bare = re.compile(r"[^\W\d_]+")


def _classes() -> np.ndarray:
    global _class
    if _class is None:
        kinds = {"Ll": 0, "Lo": 0, "Lm": 0, "Mn": 0, "Mc": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3, "Zl": 3, "Zp": 3, "Po": 4, "Pd": 4, "Ps": 4, "Pe": 4, "Pi": 4, "Pf": 4, "Pc": 4, "Sm": 5, "Sc": 5, "Sk": 5, "So": 5}
        _class = np.fromiter((kinds.get(unicodedata.category(chr(c)), 6) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        _class[[9, 10, 11, 12, 13]] = 3
        _class[list(SYMBOLS)] = 5
    return _class


def char_histogram(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(_classes()[codes], minlength=len(CLASSES))


def letter_words(text: str) -> list[str]:
    """The letter runs of the lower-cased text."""
    return _bare.findall(text.lower())


def repeated_words(words: list) -> int:
    """Words that lie in a window of WINDOW words found twice or more in the list."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # exact window codes: two windows get one code just when their words are the same
    span = codes
    for reach in (1, 2, 4):
        pair = span[:-reach] * np.int64(len(words) + 1) + span[reach:]
        span = np.unique(pair, return_inverse=True)[1]
    often = np.bincount(span)[span] > 1
    if not often.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def wordless(bins: np.ndarray) -> float:
    """Distance to a language's word histogram of a text that has none of its common words, of any length."""
    return distance(np.eye(len(bins))[-1], bins)


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, list[str], np.ndarray]]:
    """For each language: the character-class histogram, the COMMON_WORDS most common words, and their histogram with a last bin for all other words.

    Counted over all documents with text and language. Only the finished histograms come to the driver. A language
    without a single letter word is left out. Repeated rows each count; an empty table, or one without languages, gives no
    reference; only `text` and `lang` of docs are read.
    """

    def count(batches):
        for batch in batches:
            chars: dict = {}
            words: dict = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chars[lang] = chars.get(lang, 0) + char_histogram(text)
                found = Counter(letter_words(text))
                own = words.setdefault(lang, Counter())
                # words of up to COMMON_LENGTH letters: function words are among them in any language
                own.update({w: n for w, n in found.items() if len(w) <= COMMON_LENGTH})
                own[""] += found.total()
            rows = [(k, f"#{i}", int(n)) for k, h in chars.items() for i, n in enumerate(h)] + [(k, w, n) for k, c in words.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    given = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    totals = written(given.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    out = {}
    heads = {r.lang: r.n for r in totals.where(F.col("word") == "").collect()}
    for lang, total in sorted(heads.items()):
        own = totals.where(F.col("lang") == lang)
        chars = np.zeros(len(CLASSES))
        for r in own.where(F.col("word").startswith("#")).collect():
            chars[int(r.word[1:])] = r.n
        top = own.where((F.col("word") != "") & ~F.col("word").startswith("#")).orderBy(F.desc("n"), "word").limit(COMMON_WORDS).collect()
        if top and total:
            bins = np.array([r.n for r in top] + [0], float)
            bins[-1] = max(0, total - bins.sum())
            out[lang] = (chars, [r.word for r in top], bins)
    return out


def judge(text: Column, refs: dict, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> Column:
    """struct of the base counts, base_failed, the two distances and kept, for each text.

    A null or empty text has zero counts and fails the base; repeated rows each get their own, and an empty table gives none. The distances are null below the guards (GUARD_CHARS
    characters, GUARD_WORDS letter words) or without references; then only the base decides. word_limit is a share of each
    language's `wordless` distance; word_distance is the least distance itself.
    """
    fields = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64()), ("kept", pa.bool_())]
    tables = [(chars, {w: i for i, w in enumerate(words)}, bins, word_limit * wordless(bins)) for chars, words, bins in refs.values()]

    def one(text: str | None) -> tuple:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        n_chars = len(text) - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        repeats = repeated_words(words)
        failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
        by_char = by_word = None
        strange = False
        if tables and len(text) >= GUARD_CHARS:
            own = char_histogram(text)
            by_char = min(distance(own, chars) for chars, *_ in tables)
            found = Counter(letter_words(text))
            total = found.total()
            if total >= GUARD_WORDS:
                each = []
                for _, at, bins, _ in tables:
                    hist = np.zeros(len(bins))
                    for w, i in at.items():
                        hist[i] = found.get(w, 0)
                    hist[-1] = total - hist.sum()
                    each.append(distance(hist, bins))
                by_word = min(each)
                strange = all(x > most for x, (*_, most) in zip(each, tables, strict=True))
        kept = not failed and (by_char is None or by_char <= char_limit) and not strange
        return n, n_chars, symbols, len(lines) - len(set(lines)), repeats, failed, by_char, by_word, kept

    @F.arrow_udf("struct<" + ",".join(f"{k}:{ {pa.int64(): 'bigint', pa.bool_(): 'boolean', pa.float64(): 'double'}[v] }" for k, v in fields) + ">")
    def rules(texts: pa.Array) -> pa.Array:
        cols = list(zip(*map(one, texts.to_pylist()), strict=True)) or [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, fields, strict=True)], [k for k, _ in fields])

    return rules(text)
