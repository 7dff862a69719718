"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent letter n-grams, most frequent first. A text's own list is
compared with each profile by the out-of-place distance: the sum over its n-grams of how far their ranks are
apart, at most the profile's length where the profile lacks the n-gram. The nearest profile wins.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import in_sample, sample_threshold, training_row

UNKNOWN = "und"
GRAMS = 300
#: Documents of one language, at most about so many, from which its profile is learned.
SAMPLE_DOCS = 2000
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of 1 to 3 characters in a lower-cased text; what isn't a letter is one gap, in no 1-gram."""
    chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _is_letter()[chars]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    chars = np.where(letter, chars, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate(([0], chars[keep], [0]))
    if not letter[-1]:
        c = c[:-1]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    gap_between = three[(c[1:-1] != 0)]
    return np.unique(np.concatenate((c[c != 0], two, gap_between)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    return codes[np.lexsort((codes, -counts))[:most]]


def learn_profiles(docs: DataFrame, most: int = GRAMS, sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """Profiles of all languages in `lang`, from rows that may be learned from (common.training_row).

    About sample_docs documents of each language are read, chosen by a hash of their ids; that bounds what is learned
    from and what comes to the driver (`most` n-grams a language). Null texts and null languages teach nothing.
    An empty table gives no profile.
    """
    known = docs.where(training_row() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    limit = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(sample_threshold(n, sample_docs)))])
    sample = known.where(in_sample(limit[F.col("lang")], "doc_id")).select("lang", "text")

    def count(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                codes, n = grams("\n".join(t for t, own in zip(texts, langs, strict=True) if own == lang))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    # the n-grams of bounded samples, ranked in one job
    totals = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    out: dict[str, list[int]] = {}
    for r in totals.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("lang", "rank").select("lang", "code").collect():
        out.setdefault(r.lang, []).append(r.code)
    return {lang: np.array(codes, np.int64) for lang, codes in out.items()}


def identify(text: Column, profiles: dict[str, np.ndarray], most: int = GRAMS) -> Column:
    """struct(lang string, score double) of each text.

    lang is `und` and the score 0 for a null text, a text without a letter, and where there is no profile. The score
    is 1 less the distance's share of its greatest value. Ties go to the language that is first in the alphabet. Repeated
    rows get the same result each.
    """
    names = sorted(profiles)
    tables = []
    for lang in names:
        order = np.argsort(profiles[lang])
        tables.append((profiles[lang][order], order))

    @F.arrow_udf("struct<lang:string,score:double>")
    def nearest(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for t in texts.to_pylist():
            own = ranked(*grams(t), most)
            if not len(own) or not names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            rank = np.arange(len(own))
            found = []
            for codes, ranks in tables:
                at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                found.append(int(np.where(codes[at] == own, np.minimum(np.abs(ranks[at] - rank), most), most).sum()))
            best = int(np.argmin(found))
            langs.append(names[best])
            scores.append(1 - found[best] / (most * len(own)))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    # so that a filter on the result doesn't evaluate it once more
    return nearest.asNondeterministic()(text)
