"""Toxicity: Levenshtein automata of a lexicon's trie find its terms and their misspellings; the words around a hit tell quotation from abuse.

The lexicon holds words and stems (beginnings of words). It is learned from labelled documents: terms that stand in
toxic ones and, but for few, not in others. The automata of all terms are intersected with their trie as words are read:
a state is the set of trie nodes within reach and their errors, and is made when a word first needs it. Each hit has a
context score from 0 (abuse) to 1 (quoted or reported), by quotation marks and reporting words within a window of words,
the nearer the higher. A document's sums of these, by kind of hit, go into a logistic score fitted on labelled documents.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import WORD_GAP, in_sample, sample_threshold, training_row

#: About so many labelled documents of each class are learned from, at most.
SAMPLE_DOCS = 8000
#: A term's share of the toxic documents, the most other documents it may be in for one toxic, and the most terms.
LEAST_SHARE, MOST_CLEAN, MOST_TERMS = 0.015, 0.02, 400
STEM_LENGTHS = (4, 5, 6)
LEAST_LENGTH = 4
#: Words of so many letters may differ by 1 or 2 edits; stems and shorter words by none.
ONE_EDIT, TWO_EDITS = 5, 10
#: Words on either side of a hit in which marks of quotation are sought.
CONTEXT_WORDS = 6
QUOTES = (('"', '"'), ("“", "”"), ("«", "»"), ("„", "“"))
#: Reporting words before any are learned from labelled documents, in English; of other languages only learned ones are known.
REPORTING = frozenset("said says say quote quoted quotes quoting called calls word term slur wrote reported insult".split())
#: A reporting word is learned if so many hits of other documents have it before them, for the most part those, and so many times as often as chance would have it.
LEAST_REPORTS, REPORT_SHARE, REPORT_LIFT, MOST_REPORTS = 8, 0.9, 4.0, 100
#: States and words that a Python worker remembers at most.
MOST_STATES, MOST_REMEMBERED = 20_000, 100_000
#: Where there is little to learn from, the weights stay near these: intercept, exact, misspelled, quoted.
PRIOR = np.array([-4.0, 4.0, 2.3, 0.3])
PRIOR_STRENGTH = 2.0
FEATURES = ("exact", "misspelled", "quoted")


class Automaton:
    """The Levenshtein automata of a lexicon's terms, intersected with its trie, made state by state as words need them.

    State 0 is dead, 1 the start. At MOST_STATES all are forgotten and made anew, so memory is bounded and results aren't
    changed.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.trie: list[dict[str, int]] = []
        self.end: dict[int, int] = {}
        self.limit: list[int] = []
        roots: dict[int, int] = {}
        terms = [(w, 0 if len(w) < ONE_EDIT else 1 if len(w) < TWO_EDITS else 2, 1) for w in sorted(set(words))] + [(x, 0, 3) for x in sorted(set(stems))]
        for term, edits, kind in terms:
            # stems and words of no edits have tries of their own, as a stem accepts whatever follows
            node = roots.setdefault(edits if kind == 1 else -1, len(self.trie))
            if node == len(self.trie):
                self._node(edits)
            for c in term:
                child = self.trie[node].get(c)
                if child is None:
                    child = self.trie[node][c] = len(self.trie)
                    self._node(edits)
                node = child
            self.end[node] = kind
        self.letters = frozenset(c for node in self.trie for c in node)
        self.start = self._closed([(node, 0) for node in roots.values()])
        self.known: dict[str, int] = {}
        self._forget()

    def _node(self, edits: int) -> None:
        self.trie.append({})
        self.limit.append(edits)

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []
        for states in (frozenset(), self.start):
            self._number(states)

    def _number(self, states: frozenset) -> int:
        at = self.numbers.get(states)
        if at is None:
            at = self.numbers[states] = len(self.states)
            self.states.append(states)
            self.moves.append({})
            ends = [(errors, self.end[node]) for node, errors in states if node in self.end]
            # 1: a term, 2: a misspelled term, 3: a stem, reached whatever follows
            self.accepts.append(3 if any(k == 3 for _, k in ends) else 0 if not ends else 1 if min(ends)[0] == 0 else 2)
        return at

    def _closed(self, states: list[tuple[int, int]]) -> frozenset:
        """With the letters of the term that the text may lack; of one node the fewest errors."""
        best: dict[int, int] = {}
        while states:
            node, errors = states.pop()
            if best.get(node, 9) > errors:
                best[node] = errors
                if errors < self.limit[node]:
                    states += [(child, errors + 1) for child in self.trie[node].values()]
        return frozenset(best.items())

    def _step(self, states: frozenset, c: str) -> frozenset:
        out = []
        for node, errors in states:
            if c in self.trie[node]:
                out.append((self.trie[node][c], errors))
            if errors < self.limit[node]:
                out.append((node, errors + 1))
                out += [(child, errors + 1) for child in self.trie[node].values()]
        return self._closed(out)

    def kind(self, word: str) -> int:
        """0 for a word that isn't accepted, 1 for a term or a word with a stem, 2 for a misspelled term."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MOST_REMEMBERED:
                self.known.clear()
            found = self.known[word] = self._walk(word)
        return found

    def _walk(self, word: str) -> int:
        if len(self.states) >= MOST_STATES:
            self._forget()
        at = 1
        for c in word:
            c = c if c in self.letters else ""
            after = self.moves[at].get(c)
            if after is None:
                after = self.moves[at][c] = self._number(self._step(self.states[at], c))
            at = after
            if self.accepts[at] == 3:
                return 1
            if not at:
                return 0
        return self.accepts[at]


_word, _run = re.compile(r"[^\W_]+"), re.compile(r"\S+")
_automata: dict[str, Automaton] = {}


def _automaton(key: str, words: list[str], stems: list[str]) -> Automaton:
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(words, stems)
    return _automata[key]


def hits(text: str, own: Automaton) -> list[tuple[int, int, int]]:
    """First place, end and kind of each accepted word of a lower-cased text."""
    # most texts have none, so their words are looked up without places first
    if not any(map(own.kind, set(_word.findall(text)))):
        return []
    return [(m.start(), m.end(), k) for m in _word.finditer(text) if (k := own.kind(m[0]))]


def contexts(text: str, found: list[tuple[int, int, int]]) -> list[tuple[list[str], list[str]]]:
    """What stands before and behind each hit: the rest of its own run of characters, and CONTEXT_WORDS runs; the nearest first."""
    runs = [(m.start(), m.end()) for m in _run.finditer(text)]
    starts = [a for a, _ in runs]
    out = []
    for a, b, _ in found:
        i = bisect_right(starts, a) - 1
        before = [text[runs[i][0] : a], *(text[x:y] for x, y in runs[max(0, i - CONTEXT_WORDS) : i][::-1])]
        behind = [text[b : runs[i][1]], *(text[x:y] for x, y in runs[i + 1 : i + 1 + CONTEXT_WORDS])]
        out.append((before, behind))
    return out


def context_score(before: list[str], behind: list[str], reporting: dict[str, float]) -> float:
    """How much a hit's context says that it is quoted or reported, 0 to 1.

    Quotation marks that open before and close behind it count by how near they are; so do reporting words before it,
    times their weight. The higher of both is taken.
    """
    near = lambda i: 1 - i / (CONTEXT_WORDS + 1)
    best = 0.0
    for left, right in QUOTES:
        opened = next((i for i, run in enumerate(before) if left in run or right in run), None)
        closed = next((i for i, run in enumerate(behind) if right in run), None)
        if opened is None or closed is None:
            continue
        if left == right:
            inside = sum(run.count(left) for run in before) % 2 == 1
        else:
            inside = before[opened].rfind(left) > before[opened].rfind(right)
        if inside:
            best = max(best, (near(opened) + near(closed)) / 2)
    for i, run in enumerate(before):
        for w in _word.findall(run):
            best = max(best, reporting.get(w, 0.0) * near(max(0, i - 1)))
    return best


def counts(text: Column, words: list[str], stems: list[str], reporting: dict[str, float] | None = None) -> Column:
    """struct(exact, misspelled, quoted) of each text: hits by kind, each less its context score, and the sum of these scores. Null and empty texts have none; repeated rows each get theirs."""
    key = uuid.uuid4().hex
    weights = dict.fromkeys(REPORTING, 1.0) if reporting is None else reporting

    @F.arrow_udf("struct<exact:double,misspelled:double,quoted:double>")
    def found(texts: pa.Array) -> pa.Array:
        own = _automaton(key, words, stems)
        rows = np.zeros((3, len(texts)))
        for i, t in enumerate(texts.to_pylist()):
            low = t.lower() if t else ""
            if low and (each := hits(low, own)):
                for (_, _, k), context in zip(each, contexts(low, each), strict=True):
                    quoted = context_score(*context, weights)
                    rows[k - 1, i] += 1 - quoted
                    rows[2, i] += quoted
        return pa.StructArray.from_arrays([pa.array(r) for r in rows], list(FEATURES))

    return found(text)


def context_words(text: Column, words: list[str], stems: list[str]) -> Column:
    """The words before the hits of each text, an array with the distinct ones of each hit."""
    key = uuid.uuid4().hex

    @F.arrow_udf("array<array<string>>")
    def found(texts: pa.Array) -> pa.Array:
        own = _automaton(key, words, stems)
        out = []
        for t in texts.to_pylist():
            low = t.lower() if t else ""
            each = hits(low, own)
            out.append([sorted({w for run in before for w in _word.findall(run)}) for before, _ in contexts(low, each)] if each else [])
        return pa.array(out, pa.list_(pa.list_(pa.string())))

    return found(text)


def learn_reporting(sample: DataFrame, words: list[str], stems: list[str]) -> dict[str, float]:
    """Weights of reporting words: REPORTING, and words that stand before hits of documents that aren't toxic far more often than before hits of toxic ones, and than in those documents at large."""
    found = sample.select("toxic", "text", context_words(F.col("text"), words, stems).alias("near")).where(F.size("near") > 0).persist()
    near = found.select("toxic", F.explode("near").alias("near"))
    total = {r.toxic: (r.hits, r.words) for r in near.groupBy("toxic").agg(F.count("*").alias("hits"), F.sum(F.size("near")).alias("words")).collect()}
    hits = [max(1, total.get(k, (0, 0))[0]) for k in (0, 1)]
    counted = near.select("toxic", F.explode("near").alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") == 0).alias("fair"), F.count_if(F.col("toxic") == 1).alias("abuse"))
    fair, abuse = F.col("fair") / hits[0], F.col("abuse") / hits[1]
    share = fair / (fair + abuse)
    rows = counted.where((F.col("fair") >= LEAST_REPORTS) & (share >= REPORT_SHARE)).orderBy(F.desc("fair"), "word").limit(MOST_REPORTS).select("word", (2 * share - 1).alias("weight"), "fair").collect()
    at_large = found.where("toxic = 0").select(F.explode(F.filter(F.split(F.lower("text"), WORD_GAP), lambda w: w != "")).alias("word"))
    n = at_large.count() if rows else 0
    often = {r.word: r["count"] / n for r in at_large.where(F.col("word").isin([r.word for r in rows])).groupBy("word").count().collect()} if rows else {}
    found.unpersist()
    by_chance = lambda w: often.get(w, 0.0) * total[0][1]
    return dict.fromkeys(REPORTING, 1.0) | {r.word: r.weight for r in rows if r.word not in REPORTING and r.fair >= REPORT_LIFT * by_chance(r.word)}


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """text, toxic: about sample_docs documents at most of each class, of those that may be learned from. That bounds the ids that are broadcast."""
    known = labels.where(training_row() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    limit = F.when(F.col("toxic") == 1, sample_threshold(n.get(1, 0), sample_docs)).otherwise(sample_threshold(n.get(0, 0), sample_docs))
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(known.where(in_sample(limit, "doc_id"))), "doc_id").select("text", "toxic")


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems that mark toxic documents. Copies of a document count once: documents that agree in the two least hashes of their words are taken for copies."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), WORD_GAP), lambda w: F.length(w) >= LEAST_LENGTH))
    own = sample.select("toxic", words.alias("words")).withColumn("sketch", F.xxhash64(F.slice(F.array_sort(F.transform("words", lambda w: F.xxhash64(w))), 1, 2))).where(F.size("words") > 0)
    heads = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.countDistinct("sketch").alias("n")).collect()}
    least = max(3, LEAST_SHARE * heads.get(1, 0))
    term = F.explode(F.flatten(F.transform("words", lambda w: F.array(F.struct(F.lit("").alias("stem"), w.alias("term")), *[F.struct(F.lit("+").alias("stem"), F.when(F.length(w) > n, F.substring(w, 1, n)).alias("term")) for n in STEM_LENGTHS]))))
    terms = lambda toxic: own.where(F.col("toxic") == toxic).select("sketch", term.alias("t")).where(F.col("t.term").isNotNull()).select("sketch", "t.*")
    count = F.countDistinct("sketch")
    # few terms stand in enough toxic documents (the sample bounds them, so they may be broadcast); only those are counted in the others
    often = terms(1).groupBy("stem", "term").agg(count.alias("toxic")).where(F.col("toxic") >= least).persist()
    clean = terms(0).join(F.broadcast(often.select("stem", "term")), ["stem", "term"], "left_semi").groupBy("stem", "term").agg(count.alias("clean"))
    rows = often.join(clean, ["stem", "term"], "left").fillna(0, ["clean"])
    marks = rows.where((F.col("toxic") >= least) & (F.col("clean") <= MOST_CLEAN * F.col("toxic"))).orderBy(F.desc("toxic"), "stem", "term").limit(MOST_TERMS).collect()
    often.unpersist()
    all_words = [r.term for r in marks if not r.stem]
    count = {r.term: r.toxic for r in marks if not r.stem}
    # a stem is one if its words are many: no single word accounts for most of it
    stems = [r.term for r in marks if r.stem and max([0, *(n for w, n in count.items() if w.startswith(r.term))]) < 0.6 * r.toxic]
    stems = [s for s in stems if not any(s != x and s.startswith(x) for x in stems)]
    words_left = [w for w in all_words if not any(w.startswith(s) for s in stems)]
    return sorted(words_left), sorted(stems)


def fit(rows: list[tuple[float, float, float, int, int]], prior: np.ndarray = PRIOR, strength: float = PRIOR_STRENGTH) -> np.ndarray:
    """Weights of the logistic score from (exact, misspelled, quoted, toxic, documents), held near the prior. Newton's method."""
    w = prior.copy()
    if not rows:
        return w
    r = np.array(rows, float)
    x = np.column_stack([np.ones(len(r)), np.log1p(r[:, :3])])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (r[:, 4] * (r[:, 3] - p)) - strength * (w - prior)
        hessian = (x * (r[:, 4] * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return w


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], list[str], dict[str, float], np.ndarray]:
    """Words, stems, reporting words and weights, from a bounded sample of labelled documents.

    Without labels, or without documents: no terms, and the prior's weights. Null labels, ids and texts teach nothing;
    repeated labels count once. Only doc_id and text of docs, and doc_id and toxic of labels, are read.
    """
    sample = labelled_sample(docs, labels, sample_docs).persist()
    words, stems = learn_lexicon(sample)
    reporting = learn_reporting(sample, words, stems)
    found = sample.select(counts(F.col("text"), words, stems, reporting).alias("c"), "toxic").groupBy(*[F.round(F.least(f"c.{x}", F.lit(50.0)), 2).alias(x) for x in FEATURES], "toxic").count()
    weights = fit([tuple(r) for r in found.collect()])
    sample.unpersist()
    return words, stems, reporting, weights


def score(counted: Column, weights: np.ndarray) -> Column:
    """The logistic score of counted hits, 0 to 1."""
    total = F.lit(float(weights[0]))
    for name, w in zip(FEATURES, weights[1:], strict=True):
        total = total + F.lit(float(w)) * F.log1p(counted[name])
    return 1 / (1 + F.exp(-total))
