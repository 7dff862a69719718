"""Subword lattice likelihood: the probability of a text, summed over all ways to cut its words into known pieces.

The pieces and their scores come from an existing vocabulary, which is never changed. Its scores are the places of the
pieces by merge order; read as Zipf ranks they are the prior, and rounds of expectation over the training words (each
distinct word once, weighted by its count) turn it into piece probabilities. A text's words begin with the vocabulary's
word mark and pieces never go over a word's end, so the marginal probability of a text is the product of its words' and
of the end's. A word's comes from a forward recursion in log space over its characters.

Beside it stands the plain base: word counts of the training texts with 1 added. Counts of the most frequent words are
broadcast (bounded in number and bytes); those of all other words are joined by the word, a row for each document and
word, and no text is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructType

from tapewright.llm.common import mix, written

MARK, END = "▁", b""
#: Bounds of the broadcast words: number, and bytes of their texts.
HEAD_WORDS, HEAD_BYTES = 1 << 17, 4 << 20
#: Distinct words that a task counts before it hands them on, and words that are cut at once.
TASK_WORDS, CUT_WORDS = 200_000, 8192
#: Documents that are handled at once.
SLICE_ROWS = 256
#: Weight of the vocabulary's own scores, as a number of pieces seen.
PRIOR_PIECES = 20_000.0
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Characters of words that are cut at once, if they are more than one word.
_PART_CHARS = 1 << 15
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def read_vocabulary(path: str) -> dict[str, float]:
    """Piece and score of a sentencepiece file, in the order of ids; without control pieces but the end `</s>`."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=path)
    pieces = [(own.id_to_piece(i), own.get_score(i), own.is_control(i) or own.is_unknown(i)) for i in range(own.get_piece_size())]
    return {p: s for p, s, control in pieces if not control or p == "</s>"}


def prior(vocabulary: dict[str, float]) -> np.ndarray:
    """Probabilities of the pieces by their scores alone: 1 / (rank + 2.7); byte pieces and those of no rank count as the last."""
    scores = np.array([math.inf if s <= -1e6 or _BYTE.fullmatch(p) else -s for p, s in vocabulary.items()])
    last = scores[np.isfinite(scores)].max(initial=0.0) + 1
    weights = 1 / (np.where(np.isfinite(scores), scores, last) + 2.7)
    return weights / weights.sum()


class Lattice:
    """All cuts of words into pieces. Characters that are no piece are cut into bytes.

    Words are matrices of characters, many at a time: pieces are found by hashes of all their substrings, and the
    recursions go over the places of all words at once, in log space.
    """

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        self.size = len(pieces)
        self.logs = np.log(np.maximum(probabilities, 1e-300))
        self.bytes = {int(m[1], 16): i for i, p in enumerate(pieces) if (m := _BYTE.fullmatch(p))}
        self.end = pieces.index("</s>")
        plain = [(p, i) for i, p in enumerate(pieces) if i != self.end and not _BYTE.fullmatch(p)]
        self.single = {ord(p): i for p, i in plain if len(p) == 1}
        self.longest = max((len(p) for p, _ in plain), default=1)
        hashes = np.array([_hash(p) for p, _ in plain], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([i for _, i in plain], np.int64)[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have the same hash")
        self.seen = np.zeros(1 << 20, bool)
        self.seen[hashes >> np.uint64(44)] = True

    def _chars(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """Of a matrix of characters: the distinct ones' log probabilities, ids (-1: cut into bytes), each place's number among them, and their bytes."""
        distinct, at = np.unique(chars, return_inverse=True)
        ids = np.array([self.single.get(c, -1) for c in distinct.tolist()], np.int64)
        cuts = [[] if i >= 0 else [self.bytes[b] for b in chr(c).encode("utf-8", "surrogateescape")] for c, i in zip(distinct.tolist(), ids, strict=True)]
        logs = np.array([self.logs[i] if i >= 0 else sum(self.logs[b] for b in cut) for i, cut in zip(ids, cuts, strict=True)])
        return logs, ids, at.reshape(chars.shape), cuts

    def _edges(self, chars: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, flat places (word * width + first character) and ids of the pieces of two characters and more."""
        n, width = chars.shape
        h = chars.astype(np.uint64) + np.uint64(1)
        own = h
        for length in range(2, min(self.longest, width) + 1):
            h = h[:, :-1] * _FACTOR + own[:, length - 1 :]
            mixed = mix(h)
            row, col = np.nonzero(self.seen[mixed >> np.uint64(44)])
            wanted = mixed[row, col]
            found = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            same = self.hashes[found] == wanted
            yield length, row[same] * width + col[same], self.ids[found[same]]

    def _solve(self, words: list[str], times: np.ndarray | None, into: np.ndarray | None) -> np.ndarray:
        lengths = np.array([len(w) for w in words])
        n, width = len(words), int(lengths.max())
        chars = np.zeros((n, width), np.uint32)  # no piece has a zero, so none goes over a word's end
        chars[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        logs, ids, at, cuts = self._chars(chars)
        edges = list(self._edges(chars))
        steps = np.full((min(self.longest, width) + 1, n * width), -np.inf)
        steps[1] = logs[at].ravel()
        for length, place, piece in edges:
            steps[length, place] = self.logs[piece]
        steps = steps.reshape(len(steps), n, width)
        before = np.full((n, width + 1), -np.inf)
        before[:, 0] = 0
        for j in range(1, width + 1):
            k = min(len(steps) - 1, j)
            before[:, j] = _log_sum(np.stack([before[:, j - x] + steps[x, :, j - x] for x in range(1, k + 1)]))
        total = before[np.arange(n), lengths]
        if into is not None:
            after = np.full((n, width + 1), -np.inf)
            after[np.arange(n), lengths] = 0
            for i in range(width - 1, -1, -1):
                k = min(len(steps) - 1, width - i)
                after[:, i] = np.where(lengths > i, _log_sum(np.stack([after[:, i + x] + steps[x, :, i] for x in range(1, k + 1)])), after[:, i])
            rest = before[:, :width] - total[:, None]
            share = np.where(np.arange(width) < lengths[:, None], times[:, None] * np.exp(rest + steps[1] + after[:, 1:]), 0.0)
            for c, weight in enumerate(np.bincount(at.ravel(), share.ravel(), len(ids))):
                for i in [ids[c]] if ids[c] >= 0 else cuts[c]:
                    into[i] += weight
            for length, place, piece in edges:
                row, col = np.divmod(place, width)
                into += np.bincount(piece, times[row] * np.exp(rest[row, col] + self.logs[piece] + after[row, col + length]), self.size)
        return total

    def _parts(self, words: list[str]) -> Iterator[np.ndarray]:
        """Words of about the same length together, with a bound on their characters."""
        order = np.argsort([len(w) for w in words], kind="stable")
        part: list[int] = []
        for k in order.tolist():
            if part and (len(part) + 1) * len(words[k]) > _PART_CHARS:
                yield np.array(part)
                part = []
            part.append(k)
        if part:
            yield np.array(part)

    def forward(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word (with its mark), over all its cuts."""
        out = np.zeros(len(words))
        for part in self._parts(words):
            out[part] = self._solve([words[k] for k in part], None, None)
        return out

    def expected(self, words: list[str], times: np.ndarray, into: np.ndarray) -> None:
        """Adds how often each piece stands in the cuts of the words, each seen so many times, weighted by the cuts' probabilities."""
        for part in self._parts(words):
            self._solve([words[k] for k in part], times[part], into)


def _hash(piece: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in piece:
        h = h * _FACTOR + np.uint64(ord(c) + 1)
    return mix(h)[0]


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exp over the first axis; -inf where all are."""
    most = x.max(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(most > -np.inf, most + np.log(np.exp(x - most).sum(0)), -np.inf)


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text in lower case (A-Z only): what stands between ASCII white space."""
    return text.lower().split() if text else []


def marked(word: bytes) -> str:
    """A word as the lattice takes it: with the mark before it. A mark inside is no boundary, and is cut into bytes."""
    text = word.decode("utf-8", "surrogateescape")
    return MARK + (text if MARK not in text else text.replace(MARK, "".join(chr(0xDC00 + b) for b in MARK.encode())))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE_ROWS):
            yield whole.slice(at, SLICE_ROWS)


def word_counts(docs: DataFrame, learned: Column) -> DataFrame:
    """word (binary), n and train: how often each word stands in all texts, and in those that are learned from. The end is the empty word. Tasks count first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {True: Counter(), False: Counter()}

        def rows(train: bool) -> pa.RecordBatch:
            words, n = list(counts[train]), list(counts[train].values())
            counts[train].clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(n if train else [0] * len(n), pa.int64())], ["word", "n", "train"])

        for batch in _slices(batches):
            for text, train in zip(pc.cast(batch.column(0), pa.binary()), batch.column(1).to_pylist(), strict=True):
                counts[train].update(words_of(text.as_py()))
                counts[train][END] += 1
                if len(counts[train]) > TASK_WORDS:
                    yield rows(train)
        yield from map(rows, (True, False))

    flags = docs.select(F.col("text").alias("t"), F.coalesce(learned, F.lit(False)).alias("train"))
    return flags.mapInArrow(count, "word binary, n long, train long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("train").alias("train"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], pa.Table]]:
    """Batches of counted words put together to about CUT_WORDS, and their words."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CUT_WORDS:
            yield (t := pa.Table.from_batches(held)).column("word").to_pylist(), t
            held = []
    if held:
        yield (t := pa.Table.from_batches(held)).column("word").to_pylist(), t


def word_scores(counts: DataFrame, vocabulary: dict[str, float], probabilities: np.ndarray) -> DataFrame:
    """counts with `log`, the natural log probability of each word over all its cuts; each distinct word is cut once."""
    sent = counts.sparkSession.sparkContext.broadcast((list(vocabulary), probabilities))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*sent.value)
        for words, columns in _gathered(batches):
            logs = np.full(len(words), own.logs[own.end])
            full = np.array([w != END for w in words], bool)
            logs[full] = own.forward([marked(w) for w in words if w != END])
            yield from columns.append_column("log", pa.array(logs)).combine_chunks().to_batches()

    return counts.mapInArrow(cut, StructType([*counts.schema.fields]).add("log", DoubleType()))


def expected_pieces(counts: DataFrame, vocabulary: dict[str, float], probabilities: np.ndarray) -> np.ndarray:
    """Expected number of each piece in the training words, by the probabilities so far. A row for each piece and task comes together."""
    pieces = list(vocabulary)
    sent = counts.sparkSession.sparkContext.broadcast((pieces, probabilities))  # as large as the vocabulary

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, into = Lattice(*sent.value), np.zeros(len(pieces))
        for words, columns in _gathered(batches):
            n = np.asarray(columns.column("train"), float)
            full = np.array([w != END for w in words], bool)
            into[own.end] += n[~full].sum()
            own.expected([marked(w) for w in words if w != END], n[full], into)
        at = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(into[at])], ["piece", "n"])

    rows = counts.where("train > 0").select("word", "train").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(pieces))
    out[np.asarray(rows.column("piece"))] = np.asarray(rows.column("n"))
    return out


@dataclass
class Model:
    """words (word, n, train, log) of the whole corpus, the totals of those learned from, and the frequent words' train and log for tasks."""

    words: DataFrame
    tokens: int
    distinct: int
    sent: Broadcast


def head_words(counts: DataFrame, most: int = HEAD_WORDS, most_bytes: int = HEAD_BYTES) -> DataFrame:
    """The most frequent words, within both bounds: all above the limit that a histogram of their frequencies gives."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).collect()
    limit, words, size = None, 0, 0
    for r in sorted(levels, key=lambda r: -r.level):
        words, size = words + r.words, size + r.bytes
        if words > most or size > most_bytes:
            break
        limit = r.level
    return counts.where(level >= limit) if limit is not None else counts.limit(0)


def learn(docs: DataFrame, learned: Column, vocabulary: dict[str, float], rounds: int = 2, head: int = HEAD_WORDS) -> Model:
    """Counts and piece probabilities of the rows of docs (text) for which `learned` is true. Null texts are empty, and have their end; nothing learned leaves the prior."""
    counts = written(word_counts(docs, learned))
    total = counts.agg(F.sum("train").alias("tokens"), F.count(F.when(F.col("train") > 0, 1)).alias("distinct")).first()
    first = prior(vocabulary)
    probabilities = first
    for _ in range(rounds):
        weights = expected_pieces(counts, vocabulary, probabilities) + PRIOR_PIECES * first
        probabilities = weights / weights.sum()
    words = word_scores(counts, vocabulary, probabilities)
    rows = word_scores(head_words(counts, head), vocabulary, probabilities).toArrow()
    known = {w: (math.log10(n + 1), n > 0, log) for w, n, log in zip(*[rows.column(c).to_pylist() for c in ("word", "train", "log")], strict=True)}
    return Model(words, total.tokens or 0, total.distinct, docs.sparkSession.sparkContext.broadcast(known))


def text_sums(text: bytes | None, known: dict[bytes, tuple[float, bool, float]]) -> tuple[int, int, float, float, list[tuple[bytes, int]]]:
    """Tokens, known ones of the head, their sum of log10(count + 1), their natural log probability, and the other words with their number."""
    words = Counter(words_of(text))
    words[END] = 1
    seen, base, score, rest = 0, 0.0, 0.0, []
    for w, n in words.items():
        if (found := known.get(w)) is None:
            rest.append((w, n))
        else:
            base += n * found[0]
            seen += n * found[1]
            score += n * found[2]
    return words.total(), seen, base, score, rest


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with n_tokens, n_known, train_tokens, base_score and score (log10). Every row stays, repeated rows too.

    An empty or null text is its end alone. Columns of docs with the names of results are left out. With nothing learned
    every count is 0, so the base of a token is log10(1 / 1).
    """
    sent = model.sent
    names = [c for c in keep if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    own = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("_text"))
    rest_kind = ArrayType(StructType().add("word", BinaryType()).add("n", LongType()))
    schema = StructType([own.schema[c] for c in names]).add("n_tokens", LongType()).add("_known", LongType()).add("_base", DoubleType()).add("_log", DoubleType()).add("_rest", rest_kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent.value
        for batch in _slices(batches):
            tokens, known, base, scores, rest = zip(*[text_sums(t.as_py(), head) for t in pc.cast(batch.column(len(names)), pa.binary())], strict=True)
            ends = np.concatenate(([0], np.cumsum([len(r) for r in rest]))).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array([w for r in rest for w, _ in r], pa.binary()), pa.array([n for r in rest for _, n in r], pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(ends), pairs)], [*names, "n_tokens", "_known", "_base", "_log", "_rest"])

    # numbered where it is written, so that the numbers hold when tasks are run again
    done = written(own.mapInArrow(rows, schema).withColumn("_row", F.monotonically_increasing_id()))
    rest = done.select("_row", F.explode("_rest").alias("r")).select("_row", "r.word", F.col("r.n").alias("times")).join(model.words, "word")
    sums = {"_more": F.sum(F.col("times") * F.log10(F.col("train") + 1)), "_also": F.sum(F.when(F.col("train") > 0, F.col("times")).otherwise(0)), "_add": F.sum(F.col("times") * F.col("log"))}
    added = rest.groupBy("_row").agg(*[v.alias(k) for k, v in sums.items()])
    total = math.log10(model.tokens + 1 * (model.distinct + 1))
    base = F.col("_base") + F.coalesce("_more", F.lit(0.0)) - F.col("n_tokens") * total
    known = F.col("_known") + F.coalesce("_also", F.lit(0))
    log = (F.col("_log") + F.coalesce("_add", F.lit(0.0))) / math.log(10)
    return done.drop("_rest").join(added, "_row", "left").select(*[F.col(f"`{c}`") for c in names], "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), log.alias("score"))
