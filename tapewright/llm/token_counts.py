"""Token counts that are kept right under edits without encoding the whole text again.

A document's pre-tokens (the pattern's matches) are grouped into leaves of a segment tree that sums their characters and
tokens. The leaves' sums are kept with the document, as a column (`trees`); the inner sums follow from them. An edit's
place is found by walking down the tree; only the leaves that it touches, and a few beside them until an old boundary is
met again, are split and encoded anew (`edited`). Sums are updated on the path to the root. The new leaves come back, for
the next edit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.llm.bpe import Encoder, encoder

#: Pre-tokens in one leaf of the tree, on average.
LEAF = 64
#: A pre-token can depend on the text before it only through its first characters, and on the one after it: so much context.
CONTEXT = 2
LEAVES = "array<struct<chars:int,tokens:int>>"


class CountTree:
    """The segment tree over the leaves (characters, tokens) of one text."""

    def __init__(self, text: str, leaves: list[tuple[int, int]], own: Encoder):
        self.text, self.own, self.encoded = text, own, 0
        self._sum(leaves)

    @classmethod
    def of(cls, text: str, own: Encoder) -> CountTree:
        """The tree of a text that has none yet: all of it is split and encoded."""
        tree = cls(text, [], own)
        tree._sum(tree._leaves(own.split(text)))
        return tree

    def _sum(self, leaves: list[tuple[int, int]]) -> None:
        self.size = max(1, 1 << (max(1, len(leaves)) - 1).bit_length())
        self.chars, self.tokens = ([0] * self.size + [x[i] for x in leaves] + [0] * (self.size - len(leaves)) for i in range(2))
        for i in range(self.size - 1, 0, -1):
            self._pull(i)

    def _leaves(self, pieces: list[str]) -> list[tuple[int, int]]:
        out = []
        for i in range(0, len(pieces), LEAF):
            part = pieces[i : i + LEAF]
            out.append((sum(map(len, part)), sum(map(self.own.counts.__getitem__, part))))
            self.encoded += out[-1][0]
        return out

    def _pull(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    def leaves(self) -> list[tuple[int, int]]:
        return [x for x in zip(self.chars[self.size :], self.tokens[self.size :], strict=True) if x[0]]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf with the character at that place, and the leaf's first place; the end belongs to the leaf of the last character."""
        place, start, i = max(0, min(place, self.chars[1] - 1)), 0, 1
        while i < self.size:
            i *= 2
            if place - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def edit(self, at: int, removed: int, added: str) -> None:
        """Replaces `removed` characters from place `at` by `added`. Places beyond the text's end count as the end.

        A pre-token never depends on what stands before it, and on CONTEXT characters behind it. So the leaves before the
        one with place at - CONTEXT stay, and those behind a leaf whose end is a boundary again.
        """
        at = min(max(at, 0), self.chars[1])
        removed = min(max(removed, 0), self.chars[1] - at)
        first, start = self.leaf_at(at - CONTEXT)
        last, last_start = self.leaf_at(at + removed)
        end = last_start + self.chars[self.size + last]
        while True:
            new = self.text[start:at] + added + self.text[at + removed : end]
            pieces = self.own.split(new + self.text[end : end + CONTEXT])
            place = count = 0
            while count < len(pieces) and place < len(new):
                place += len(pieces[count])
                count += 1
            if place == len(new):
                break
            last = next(i for i in range(last + 1, self.size) if self.chars[self.size + i])
            end += self.chars[self.size + last]
        self.text = self.text[:at] + added + self.text[at + removed :]
        self._put(first, last, self._leaves(pieces[:count]))

    def _put(self, first: int, last: int, new: list[tuple[int, int]]) -> None:
        room = last - first + 1
        if len(new) > room:  # more leaves than there were: the tree is built over the leaves' sums, nothing is encoded
            old = list(zip(self.chars[self.size :], self.tokens[self.size :], strict=True))
            self._sum([x for x in [*old[:first], *new, *old[last + 1 :]] if x[0]])
            return
        for n in range(room):
            i = self.size + first + n
            self.chars[i], self.tokens[i] = new[n] if n < len(new) else (0, 0)
            while i > 1:
                i >>= 1
                self._pull(i)


def _leaf_lists(each: list[list[tuple[int, int]]]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
    sums = np.array([x for own in each for x in own], np.int32).reshape(-1, 2)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["chars", "tokens"]))


def trees(text: Column, ranks_path: str, pattern: str) -> Column:
    """The leaves of each text's tree, array of struct(chars, tokens), to be kept with it. Null and empty texts have none."""
    key = f"counts:{ranks_path}"

    @F.arrow_udf(LEAVES)
    def built(texts: pa.Array) -> pa.Array:
        own = encoder(key, ranks_path, pattern)
        return _leaf_lists([CountTree.of(t or "", own).leaves() for t in texts.to_pylist()])

    return built(text)


def edited(text: Column, leaves: Column, edits: Column, ranks_path: str, pattern: str) -> Column:
    """struct(before, after, text_chars, reencoded_chars, leaves) of each text, its leaves (of trees, or of a call before) and its edits.

    edits: array of struct(at int, removed int, added string), applied one after the other, each to the text as it then
    is (edited_text gives that). Null texts are empty; null edits are none; nulls within an edit are 0 and the empty
    string; leaves that don't sum to the text's length are an error. Only regions round the edits are encoded.
    """
    key = f"counts:{ranks_path}"

    @F.arrow_udf(f"struct<before:bigint,after:bigint,text_chars:bigint,reencoded_chars:bigint,leaves:{LEAVES}>")
    def counts(texts: pa.Array, trees: pa.Array, lists: pa.Array) -> pa.Array:
        own = encoder(key, ranks_path, pattern)
        rows, new = [], []
        for t, leaves, e in zip(texts.to_pylist(), trees.to_pylist(), lists.to_pylist(), strict=True):
            tree = CountTree(t or "", [(x["chars"], x["tokens"]) for x in leaves or ()], own)
            if tree.chars[1] != len(tree.text):
                raise ValueError("the leaves are those of another text")
            before = tree.count
            for x in e or ():
                if x is not None:
                    tree.edit(x["at"] or 0, x["removed"] or 0, x["added"] or "")
            rows.append((before, tree.count, tree.chars[1], tree.encoded))
            new.append(tree.leaves())
        cols = list(zip(*rows, strict=True)) or [()] * 4
        names = ["before", "after", "text_chars", "reencoded_chars", "leaves"]
        return pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in cols], _leaf_lists(new)], names)

    return counts(text, leaves, edits)


def edited_text(text: Column, edits: Column) -> Column:
    """The text after its edits, by Spark functions; places and nulls as in edited."""

    def one(done: Column, x: Column) -> Column:
        n = F.length(done)
        at = F.least(F.greatest(F.coalesce(x["at"], F.lit(0)), F.lit(0)), n)
        rest = F.least(at + F.greatest(F.coalesce(x["removed"], F.lit(0)), F.lit(0)), n)
        return F.concat(F.substring(done, F.lit(1), at), F.coalesce(x["added"], F.lit("")), F.substring(done, rest + 1, n))

    given = F.filter(F.coalesce(edits, F.array().cast("array<struct<at:int,removed:int,added:string>>")), lambda x: x.isNotNull())
    return F.aggregate(given, F.coalesce(text, F.lit("")), one)


def recount(text: str, own: Encoder) -> int:
    """Tokens of a text encoded whole, for checks."""
    return len(own.text(text)) // 4
