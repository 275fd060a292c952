"""Token counts that follow edits without encoding a document again.

A document's pre-tokens are the leaves of a tree whose nodes hold characters and tokens below them. An edit finds its
leaves by descending through the sums, splits only the touched text into pre-tokens again, from two pre-tokens before it
until a border of the new text falls on an old one after it, and updates the sums on the way to the root. A pre-token's
end hangs on what follows it by one character, or on the end of its run of white space; hence the two before, and the two
complete pre-tokens that must follow a border before it counts.

Defined results: a null text counts as empty; edits are applied one after another, each to what the last one left; an
edit beyond the end is cut to it, and one with a null bound or text changes nothing; rows are counted each on their own,
so repeated rows and further columns don't matter; an empty table gives an empty table. Special tokens' names are
ordinary text here.
Texts of any length are one tree each; nothing is chosen, so there are no ties.
"""

from __future__ import annotations

from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ratewatch.llm import bpe
from ratewatch.llm.common import text_slices

LEAF, FAN = 64, 16
#: Words in the encoder's cache: edits bring many that are rare, and would push out those that come again.
CACHED = 150_000


class TokenTree:
    def __init__(self, pieces: list[str], encoder: bpe.ByteBPE):
        self.encoder = encoder
        self._build(pieces)

    def _build(self, pieces: list[str]) -> None:
        self.touched: set[int] = set()  # leaves whose tokens are still to be counted
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        sums = np.array([self._sum(x) for x in self.leaves], np.int64)
        self.levels = [sums]  # (characters, tokens) of each node; the last level is the root
        while len(sums) > 1:
            sums = np.add.reduceat(sums, np.arange(0, len(sums), FAN), axis=0)
            self.levels.append(sums)

    def _sum(self, pieces: list[str]) -> tuple[int, int]:
        return len("".join(pieces)), self._count(pieces)

    def _count(self, pieces: list[str]) -> int:
        return len(b"".join(map(self.encoder.pieces.__getitem__, pieces))) // 4

    @property
    def chars(self) -> int:
        return int(self.levels[-1][0, 0])

    @property
    def tokens(self) -> int:
        self.settle()
        return int(self.levels[-1][0, 1])

    def unknown(self) -> set[str]:
        """Pre-tokens that came with edits and that the encoder has to learn."""
        known = self.encoder.pieces
        return {p for i in self.touched for p in self.leaves[i] if p not in known}

    def settle(self) -> None:
        """Count the tokens of touched leaves and bring their sums up to the root."""
        if self.touched:
            if new := self.unknown():
                self.encoder.know(new)
            for leaf in self.touched:
                self._set(leaf, 1, self._count(self.leaves[leaf]))
            self.touched = set()

    def text(self) -> str:
        return "".join(chain.from_iterable(self.leaves))

    def find(self, at: int) -> tuple[int, int, int]:
        """Leaf and pre-token that hold character ``at`` (the last ones at the end), and where that pre-token begins."""
        node, begin = 0, 0
        for level in reversed(self.levels[:-1]):
            child, end = node * FAN, min(len(level), (node + 1) * FAN)
            ends = level[child:end, 0].cumsum()
            i = min(int(np.searchsorted(ends, at - begin, side="right")), end - child - 1)
            while i and not level[child + i, 0]:  # at the end: the last node that has text
                i -= 1
            begin += int(ends[i - 1]) if i else 0
            node = child + i
        pieces = self.leaves[node]
        for i, p in enumerate(pieces):
            if at < begin + len(p) or i == len(pieces) - 1:
                return node, i, begin
            begin += len(p)
        return node, 0, begin

    def _before(self, leaf: int, piece: int) -> tuple[int, int] | None:
        if piece:
            return leaf, piece - 1
        while leaf:
            leaf -= 1
            if self.leaves[leaf]:
                return leaf, len(self.leaves[leaf]) - 1
        return None

    def _set(self, leaf: int, column: int, value: int) -> None:
        change = value - int(self.levels[0][leaf, column])
        for level in self.levels:
            level[leaf, column] += change
            leaf //= FAN

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace characters start to stop; returns how many characters were split and encoded again."""
        start = max(0, min(start, self.chars))
        stop = max(start, min(stop, self.chars))
        if start == stop and not new:
            return 0
        leaf, piece, begin = self.find(start)
        for _ in range(2):
            if before := self._before(leaf, piece):
                leaf, piece = before
                begin -= len(self.leaves[leaf][piece])
        last, at, old = self.find(stop)
        head = [leaf, piece]
        lead = "".join(self._between(head, begin, start))
        tail_leaf, tail_piece, skipped = last, at, stop - old
        ahead = 8
        while True:
            rest, ends, position = self._ahead(tail_leaf, tail_piece, skipped, ahead)
            text = lead + new + rest
            pieces = self.encoder.pre_tokens(text)
            done = position is None
            borders = np.cumsum([len(p) for p in pieces]).tolist()
            shift = len(lead) + len(new)
            old_borders = {shift + e: where for e, where in ends}
            usable = len(borders) - (0 if done else 2)
            hit = next((i for i, b in enumerate(borders[: max(0, usable)]) if b >= shift and b in old_borders), None)
            if hit is not None or done:
                break
            ahead *= 4
        kept = pieces if hit is None else pieces[: hit + 1]
        to_leaf, to_piece = (len(self.leaves) - 1, len(self.leaves[-1])) if hit is None else old_borders[borders[hit]]
        if leaf == to_leaf:
            self.leaves[leaf] = self.leaves[leaf][:piece] + kept + self.leaves[leaf][to_piece:]
        else:
            self.leaves[leaf] = self.leaves[leaf][:piece] + kept
            for i in range(leaf + 1, to_leaf):
                self.leaves[i] = []
            self.leaves[to_leaf] = self.leaves[to_leaf][to_piece:]
        for i in range(leaf, to_leaf + 1):
            self._set(i, 0, sum(map(len, self.leaves[i])))
            self.touched.add(i)
        if len(self.leaves[leaf]) > 16 * LEAF:
            self.settle()
            self._build(list(chain.from_iterable(self.leaves)))
        return sum(map(len, kept))

    def _between(self, head: list[int], begin: int, start: int):
        """Text from the pre-token at ``head``, which begins at ``begin``, up to character ``start``."""
        leaf, piece = head
        while begin < start:
            pieces = self.leaves[leaf]
            while piece < len(pieces) and begin < start:
                p = pieces[piece][: start - begin]
                begin += len(p)
                piece += 1
                yield p
            leaf, piece = leaf + 1, 0

    def _ahead(self, leaf: int, piece: int, skip: int, n: int) -> tuple[str, list[tuple[int, tuple[int, int]]], tuple[int, int] | None]:
        """Text of n pre-tokens from here without its first ``skip`` characters; where each ends; null at the end of all."""
        out, ends, size = [], [], 0
        while leaf < len(self.leaves):
            pieces = self.leaves[leaf]
            while piece < len(pieces):
                if n == 0:
                    return "".join(out), ends, (leaf, piece)
                p = pieces[piece][skip:]
                skip, n, piece = 0, n - 1, piece + 1
                out.append(p)
                size += len(p)
                ends.append((size, (leaf, piece)))
            leaf, piece = leaf + 1, 0
        return "".join(out), ends, None


def count_edits(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """``key, n_tokens, edited_text, edited_tokens, encoded_again`` of each row.

    ``edits`` is an array of structs (start, stop, text) of code points. ``encoded_again``: characters split anew.
    """
    shipped = bpe.vocabulary(docs.sparkSession, vocabulary_path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder = bpe.load(shipped.value, special=False, max_cached=CACHED)
        for batch in batches:
            for part, texts in text_slices(batch, chars=500_000):
                encoder.trim()
                split = [encoder.pre_tokens(t) for t in texts]
                encoder.know(set(filterfalse(encoder.pieces.__contains__, chain.from_iterable(split))))
                trees = [TokenTree(pieces, encoder) for pieces in split]
                before = [tree.tokens for tree in trees]
                again = [sum(tree.edit(c["start"], c["stop"], c["text"]) for c in changes or [] if c and None not in (c["start"], c["stop"], c["text"])) for tree, changes in zip(trees, part.column("edits").to_pylist())]
                encoder.know(set().union(*(tree.unknown() for tree in trees)))  # the edits' new words, learned together
                after, edited = [tree.tokens for tree in trees], [tree.text() for tree in trees]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(before, pa.int64()), pa.array(edited, pa.string()), pa.array(after, pa.int64()), pa.array(again, pa.int64())], ["key", "n_tokens", "edited_text", "edited_tokens", "encoded_again"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[edits].alias("edits")).mapInArrow(run, f"key {kind}, n_tokens long, edited_text string, edited_tokens long, encoded_again long").withColumnRenamed("key", key)
