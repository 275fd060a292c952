"""Vector bin packing of tokenised documents into training sequences.

A piece of a document is a vector of three demands: tokens, segments (one) and loss-bearing tokens. A sequence is
a bin with a limit on each. The dot-product heuristic fills one bin at a time with the piece whose demands, as
shares of the limits, have the largest dot product with the room that is left. A document longer than a sequence
gives pieces as large as the limits allow; a piece that no longer fits whole may be cut to close a gap, and the last segment
of a sequence is the piece that closes it best. Each task packs the rows of its own partition from a pool of bounded size,
so nothing is shuffled and no group can grow without bound.

Instruction data bear loss only after the prompt: a document's first ids, by a column or as a share of its ids. A sequence
whose loss limit is reached goes on with prompts.

A sequence that the limit on segments or on loss ends early, as among very short texts, is cut to the largest power of two that
its tokens fill, which needs no padding; so is the rest at the end of a partition.

Defined results: a null text counts as empty, and an empty text still gives its end id, a piece of one token;
repeated rows (and equal doc_ids) are packed once each; an empty table gives an empty table.
Texts of any length are cut into pieces; of pieces that match alike the one that is first in the pool is taken; further
columns aren't looked at.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewatch.llm import bpe
from ratewatch.llm.common import text_slices

#: Fixed value: pre-tokens as the vocabulary's public description gives them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A sequence may be padded by one token in so many; a shorter one gets the size of a power of two.
PADDING = 64
#: Longer texts go through this library's own encoder, which has no recursion in its pre-tokens.
LONG_TEXT = 400_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.int64)


class Ids:
    """Ids of texts as the tokenizers library gives them, through a faster reader of the same vocabulary."""

    def __init__(self, tokenizer_json: str):
        import tiktoken

        own = bpe.load(tokenizer_json)
        added = {x["id"] for x in json.loads(tokenizer_json).get("added_tokens", [])}
        self.exact = own
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in own.bytes_of.items() if i not in added}, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> np.ndarray:
        if len(text) > LONG_TEXT:
            return np.frombuffer(self.exact.encode([text])[0], "<u4")
        if any(s in text for s in self.exact.special):
            parts = [np.frombuffer(self.exact.special[p], "<u4") if p in self.exact.special else self(p) for p in self.exact.split_special(text)]
            return np.concatenate(parts)
        return np.array(self.encode(text), "<u4")


_ids: dict[int, Ids] = {}


class Pool:
    """Pieces that wait for a place. ``take`` fills one bin."""

    def __init__(self, limits: Limits, least_cut: int):
        self.limits, self.least_cut = limits, least_cut
        self.items: list[tuple] = []  # key, start, ids, document's tokens, first token with loss
        self.demand = np.empty((1024, 3), np.int64)

    def __len__(self) -> int:
        return len(self.items)

    def _vector(self, item: tuple) -> tuple[int, int, int]:
        _, start, ids, _, loss_from = item
        return len(ids), 1, len(ids) - min(len(ids), max(0, loss_from - start))

    def add(self, item: tuple) -> None:
        n = len(self.items)
        if n == len(self.demand):
            self.demand = np.concatenate([self.demand, np.empty_like(self.demand)])
        self.items.append(item)
        self.demand[n] = self._vector(item)

    def _remove(self, i: int) -> tuple:
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.demand[i] = self.demand[len(self.items)]
        return item

    def tokens(self) -> int:
        return int(self.demand[: len(self.items), 0].sum())

    def loss_only(self) -> bool:
        """Whether no piece has an id without loss, so that sequences can't be longer than the loss limit."""
        demand = self.demand[: len(self.items)]
        return bool((demand[:, 0] == demand[:, 2]).all())

    def take(self, tokens: int, least_cut: int) -> list[tuple]:
        """The pieces of one sequence of at most so many tokens."""
        full = self.limits.vector()
        room, chosen = np.array([tokens, full[1], full[2]], np.int64), []
        weight = 1.0 / (full * full)
        while self.items and room[0] > 0 and room[1] > 0:
            demand = self.demand[: len(self.items)]
            score = demand @ (room * weight)
            fits = (demand <= room).all(axis=1)
            part = np.minimum(np.minimum(demand[:, 0], room[0]), room[2] + demand[:, 0] - demand[:, 2])  # what of each could go in: prompts come first
            if room[1] > 1 and fits.any():
                i = int(np.where(fits, score, -1).argmax())
            elif room[1] == 1:
                i = int(np.where(part == part.max(), score, -1).argmax())
            else:  # no piece fits whole: cut the one that matches best
                i = int(np.where(part >= least_cut, score, -1).argmax())
            n = int(part[i])
            if n < (1 if fits[i] else least_cut):
                break
            key, start, ids, total, loss_from = self._remove(i)
            if n < len(ids):
                self.add((key, start + n, ids[n:], total, loss_from))
            chosen.append((key, start, ids[:n], total, loss_from))
            room -= self._vector(chosen[-1])
        return self._trimmed(chosen, tokens)

    def _trimmed(self, chosen: list[tuple], tokens: int) -> list[tuple]:
        """Where a limit ends a sequence well before its size, as many tokens as the largest power of two; the rest waits again."""
        total = sum(len(item[2]) for item in chosen)
        if not total or PADDING * (tokens - total) <= tokens:
            return chosen
        over = total - (1 << (total.bit_length() - 1))
        while over:
            key, start, ids, whole, loss_from = chosen.pop()
            n = max(0, len(ids) - over)
            over -= len(ids) - n
            self.add((key, start + n, ids[n:], whole, loss_from))
            if n:
                chosen.append((key, start, ids[:n], whole, loss_from))
        return chosen


def pack_documents(docs: DataFrame, vocabulary_path: str, limits: Limits = Limits(), end_id: int = 1, pool: int = 512, least_cut: int = 16, key: str = "doc_id", text: str = "text", loss_from: str | None = None, prompt_share: float = 0.0) -> DataFrame:
    """One row a piece: ``key, start, length, ids, doc_tokens, loss_tokens, sequence_id, offset``.

    ``loss_from`` names a column with the number of leading ids of a document that bear no loss (null: ``prompt_share`` of
    its ids, rounded down).
    A sequence's id holds the partition that made it, so ids are unique without any exchange.
    """
    if limits.tokens < 1 or limits.segments < 1 or limits.loss_tokens < 1:
        raise ValueError("limits have to be 1 or more")
    shipped = bpe.vocabulary(docs.sparkSession, vocabulary_path)
    kind = docs.schema[key].dataType
    schema = f"key {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"

    def run(batches):
        made = _ids.get(hash(shipped.value)) or _ids.setdefault(hash(shipped.value), Ids(shipped.value))
        waiting, rows, keys = Pool(limits, least_cut), [], None
        sequence = TaskContext.get().partitionId() << 40
        whole = min(limits.tokens, limits.loss_tokens)

        def place(chosen):
            nonlocal sequence
            at = 0
            for item in chosen:
                rows.append((item[0], item[1], len(item[2]), item[2].tobytes(), item[3], waiting._vector(item)[2], sequence, at))
                at += len(item[2])
            sequence += 1

        def flush():
            columns = list(zip(*rows))
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], keys), *(pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(columns[1:]))], ["key", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        for batch in batches:
            keys = batch.column("key").type
            for part, texts in text_slices(batch):
                starts = part.column("loss_from").to_pylist()
                for k, words, free in zip(part.column("key").to_pylist(), texts, starts):
                    ids = np.append(made(words), np.uint32(end_id)).astype("<u4")
                    free = min(len(ids), max(0, int(prompt_share * len(ids)) if free is None else free))
                    if len(ids) <= whole:
                        waiting.add((k, 0, ids, len(ids), free))
                    else:  # prompts in quarters, as they have to fill what the loss limit leaves
                        cuts = [*range(0, free, max(1, whole // 4)), *range(free, len(ids), whole), len(ids)]
                        for s, e in zip(cuts, cuts[1:]):
                            waiting.add((k, s, ids[s:e], len(ids), free))
                            while len(waiting) >= pool:
                                place(waiting.take(limits.tokens, least_cut))
                    while len(waiting) >= pool:
                        place(waiting.take(limits.tokens, least_cut))
                if len(rows) >= 1000:
                    yield flush()
        while len(waiting):
            most = min(waiting.tokens(), limits.tokens)
            if waiting.loss_only():
                most = min(most, limits.loss_tokens)
            place(waiting.take(most if most == limits.tokens else 1 << (most.bit_length() - 1), 1))
        if rows:
            yield flush()

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), (docs[loss_from].cast("long") if loss_from else F.lit(None).cast("long")).alias("loss_from"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
