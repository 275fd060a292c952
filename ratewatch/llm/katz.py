"""Katz backoff n-gram scores, learned from and applied to a whole corpus.

    P(w | h) = d(r) r / c(h)              if the n-gram h w was seen r times in training,
    P(w | h) = alpha(h) P(w | h')         else, with h' the context without its first word,

down to single words, where d(r) r / N is the chance of a word and what the discounts leave over that of an unknown one.
d is Good-Turing's discount for counts up to 5 (Katz's formula); larger counts lose as much as a count of 5 does, so that
every context keeps something for other words. alpha(h) makes the chances after h sum to one over the vocabulary and the
unknown word. A context that training never saw passes straight on to the shorter one.

The model never sits in one place. Documents are read once into blocks: the distinct words of some million tokens and the
tokens as numbers into them. A block asks for what it needs, each distinct n-gram or context once, at the bucket of the
key's leading bits, and gets its answers back, in the order of its sorted keys. Buckets hold a bounded share each, as their
number follows the input without a limit. A question is a row for each block and bucket: their number grows with the square
of the input while their bytes grow with it, so blocks have to grow, too, for corpora of some 100 billion tokens and more.
Keys are hashes: of words all 64 bits, of longer n-grams a bucket's number and 40 more bits, which tell them apart (of the two million keys
of a bucket one in 500,000 shares its bits with another). Backoff weights travel with ten digits.

Defined results: a null text counts as empty and has one token, its end; a null doc_id is not held out; repeated rows are
scored each, and count in training each; without training text every probability is 1; an empty table gives an empty table.
Texts of any length are scored whole; nothing is chosen, so there are no ties; further columns aren't looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewatch.llm.common import LOWER, UPPER, cut, sweep, text_slices

#: Tokens of a block, about.
BLOCK_TOKENS = 1_500_000
#: Tokens of the corpus for each bucket, about.
BUCKET_TOKENS = 2_000_000
#: Counts up to this are discounted by Good-Turing's formula.
GT_UP_TO = 5
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Hashes of what is no word: a document's end, and what stands before its first token.
END, BEFORE = np.uint64(xxhash.xxh64_intdigest(b"\n end")), np.uint64(xxhash.xxh64_intdigest(b"\n before"))
_codec = pa.Codec("zstd", compression_level=1)


def squeeze(x: np.ndarray) -> bytes:
    """An array as bytes: first all first bytes of its numbers, then all second ones, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
    return len(x).to_bytes(8, "little") + (_codec.compress(planes, asbytes=True) if planes else b"")


def expand(data: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.empty(0, dtype)
    planes = np.frombuffer(_codec.decompress(data[8:], n * size), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


class _Numbers(dict):
    """Numbers new words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


# -- blocks


BLOCK = "block long, trained long, keys array<{kind}>, train binary, lengths binary, words binary, tokens binary"


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", train: Column | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents in blocks: keys, whether they train, how many tokens each has; distinct words' hashes; tokens."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), (F.lit(True) if train is None else train).alias("train"))

    def run(batches):
        number, keys, trains, tokens, total, block = _Numbers(), [], [], [], 0, TaskContext.get().partitionId() << 24
        kind_of = None

        def flush():
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
            lengths = np.fromiter(map(len, tokens), np.int32, len(tokens)) + 1
            flat = np.concatenate([x for t in tokens for x in (t, [len(hashes)])]).astype(np.int32)
            hashes = np.append(hashes, END)
            uses = np.bincount(flat, minlength=len(hashes))
            order = np.argsort(-uses, kind="stable")  # frequent words get small numbers, which compress well
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sum(trains)], pa.int64()), pa.array([keys], pa.list_(kind_of)), *(pa.array([x], pa.binary()) for x in (np.array(trains, np.uint8).tobytes(), squeeze(lengths), squeeze(hashes[order]), squeeze(rank[flat])))], ["block", "trained", "keys", "train", "lengths", "words", "tokens"])

        for batch in batches:
            kind_of = batch.column("key").type
            for part, texts in text_slices(batch):
                for k, words, on in zip(part.column("key").to_pylist(), texts, part.column("train").to_pylist()):
                    found = words.encode("utf-8", "replace").translate(_TO_LOWER).split()
                    keys.append(k)
                    trains.append(bool(on))
                    tokens.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                    total += len(found) + 1
                    if total >= block_tokens:
                        yield flush()
                        number, keys, trains, tokens, total, block = _Numbers(), [], [], [], 0, block + 1
        if keys:
            yield flush()

    return rows.mapInArrow(run, BLOCK.format(kind=kind))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Block:
    """A block's tokens, and the keys of n-grams and contexts at each of them."""

    def __init__(self, train: bytes, lengths: bytes, words: bytes, tokens: bytes):
        self.train_docs = np.frombuffer(train, np.uint8).astype(bool)
        self.lengths = expand(lengths, np.int32).astype(np.int64)
        self.word = expand(words, np.uint64)[expand(tokens, np.int32)]
        self.begins = self.lengths.cumsum() - self.lengths
        self.train = np.repeat(self.train_docs, self.lengths)

    def before(self, x: np.ndarray, first) -> np.ndarray:
        """The value at the token before; ``first`` at the first token of a document."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.begins] = first
        return out

    def grams(self, level: int) -> np.ndarray:
        return self.word if level == 1 else _mix(self.contexts(level) * np.uint64(0x9E3779B97F4A7C15) ^ self.word)

    def contexts(self, level: int) -> np.ndarray:
        return self.before(self.grams(level - 1), BEFORE + np.uint64(level))


#: Bits that tell the keys of longer n-grams in a bucket apart. Words have all their bits.
KEY_BITS = 40


def _cut_off(level: int, bits: int) -> int:
    """How many bits the keys of n-grams of a level go without."""
    return 0 if level == 1 else max(0, 64 - KEY_BITS - bits)


def _sorted(keys: np.ndarray, bits: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, without what is cut off, and where each of the given ones is among them."""
    return np.unique(keys >> np.uint64(_cut_off(level, bits)), return_inverse=True)


def _slices(keys: np.ndarray, bits: int, level: int):
    """Bucket, and the slice of the sorted keys in it."""
    low = np.uint64(64 - bits - _cut_off(level, bits))
    buckets = (keys >> low).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(keys) else []
    for s, e in zip(starts, [*starts[1:], len(keys)]):
        yield int(buckets[s]), slice(s, e)


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys of a bucket, each as its distance from the one before, which needs fewer bytes."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


def _short(x: np.ndarray) -> bytes:
    """Floats without their last 16 bits (10 digits stay), whose places compress to nothing."""
    return squeeze((x.view(np.uint64) & np.uint64(0xFFFFFFFFFFFF0000)).view(np.float64))


# -- questions and answers


ASK = "what string, bucket int, block long, keys binary, n binary, lost binary, lower binary, need binary"
ANSWER = "what string, bucket int, block long, payload binary, stats array<long>"


def _ask(what, bucket, block, keys, n=None, lost=None, lower=None, need=None) -> pa.RecordBatch:
    values = (keys, n, lost, lower, need)
    return pa.RecordBatch.from_arrays([pa.array([what]), pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], ["what", "bucket", "block", "keys", "n", "lost", "lower", "need"])


def _each(batch: pa.RecordBatch):
    for row in batch.to_pylist():
        yield row, Block(row["train"], row["lengths"], row["words"], row["tokens"])


def ask_counts(table: DataFrame, order: int, bits: int) -> DataFrame:
    """Each block's distinct n-grams of every order: how often in its training documents, times 2, and 1 more if in others too."""

    def run(batches):
        for batch in batches:
            for row, block in _each(batch):
                for level in range(1, order + 1):
                    keys, at = _sorted(block.grams(level), bits, level)
                    n, others = (np.bincount(at[on], minlength=len(keys)) for on in (block.train, ~block.train))
                    n = (2 * n + (others > 0)).astype(np.uint32)
                    for bucket, s in _slices(keys, bits, level):
                        yield _ask(f"gram {level}", bucket, row["block"], _steps(keys[s]), squeeze(n[s]))

    return table.mapInArrow(run, ASK)


def answer_counts(asked: DataFrame) -> DataFrame:
    """The count of each n-gram over all blocks, times 2, and 1 more if any document has it that isn't learned from.

    A row without a block has the bucket's counts of counts.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_keys(k) for k in rows["keys"]]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        said = np.concatenate([expand(x, np.uint32) for x in rows["n"]])
        n, others = np.bincount(at, said >> 1, len(keys)).astype(np.int64), np.bincount(at, said & 1, len(keys)) > 0
        known = n[n > 0]
        n = (2 * n + others).astype(np.uint32)
        stats = [*np.bincount(np.minimum(known, GT_UP_TO + 2), minlength=GT_UP_TO + 3)[1 : GT_UP_TO + 2].tolist(), len(known), int(known.sum(dtype=np.int64))]
        ends = np.cumsum([len(p) for p in parts])
        payload = [squeeze(x) for x in np.split(n[at], ends[:-1])]
        out = pd.DataFrame({"what": rows["what"], "bucket": rows["bucket"], "block": rows["block"], "payload": payload, "stats": None})
        return pd.concat([out, pd.DataFrame({"what": rows["what"].iloc[:1], "bucket": rows["bucket"].iloc[:1], "block": [None], "payload": [None], "stats": [stats]})], ignore_index=True)

    return asked.groupBy("what", "bucket").applyInPandas(run, ANSWER)


@dataclass(frozen=True)
class Level:
    """Counts of counts of one order, and what follows from them."""

    counts: tuple[int, ...]  # n-grams seen once, twice, ...
    types: int
    tokens: int

    def lost(self) -> np.ndarray:
        """What counts of 0, 1, ... lose to discounting; larger ones lose as much as the last."""
        n = self.counts
        for top in range(GT_UP_TO, 0, -1):
            if min(n[: top + 1], default=0) <= 0:
                continue
            far = (top + 1) * n[top] / n[0]
            if far >= 1:
                continue
            share = [((r + 1) * n[r] / n[r - 1] / r - far) / (1 - far) for r in range(1, top + 1)]
            if all(0 < d < 1 for d in share):
                return np.array([0.0, *(r * (1 - d) for r, d in enumerate(share, 1))])
        return np.array([0.0, 0.5])  # too few n-grams for the formula

    def left(self) -> float:
        """What all n-grams of this order lose."""
        lost = self.lost()
        exact = [self.counts[r - 1] if r <= len(self.counts) else 0 for r in range(1, len(lost))]
        return float(np.dot(exact, lost[1:]) + (self.types - sum(exact)) * lost[-1])


def _lost(level: Level, r: np.ndarray) -> np.ndarray:
    table = level.lost()
    return table[np.minimum(r, len(table) - 1)]


class Known:
    """A block's answers, and the model's chances at its tokens."""

    def __init__(self, block: Block, answers: list, levels: list[Level], bits: int):
        self.block, self.levels, self.bits = block, levels, bits
        self.payload: dict[str, list] = {}
        for a in sorted((a for a in answers or []), key=lambda a: a["bucket"]):
            self.payload.setdefault(a["what"], []).append(a["payload"])
        self.r, self.open, self.distinct = {}, {}, {}

    def keys(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The block's distinct n-grams, and where each token's is among them."""
        if level not in self.distinct:
            self.distinct[level] = _sorted(self.block.grams(level), self.bits, level)
        return self.distinct[level]

    def counts(self, level: int) -> np.ndarray:
        """In training, of the n-gram that ends at each token."""
        if level not in self.r:
            _, at = self.keys(level)
            said = np.concatenate([expand(p, np.uint32) for p in self.payload[f"gram {level}"]])[at]
            self.r[level], self.open[level] = (said >> 1).astype(np.int64), (said & 1).astype(bool)
        return self.r[level]

    def context_counts(self, level: int) -> np.ndarray:
        return self.block.before(self.counts(level - 1), self.documents)

    documents = 0  # in training

    def chances(self, level: int) -> np.ndarray:
        """P of each token after ``level - 1`` tokens."""
        r = self.counts(level)
        if level == 1:
            unigrams = self.levels[0]
            unknown = unigrams.left() / unigrams.tokens if unigrams.tokens else 1.0
            return np.where(r > 0, (r - _lost(unigrams, r)) / max(unigrams.tokens, 1), unknown)
        backed_off = self.chances(level - 1)
        need, at, asked = self.wanted(level)
        alpha = np.ones(len(need))
        alpha[need] = np.concatenate([np.empty(0), *(expand(p, np.float64) for p in self.payload.get(f"alpha {level}", []))])
        held = self.context_counts(level)
        return np.where(r > 0, (r - _lost(self.levels[level - 1], r)) / np.maximum(held, 1), np.where(held > 0, alpha[at], 1.0) * backed_off)

    def wanted(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the sorted contexts need an alpha, where each token's context is among them, and these contexts.

        Contexts are the shorter n-grams one token before, which are sorted already, and a document's beginning.
        """
        keys, at = self.keys(level - 1)
        begin = (BEFORE + np.uint64(level)) >> np.uint64(_cut_off(level - 1, self.bits))
        i = int(np.searchsorted(keys, begin))
        if i == len(keys) or keys[i] != begin:
            keys, at = np.insert(keys, i, begin), at + (at >= i)
        at = self.block.before(at, i)
        need = np.zeros(len(keys), bool)
        need[at[(self.counts(level) == 0) & (self.context_counts(level) > 0)]] = True
        return need, at, keys


def _known(row, block: Block, levels: list[Level], bits: int, documents: int) -> Known:
    known = Known(block, row["answers"], levels, bits)
    known.documents = documents
    return known


def with_answers(table: DataFrame, answers: DataFrame) -> DataFrame:
    mine = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("what", "bucket", "payload")).alias("answers"))
    return table.join(mine.hint("shuffle_hash"), "block")


def ask_alphas(answered: DataFrame, level: int, levels: list[Level], bits: int, documents: int) -> DataFrame:
    """For each context of a block: its training tokens, what they lose, and the shorter contexts' chances of what follows.

    A sum over the n-grams of a context is taken over its tokens, each with a share of one by its n-gram's count. Only a
    document that isn't learned from can need an alpha, so contexts that no such document has are left out.
    """

    def run(batches):
        for batch in batches:
            for row, block in _each(batch):
                known = _known(row, block, levels, bits, documents)
                r, lower, on = known.counts(level), known.chances(level - 1), block.train
                need, at, keys = known.wanted(level)
                share = 1 / np.maximum(r, 1)
                n = np.bincount(at[on], minlength=len(keys)).astype(np.uint32)
                lost = np.bincount(at[on], (_lost(levels[level - 1], r) * share)[on], len(keys))
                seen = np.bincount(at[on], (lower * share)[on], len(keys))
                open_keys = np.zeros(len(keys), bool)
                open_keys[at] = block.before(known.open[level - 1], True)
                some = need | (n > 0) & open_keys
                keys, n, lost, seen, need = keys[some], n[some], lost[some], seen[some], need[some]
                for bucket, s in _slices(keys, bits, level - 1):
                    yield _ask(f"alpha {level}", bucket, row["block"], _steps(keys[s]), squeeze(n[s]), _short(lost[s]), _short(seen[s]), squeeze(need[s].astype(np.uint8)))

    return answered.mapInArrow(run, ASK)


def answer_alphas(asked: DataFrame) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_keys(k) for k in rows["keys"]]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        n, lost, seen = (np.bincount(at, np.concatenate([expand(x, kind) for x in rows[c]]), len(keys)) for c, kind in (("n", np.uint32), ("lost", np.float64), ("lower", np.float64)))
        alpha = (lost / np.maximum(n, 1)) / np.maximum(1 - seen, 1e-12)
        needs = [expand(x, np.uint8).astype(bool) for x in rows["need"]]
        payload = [_short(a[m]) for a, m in zip(np.split(alpha[at], np.cumsum([len(p) for p in parts])[:-1]), needs)]
        return pd.DataFrame({"what": rows["what"], "bucket": rows["bucket"], "block": rows["block"], "payload": payload, "stats": None})

    return asked.groupBy("what", "bucket").applyInPandas(run, ANSWER)


def score_blocks(answered: DataFrame, order: int, levels: list[Level], bits: int, documents: int, kind: str) -> DataFrame:
    unigrams = levels[0]

    def run(batches):
        for batch in batches:
            kind_of = batch.schema.field("keys").type.value_type
            for row, block in _each(batch):
                known = _known(row, block, levels, bits, documents)
                c = known.counts(1)
                base = np.log10((c + 0.5) / (unigrams.tokens + 0.5 * (unigrams.types + 1)))
                chance = np.log10(known.chances(order))
                sums = [np.add.reduceat(x, block.begins) for x in ((c > 0).astype(np.int64), base, chance)]
                held_out = pa.array(~block.train_docs)
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], kind_of), held_out, pa.array(block.lengths), pa.array(sums[0]), pa.array(np.full(len(block.lengths), unigrams.tokens)), pa.array(sums[1]), pa.array(sums[2])], ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return answered.mapInArrow(run, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _levels(answers: DataFrame, order: int) -> list[Level]:
    """Counts of counts by order: a row for each order comes to the driver."""
    width = GT_UP_TO + 3
    sums = answers.where("block is null").groupBy("what").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(width)])
    by_level = {int(r["what"].split()[1]): [r[f"s{i}"] for i in range(width)] for r in sums.collect()}
    empty = [0] * width
    return [Level(tuple(s[: GT_UP_TO + 1]), s[-2], s[-1]) for s in (by_level.get(k, empty) for k in range(1, order + 1))]


def score_documents(docs: DataFrame, train: Column, order: int = 2, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row; logs are to base 10.

    ``train``: whether a row is learned from. ``order``: tokens of the longest n-grams.
    """
    if order < 1:
        raise ValueError("order has to be 1 or more")
    kind = docs.schema[key].dataType.simpleString()
    table = cut(blocks(docs, key, text, train, block_tokens), "blocks", "none")
    n_blocks, documents = table.agg(F.count("*"), F.coalesce(F.sum("trained"), F.lit(0))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, n_blocks * block_tokens / bucket_tokens)))))
    answers = cut(answer_counts(ask_counts(table, order, bits)), "counts", "none")
    levels = _levels(answers, order)
    sweep(docs.sparkSession)
    for level in range(2, order + 1):
        known = answers.where(F.col("what").isin([f"gram {k}" for k in range(1, level + 1)] + [f"alpha {k}" for k in range(2, level)]))
        asked = ask_alphas(with_answers(table, known), level, levels, bits, documents)
        answers = answers.unionByName(cut(answer_alphas(asked), "alphas", "none"))
        del asked, known
        sweep(docs.sparkSession)
    return score_blocks(with_answers(table, answers), order, levels, bits, documents, kind).withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))
