"""Language identification by prediction by partial matching.

For each language a context tree of bytes (variable order, 3 at most) is counted on labelled documents and frozen.
A node's prediction gives a byte that it has seen n times n / (t + q), with t its total and q its distinct bytes; the
escape probability q / (t + q) is shared among the other bytes as the next shorter context predicts them, scaled to
sum to one; below order 0 all 256 bytes are alike. So each language has an exact code length for every text, and the
shortest wins. A context deeper than 1 is kept where it was seen ``least`` times or more.

All predictions of a language's kept contexts are laid out in one table (contexts x bytes), and texts are scored by
looking up every byte of a batch at once. Contexts and bytes that no sample has fall back exactly, so the table is as
good as the tree. Tables grow with the number of languages, a few MB each, not with the corpus.

The trees are fit on about ``per_language`` different documents of each language, a share of them by a hash of id and
text; everything else covers all rows. A-Z are read as a-z.

Defined results: a null text or one without a letter is ``und`` with score 0; if nothing can be learned, all are;
ties go to the first language by name; repeated rows are scored alike, and learned from once; an empty table gives an
empty table.
Texts of any length are scored whole; ``keep_known`` keeps further columns, ``identify`` doesn't look at them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewatch.llm.common import LOWER, UPPER, plain_names, text_slices

UNKNOWN = "und"
ORDER = 3
#: Labelled documents of a language that its tree is fit on, about.
PER_LANGUAGE = 300
#: Tasks that count it, at most.
TASKS = 4
#: Bits a byte from which on a text is in no language (of clean texts 999 in 1000 need fewer than 4.1), and bits on top
#: for each text, so that a few odd words don't decide about a short one.
MOST_BITS, FREE_BITS = 5.0, 64.0
#: Bytes that are looked up at a time.
_PIECE = 1 << 19
#: What a text is taken to follow.
_BEFORE = b"\n" * ORDER
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_has_letter = re.compile(r"[^\W\d_]").search


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, text`` of about so many different documents of each language.

    Languages are counted, and then each keeps the rows whose hash is below its share: no row is dealt out by language.
    """
    named = labelled.select(labelled[key].alias("key"), labelled[text].alias("text"), labelled[lang].cast("string").alias("lang")).where("lang is not null and text is not null")
    parts = 1 << 40
    shares = named.groupBy("lang").agg((F.least(F.lit(1.0), per_language / F.count("*")) * parts).cast("long").alias("share"))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "key", "text"), F.lit(parts))
    # a row for each language that labels name
    return named.join(F.broadcast(shares), "lang").where(drawn < F.col("share")).dropDuplicates(["lang", "key", "text"]).select("lang", "text")


def task_counts(texts: DataFrame) -> DataFrame:
    """``lang, gram, n``: how often each byte (lowest 8 bits) follows each ORDER bytes, still to be summed over tasks.

    The sample is bounded, so few tasks count it, each gives a gram of a language once, and how many rows come out doesn't
    hang on how the sample was dealt.
    """

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}

        def counted(parts: list[np.ndarray]) -> np.ndarray:
            values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return np.stack([values, np.bincount(at, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)])

        for batch in batches:
            for part, slices in text_slices(batch):
                by_lang: dict[str, list[np.ndarray]] = {}
                for name, text in zip(part.column("lang").to_pylist(), slices):
                    by_lang.setdefault(name, []).append(_grams(text.encode("utf-8", "replace").translate(_TO_LOWER)))
                for name, grams in by_lang.items():
                    some = np.stack(np.unique(np.concatenate(grams), return_counts=True))
                    held[name] = [counted([*held.get(name, []), some])]
        for name, [(values, n)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(n)], ["lang", "gram", "n"])

    return texts.coalesce(TASKS).mapInArrow(run, "lang string, gram long, n long")


def gram_counts(texts: DataFrame) -> DataFrame:
    """``lang, gram, n``: how often each byte (lowest 8 bits) follows each ORDER bytes."""
    return task_counts(texts).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _grams(text: bytes) -> np.ndarray:
    x = np.frombuffer(_BEFORE + text, np.uint8).astype(np.int64)
    out = x[ORDER:].copy()
    for k in range(ORDER):
        out |= x[k : len(x) - ORDER + k] << (8 * (ORDER - k))
    return out


@dataclass
class Tree:
    """The predictions of one language. Contexts are found from the newest symbols back: two of them, then the oldest."""

    pairs: np.ndarray  # node of each two symbols
    rows: np.ndarray  # the table's row for each node and older symbol
    bits: np.ndarray  # rows x symbols


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # of each byte
    symbols: int
    trees: list[Tree]

    def _pieces(self, x: np.ndarray):
        """Bits of the symbols from number ORDER on, in each language, in pieces of bounded size."""
        a = self.symbols
        for at in range(ORDER, len(x), _PIECE):
            end = min(len(x), at + _PIECE)
            last = x[at - 2 : end - 2] * a + x[at - 1 : end - 1]
            older, now = x[at - 3 : end - 3], x[at:end]
            yield at - ORDER, np.stack([t.bits[t.rows[t.pairs[last] * a + older] * a + now] for t in self.trees])

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        parts = [p for t in texts for p in (_BEFORE, t)]
        x = self.symbol[np.frombuffer(b"".join(parts).translate(_TO_LOWER), np.uint8)]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = (lengths + ORDER).cumsum() - ORDER  # in symbols that have a full context before them
        begins = ends - lengths
        out = np.zeros((len(texts), len(self.languages)))
        for at, bits in self._pieces(x):
            first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(begins, at + bits.shape[1])
            some = np.flatnonzero(lengths[first:last] > 0) + first
            if len(some):
                edges = np.clip(np.stack([begins[some], ends[some]], axis=1) - at, 0, bits.shape[1]).ravel()
                padded = np.concatenate([bits, np.zeros((len(bits), 1), bits.dtype)], axis=1)
                out[some] += np.add.reduceat(padded, edges, axis=1, dtype=np.float64)[:, ::2].T
        return out


def _tree(gram: np.ndarray, n: np.ndarray, symbol: np.ndarray, a: int, least: int) -> Tree:
    letters = [symbol[(gram >> (8 * k)) & 255] for k in range(ORDER, -1, -1)]  # the oldest first
    rows = np.full((1, a), 1 / 256)  # below order 0
    row_of = np.zeros(1, np.int64)
    for order in range(ORDER + 1):
        # a context's code: its newer symbols' node (two of them at most), then the oldest symbol
        code = np.zeros(len(n), np.int64)
        for s in letters[ORDER - min(order, 2) : ORDER]:
            code = code * a + s
        if order == ORDER:
            pairs = row_of
            known = pairs[code] >= newest  # else its newer symbols are not kept, and neither is it
            code = pairs[code] * a + letters[0]
            n = np.where(known, n, 0)
        contexts, at = np.unique(code, return_inverse=True)
        often = np.bincount(at, n, len(contexts)) >= (least if order > 1 else 0)
        kept, use = contexts[often], often[at]
        count = np.zeros((len(kept), a))
        np.add.at(count, ((np.cumsum(often) - 1)[at[use]], letters[ORDER][use]), n[use])
        if order == ORDER:  # a kept context's newer symbols are kept too, so their node is their own row
            shorter = np.arange(len(rows) * a) // a
        else:
            shorter = row_of[np.arange(a**order) % a ** max(0, order - 1)]
        below = rows[shorter[kept]]
        total, distinct = count.sum(axis=1, keepdims=True), (count > 0).sum(axis=1, keepdims=True)
        left = 1 - np.where(count > 0, below, 0).sum(axis=1, keepdims=True)
        escaped = distinct / np.maximum(total + distinct, 1) * below / np.maximum(left, 1e-12)
        row_of, newest = shorter.copy(), len(rows)
        row_of[kept] = len(rows) + np.arange(len(kept))
        rows = np.concatenate([rows, np.where(count > 0, count / np.maximum(total + distinct, 1), escaped)])
    return Tree(pairs.astype(np.int32), row_of.astype(np.int32), -np.log2(np.maximum(rows, 1e-30)).ravel().astype(np.float32))


def fit(counts: DataFrame, least: int = 4) -> Model:
    """The tables of predictions. ``counts`` is bounded by the sample and comes to the driver."""
    table = counts.toArrow()
    names = table.column("lang").to_pylist()
    gram, n = (np.asarray(table.column(c)).astype(np.int64) for c in ("gram", "n"))
    languages = sorted(set(names))
    number = {name: i for i, name in enumerate(languages)}
    lang = np.fromiter((number[x] for x in names), np.int64, len(names))
    seen = np.unique(np.concatenate([np.frombuffer(_BEFORE, np.uint8).astype(np.int64), gram & 255]))
    symbol = np.full(256, len(seen), np.int64)  # the last symbol stands for each byte that no sample has
    symbol[seen] = np.arange(len(seen))
    return Model(languages, symbol, len(seen) + 1, [_tree(gram[lang == i], n[lang == i], symbol, len(seen) + 1, least) for i in range(len(languages))])


def _judge(known: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a byte of each text."""
    names, scores, rates = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
    todo = [i for i, t in enumerate(texts) if t and known.languages and _has_letter(t)]
    at = 0
    while at < len(todo):
        end, size = at, 0
        while end < len(todo) and (end == at or size < 500_000):
            size += len(texts[todo[end]])
            end += 1
        raw = [texts[i].encode("utf-8", "replace") for i in todo[at:end]]
        bits = known.code_lengths(raw)
        best = bits.argmin(axis=1)
        lead = bits - bits.min(axis=1, keepdims=True)
        scores[todo[at:end]] = 1 / np.exp2(-np.minimum(lead, 1000)).sum(axis=1)
        rates[todo[at:end]] = bits.min(axis=1) / np.fromiter(map(len, raw), np.int64, len(raw))
        for i, b in zip(todo[at:end], best.tolist()):
            names[i] = known.languages[b]
        at = end
    return names, scores, rates


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, bits_per_byte``; score is the winner's posterior under equal priors."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                names, scores, rates = _judge(shipped.value, texts)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(names, pa.string()), pa.array(scores), pa.array(rates, from_pandas=True)], ["key", "lang_pred", "score", "bits_per_byte"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("key", key)


def keep_known(docs: DataFrame, model: Model, most_bits: float = MOST_BITS, free_bits: float = FREE_BITS, text: str = "text", lang: str | None = None) -> DataFrame:
    """The rows, with all their columns, whose text is in a learned language.

    Rejected are texts without a letter, and those whose shortest code, less ``free_bits``, takes more than ``most_bits``
    a byte: keys, numbers, encoded data, or an alphabet that no sample has. ``lang`` names a column that is set to the
    predicted language.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    plain, plainly = plain_names(docs)
    at = None if lang is None else plain.columns.index(plainly[lang])

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, plainly[text]):
                names, _, rates = _judge(shipped.value, texts)
                sizes = np.fromiter((len(t.encode("utf-8", "replace")) for t in texts), np.int64, len(texts))
                known = (np.array(names, object) != UNKNOWN) & (np.nan_to_num(rates, nan=np.inf) * sizes - free_bits <= most_bits * sizes)
                if at is not None:
                    part = part.set_column(at, part.schema.names[at], pa.array(names, part.schema.types[at]))
                yield part.filter(pa.array(known))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the labelled documents that are not held out."""
    labelled = docs.where((~held_out(F.col(key))) & F.col(key).isNotNull())
    return fit(gram_counts(sample(labelled, per_language, key, text, lang)))
