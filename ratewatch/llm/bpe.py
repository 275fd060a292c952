"""Byte-level BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. The proposal is the right encoding exactly when no
adjacent pair of its tokens would have merged differently across its border, which is tested for all pairs
of a batch at once with numpy. Only words with a failing pair undergo exact merging by rank.

Defined results: a null text counts as empty and gives no ids; equal texts give equal rows; repeated rows and
further columns don't matter, as each row is encoded on its own; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ratewatch.llm.common import text_slices

#: The pre-tokens of this family of vocabularies, with Unicode's white space spelled out.
_SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

_NONE = np.int64(1) << 40
_find_pre_tokens = regex.compile(PRE_TOKEN).findall
_spaced_again = re.compile(r"[ \n]\s").search


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if printable, else the next free one from 256."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBPE:
    """A vocabulary, and a bounded cache of what its words encode to.

    Inside, tokens are numbered 0-255 for bytes and 256 + rank for merges, so that a smaller number merges earlier.
    """

    def __init__(self, tokenizer_json: str, special: bool = True, max_cached: int = 60_000):
        spec = json.loads(tokenizer_json)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        spell = lambda token: bytes(letters[c] for c in token)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        by_byte = {letters[t]: i for t, i in vocab.items() if len(t) == 1 and t in letters}
        own: dict[str, int] = {t: letters[t] for t in vocab if len(t) == 1 and t in letters}
        n = 256 + len(merges)
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        outside = np.zeros(n, np.uint32)
        outside[list(by_byte)] = list(by_byte.values())
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            t = 256 + rank
            own.setdefault(a + b, t)
            self.left[t], self.right[t] = own[a], own[b]
            self.merged.setdefault((own[a], own[b]), t)
            outside[t] = vocab[a + b]
        self.outside = outside
        self.token_of = {spell(t): i for t, i in own.items()}
        self._grow_trie()
        pairs = np.array([(a << 32) | b for a, b in self.merged], np.int64)
        order = np.argsort(pairs)
        self.pair_keys, self.pair_tokens = pairs[order], np.fromiter(self.merged.values(), np.int64, len(pairs))[order]
        self.bytes_of = {i: spell(t) for t, i in vocab.items()}
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in added.items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in added.items()} if special else {}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.pieces: dict[str, bytes] = {}  # ids of pre-tokens
        self.chunks: dict[str, bytes] = {}  # ids of what stands between single spaces
        self.old_pieces: dict[str, bytes] = {}  # the caches before these, for words that come again
        self.old_chunks: dict[str, bytes] = {}
        self.max_cached = max_cached
        self.seen = {"words": 0, "merged": 0}

    def _grow_trie(self) -> None:
        """Prefixes of tokens: ``trie_keys`` has parent << 8 | byte, and the i-th of them is node i + 1."""
        prefixes = sorted({t[:k] for t in self.token_of for k in range(1, len(t) + 1)}, key=lambda t: (len(t), t))
        node_of = {b"": 0} | {t: i + 1 for i, t in enumerate(prefixes)}
        self.trie_keys = np.array([node_of[t[:-1]] << 8 | t[-1] for t in prefixes], np.int64)
        self.trie_tokens = np.array([-1, *(self.token_of.get(t, -1) for t in prefixes)], np.int64)

    # -- words

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once: the tokens one after another, and the word of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        ends = lengths.cumsum()
        at, word = (ends - lengths)[lengths > 0], np.flatnonzero(lengths)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            token, after = np.zeros(len(at), np.int64), at.copy()
            live, node, here, end = np.arange(len(at)), np.zeros(len(at), np.int64), at.copy(), ends[word]
            while len(live):
                keys = (node << 8) | text[here]
                i = np.minimum(np.searchsorted(self.trie_keys, keys), len(self.trie_keys) - 1)
                on = self.trie_keys[i] == keys
                live, node, here = live[on], i[on] + 1, here[on] + 1
                t = self.trie_tokens[node]
                whole = t >= 0
                token[live[whole]], after[live[whole]] = t[whole], here[whole]
                on = here < end[live]
                live, node, here = live[on], node[on], here[on]
            found.append((word, at, token))
            on = after < ends[word]
            at, word = after[on], word[on]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        word, at, token = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at, kind="stable")
        return token[order], word[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: does BPE keep the border between these two tokens?

        The later of the two merges beside the border is undone, again and again. If the tokens that then meet
        would merge before the merge just undone, BPE would have crossed the border.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), _NONE)
        while len(live):
            keys = (a << 32) | b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            merged = np.where(self.pair_keys[at] == keys, self.pair_tokens[at], _NONE)
            crossed = merged < limit
            good[live[crossed]] = False
            go = ~crossed & (np.maximum(a, b) > 255)
            a, b, live = a[go], b[go], live[go]
            later = a > b
            limit = np.where(later, a, b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return good

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each step every word merges its pair of lowest rank, the leftmost first.

        Returns how many tokens each word has, and all tokens one after another.
        """
        of, flat = [], []
        for i, w in enumerate(words):
            if len(w) > 256:
                flat.append(np.array(self._merge_long(list(w)), np.int64))
                of.append(np.full(len(flat[-1]), i))
        short = [i for i, w in enumerate(words) if len(w) <= 256]
        lengths = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
        tokens = np.frombuffer(b"".join(words[i] for i in short), np.uint8).astype(np.int64)
        word_of = np.repeat(np.array(short, np.int64), lengths)
        while len(tokens):
            rank = np.full(len(tokens), _NONE)  # of the pair that begins here
            inner = np.flatnonzero(word_of[1:] == word_of[:-1])
            keys = (tokens[inner] << 32) | tokens[inner + 1]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank[inner] = np.where(self.pair_keys[at] == keys, self.pair_tokens[at], _NONE)
            starts = np.flatnonzero(np.r_[True, word_of[1:] != word_of[:-1]])
            sizes = np.diff(np.r_[starts, len(tokens)])
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            done = best == _NONE
            flat.append(tokens[done])
            of.append(word_of[done])
            hit = (rank == best) & ~done
            run = np.flatnonzero(hit[1:] & hit[:-1])
            if len(run):  # pairs of one token that overlap, as in aaa: every second one
                since = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], np.arange(len(hit)), 0))
                hit &= since % 2 == 0
            tokens = np.where(hit, best, tokens)
            keep = ~done & ~np.r_[False, hit[:-1]]
            tokens, word_of = tokens[keep], word_of[keep]
        if not flat:
            return np.zeros(len(words), np.int64), np.empty(0, np.int64)
        all_of = np.concatenate(of)
        return np.bincount(all_of, minlength=len(words)), np.concatenate(flat)[np.argsort(all_of, kind="stable")]

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, for words without a break of many kilobytes."""
        import heapq

        n, merged = len(tokens), self.merged
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(t, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (t := merged.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            t, i, x, y = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or tokens[i] != x or tokens[j] != y:
                continue
            tokens[i], alive[j], after[i] = t, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := merged.get((tokens[p], tokens[q]))) is not None:
                    heapq.heappush(heap, (m, p, tokens[p], tokens[q]))
        return [t for t, on in zip(tokens, alive) if on]

    def learn(self, words: list[str]) -> None:
        """Fill ``pieces`` for pre-tokens that it lacks: propose, verify all adjacent pairs, merge the failing ones."""
        spelled = [w.encode("utf-8", "replace") for w in words]
        tokens, word_of = self.propose(spelled)
        inner = np.flatnonzero(word_of[1:] == word_of[:-1])
        pairs, at = np.unique((tokens[inner] << 32) | tokens[inner + 1], return_inverse=True)
        bad = np.zeros(len(words), bool)
        bad[word_of[inner[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[at]]]] = True
        failing = np.flatnonzero(bad)
        self.seen["words"] += len(words)
        self.seen["merged"] += len(failing)
        kept = ~bad[word_of]
        for chosen, sizes, flat in (
            (np.flatnonzero(~bad), np.bincount(word_of, minlength=len(words))[~bad], tokens[kept]),
            (failing, *self.merge_all([spelled[i] for i in failing])),
        ):
            ids, ends = self.outside[flat].astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            self.pieces.update((words[i], ids[s:e]) for i, s, e in zip(chosen.tolist(), [0, *ends], ends))

    def know(self, pieces: set[str]) -> None:
        """Have all these pre-tokens in ``pieces``: from the cache before it, or else learned."""
        missing = set(filterfalse(self.pieces.__contains__, pieces))
        again = missing & self.old_pieces.keys()
        self.pieces.update((p, self.old_pieces[p]) for p in again)
        if missing := list(missing - again):
            self.learn(missing)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        self.trim()
        plans = [self._plan(t) for t in texts]
        chunks: set[str] = set()
        pieces: set[str] = set()
        for fast, parts in plans:
            (chunks if fast else pieces).update(filterfalse((self.chunks if fast else self.pieces).__contains__, parts))
        again = chunks & self.old_chunks.keys()
        self.chunks.update((c, self.old_chunks[c]) for c in again)
        found = {c: _find_pre_tokens(c.lstrip("\n") if c[:2] == "\n\n" else c if c[:1] == "\n" else f" {c}") for c in chunks - again}
        pieces.update(p for ps in found.values() for p in ps)
        self.know(pieces - self.special.keys())
        get = self.pieces.__getitem__
        self.chunks.update((c, b"".join(map(get, ps))) for c, ps in found.items())
        chunk = self.chunks.__getitem__
        return [b"".join(map(chunk, parts)) if fast else b"".join([self.special.get(p) or self.pieces[p] for p in parts]) for fast, parts in plans]

    def trim(self) -> None:
        """Keep the caches within their bound: a full one becomes the old one, from which words that come again return."""
        if len(self.chunks) > self.max_cached:
            self.old_chunks, self.chunks = self.chunks, {}
        if len(self.pieces) > self.max_cached:
            self.old_pieces, self.pieces = self.pieces, {}

    def _plan(self, text: str) -> tuple[bool, list[str]]:
        """The chunks of a text between single spaces, or its pre-tokens if a chunk could begin with white space.

        A space or newline before anything but white space begins a pre-token whatever stands before it. A chunk
        without a mark has a space before it, one with a newline follows that, and two newlines mark the first word.
        """
        if not text or text[0].isspace() or _spaced_again(text) or any(s in text for s in self.special):
            return False, self.pre_tokens(text)
        return True, f"\n\n{text}".replace("\n", " \n").replace(" \n \n", "\n\n", 1).split(" ")

    def pre_tokens(self, text: str) -> list[str]:
        if not self.special:
            return _find_pre_tokens(text)
        out: list[str] = []
        for part in self.split_special(text):
            if part in self.special:
                out.append(part)
            else:
                out += _find_pre_tokens(part)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, with U+FFFD for what is not UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[tuple, ByteBPE] = {}


def load(tokenizer_json: str, special: bool = True, max_cached: int = 60_000) -> ByteBPE:
    """One vocabulary for each Python worker."""
    key = (hash(tokenizer_json), special, max_cached)
    if key not in _loaded:
        _loaded[key] = ByteBPE(tokenizer_json, special, max_cached)
    return _loaded[key]


def vocabulary(spark, path: str):
    """The vocabulary file (a few MB, whatever the corpus), sent once to each executor."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ids of ``text`` (binary, little-endian unsigned 32-bit)."""
    shipped = vocabulary(docs.sparkSession, vocabulary_path)

    def run(batches):
        bpe = load(shipped.value)
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(bpe.encode(texts), pa.binary())], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, vocabulary_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, the ids as they came, and their text."""
    shipped = vocabulary(encoded.sparkSession, vocabulary_path)

    def run(batches):
        bpe = load(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([bpe.decode(x or b"") for x in part.column("ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("ids"), texts], ["key", "ids", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids")).mapInArrow(run, f"key {kind}, ids binary, text string").withColumnRenamed("key", key)
