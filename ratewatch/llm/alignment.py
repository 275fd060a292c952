"""Alignment of two tokenizers over the same bytes, and how often their ids meet, by inverted pair bitmaps.

Both tokenizers cover a text's bytes, so the ends of their tokens cut it into stretches, each within one token of either
side: a stretch is a link, and where both end a group of tokens closes. Words begin anew
on both sides, so each different word is cut once in a while, many at a time with numpy, and texts look their words up.

Documents are numbered within blocks of at most ``BLOCK`` documents. For each pair of ids a block has a bitmap of the documents that
link it and, as most have it once, planes: bit k of the further links. Bitmaps of slices are merged by OR into
their block's; blocks don't share documents, so a pair's documents and links are sums of popcounts over its blocks, a map-side
combined aggregate. Postings then bring the scores back: a block's bitmaps meet the counts of their pairs, go to
their block, and add up what their documents are owed. No step gathers more than a block, and no pair is sent anywhere twice
from a block, however common it is.

Defined results: texts that are null or empty, or whose tokens on either side don't spell a space and the text,
have no tokens: zeros and an empty ``groups``; special tokens' strings are plain text; repeated rows count each, and have
rows each; a null key is a key; a text of any length is aligned as a whole, and a block ends after a
text that fills it; ties of counts are all best; further columns aren't looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewatch.llm import bpe
from ratewatch.llm.common import cut, text_slices

#: Documents and links of a block, which ends at the first that is reached.
BLOCK, BLOCK_LINKS = 4096, 4_000_000
_BITMAP = BLOCK // 8
#: Characters after which a text is cut where both pre-tokenizers cut it anyway.
PIECE = 100_000
#: Fixed value: pre-tokens as the byte-level vocabulary's public description gives them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_border = re.compile(r"\S (?=[^\W\d_])").search
_spaced_again = re.compile(r"[ \n]\s|[ \n]\Z").search
_byte_piece = re.compile(r"<0x[0-9A-F]{2}>").fullmatch


class Tokenizers:
    """A byte-level BPE (A) and a sentence-piece BPE (B), with the bytes of each token."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        import tiktoken

        exact = bpe.load(a_json, special=False)
        added = {x["id"] for x in json.loads(a_json).get("added_tokens", [])}
        self.exact = exact.encode
        self.encode_a = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in exact.bytes_of.items() if i not in added}, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if _byte_piece(p) else p.replace("▁", " ").encode() for p in pieces]
        self.length_a = np.zeros(max(exact.bytes_of) + 1, np.int64)
        for i, spelled in exact.bytes_of.items():
            self.length_a[i] = len(spelled)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        a, b = (range(len(x)) for x in (self.length_a, self.length_b))
        self.space = self.b.piece_to_id("▁")
        if any(p.strip("▁") and ("▁" in p[1:] or "\n" in p) for p in pieces):
            raise ValueError("tokens go on over a space: words can't be aligned on their own")
        self.cells = [b"%d," % i for i in a] + [b"%d|" % i for i in a] + [b"%d," % i for i in b] + [b"%d;" % i for i in b]
        self.cell_size = np.fromiter(map(len, self.cells), np.int64, len(self.cells))

    def ids_a(self, text: str) -> list[int]:
        """Long texts go in pieces cut before a space between letters, where a pre-token begins whatever else there is."""
        if len(text) <= PIECE:
            return self.encode_a(text)
        out, at = [], 0
        while at < len(text):
            found = _border(text, at + PIECE)
            end = found.start() + 1 if found else len(text)
            part = text[at:end]
            # without a place to cut, this library's own encoder: its pre-tokens need no recursion
            out += self.encode_a(part) if len(part) <= 2 * PIECE else np.frombuffer(self.exact([part])[0], "<u4").tolist()
            at = end
        return out


    def ids_b(self, spelled: str) -> list[int]:
        """B adds a space: it is the first one here; without one there, what was added goes again."""
        if spelled[:1] == " ":
            return self.b.encode(spelled[1:])
        ids = self.b.encode(spelled)
        return ids[1:] if ids[:1] == [self.space] else ids


_loaded: dict[int, Units] = {}


def load(a_json: str, b_model: bytes) -> Units:
    """One for each Python worker."""
    key = hash((a_json, b_model))
    if key not in _loaded:
        _loaded[key] = Units(Tokenizers(a_json, b_model))
    return _loaded[key]


# -- links


class Units:
    """Aligned stretches of text: words with the space or newline before them, which both tokenizers begin anew, or whole texts.

    Words come again and again, so they are kept until there are ``most`` of them; what a text needs is looked up by number.
    """

    def __init__(self, tokens: Tokenizers, most: int = 250_000):
        self.tokens, self.most = tokens, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.table = np.empty((0, 5), np.int64)  # whether both sides spell it, n_a, n_b, n_groups, n_links
        self.pairs, self.ends = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.uses = np.empty(0, np.int64)

    def trim(self) -> None:
        """Of too many units those stay that came most often, half as many, and more than once."""
        used = np.argsort(-self.uses, kind="stable")[: self.most // 2]
        keep = used[self.uses[used] > 1]
        names = {i: u for u, i in self.known.items()}
        keep = np.array([i for i in keep.tolist() if i in names], np.int64)
        n = self.table[keep, 4]
        ends = np.r_[0, n.cumsum()]
        self.pairs = self.pairs[np.arange(int(ends[-1])) + np.repeat(self.ends[keep] - ends[:-1], n)]
        self.table, self.ends, self.uses = self.table[keep], ends, self.uses[keep]
        self.groups = [self.groups[i] for i in keep.tolist()]
        self.known = {names[i]: k for k, i in enumerate(keep.tolist())}

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of texts one after another, and how many each text has; a null or empty text has none."""
        if len(self.groups) > self.most:
            self.trim()
        plans, known = [_units(t) for t in texts], self.known
        listed = [u for _, units in plans for u in units]
        number = list(map(known.get, listed))
        missing = [i for i, k in enumerate(number) if k is None]
        alone = {units[0] for words, units in plans if not words}
        # in order, so that numbers don't hang on how a set goes through its strings
        fresh = sorted({listed[i] for i in missing} - alone)
        short = [u for u in fresh if len(u) <= 64]
        other = [u for u in fresh if len(u) > 64] + sorted(alone)
        at = len(self.groups)
        known.update((u, at + i) for i, u in enumerate(short))
        once = {u: at + len(short) + i for i, u in enumerate(other)}  # long ones are not kept
        for k in range(0, len(short), 20_000):
            self._append(_cut(self.tokens, short[k : k + 20_000], True))
        for u in other:
            self._append(_cut(self.tokens, [u], False))
        for i in missing:
            number[i] = once[listed[i]] if listed[i] in once else known[listed[i]]
        number, sizes = np.array(number, np.int64), np.fromiter((len(units) for _, units in plans), np.int64, len(plans))
        self.uses = np.r_[self.uses, np.zeros(len(self.groups) - at, np.int64)] + np.bincount(number, minlength=len(self.groups))
        return number, sizes

    def _append(self, cut: tuple) -> None:
        table, groups, links = cut
        self.groups += groups
        self.pairs, self.table = np.concatenate([self.pairs, links]), np.concatenate([self.table, table])
        self.ends = np.concatenate([self.ends, self.ends[-1] + table[:, 4].cumsum()])


def _units(text: str) -> tuple[bool, list[str]]:
    """The words of a text, each with what is before it; or (False) the whole text, if one could begin with more white space."""
    if not text:
        return True, []
    if text[0].isspace() or _spaced_again(text):
        return False, [" " + text]
    return True, [u if u[0] == "\n" else " " + u for u in text.replace("\n", " \n").split(" ")]


def _cut(tokens: Tokenizers, units: list[str], words: bool) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of each unit: whether both sides spell it and four counts; its groups; and the pairs (a << 32 | b) of all links.

    Words go through the tokenizers in one line, which is cut where they end; if that line isn't spelled, one by one.
    """
    raw = [u.encode("utf-8", "replace") for u in units]
    size, good = np.fromiter(map(len, raw), np.int64, len(raw)), np.ones(len(units), np.int64)
    spell = tokens.bytes_b.__getitem__
    a, b = (np.array(ids("".join(units)), np.int64) for ids in (tokens.ids_a, tokens.ids_b))
    border = size.cumsum()
    end_a, end_b = tokens.length_a[a].cumsum(), tokens.length_b[b].cumsum()
    if (words or len(units) == 1) and b"".join(map(spell, b.tolist())) == b"".join(raw) and np.isin(border, end_a).all() and np.isin(border, end_b).all():
        n_a, n_b = (np.diff(np.searchsorted(ends, border, side="right"), prepend=0) for ends in (end_a, end_b))
    else:
        a_ids, b_ids = [tokens.ids_a(u) for u in units], [tokens.ids_b(u) for u in units]
        for i, (bytes_, ids) in enumerate(zip(raw, b_ids)):
            if b"".join(map(spell, ids)) != bytes_ or int(tokens.length_a[a_ids[i]].sum()) != len(bytes_):
                good[i], size[i], a_ids[i], b_ids[i] = 0, 0, [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(units)) for x in (a_ids, b_ids))
        a, b = (np.array([i for ids in x for i in ids], np.int64) for x in (a_ids, b_ids))
    marks = np.zeros(int(size.sum()), np.uint8)  # at the last byte of a token: 1 for A, 2 for B
    marks[tokens.length_a[a].cumsum() - 1] = 1
    marks[tokens.length_b[b].cumsum() - 1] += 2
    cuts = np.flatnonzero(marks)
    kind = marks[cuts]
    closes_a, closes_b, both = (kind & 1) > 0, (kind & 2) > 0, kind == 3
    link_a, link_b = (np.cumsum(x) - x for x in (closes_a, closes_b))  # the token that a stretch lies in
    of = np.searchsorted(size.cumsum(), cuts, side="right")
    table = np.stack([good, n_a, n_b, np.bincount(of[both], minlength=len(units)), np.bincount(of, minlength=len(units))], axis=1)
    # groups: A's ids and then B's of one after another
    closed, n = np.cumsum(both) - both, int(both.sum())  # groups before each stretch
    group_a, group_b = closed[closes_a], closed[closes_b]
    in_a, in_b = np.bincount(group_a, minlength=n).cumsum(), np.r_[0, np.bincount(group_b, minlength=n).cumsum()]
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + in_b[group_a]] = a + len(tokens.length_a) * both[closes_a]
    codes[np.arange(len(b)) + in_a[group_b]] = 2 * len(tokens.length_a) + b + len(tokens.length_b) * both[closes_b]
    line, end = b"".join(map(tokens.cells.__getitem__, codes.tolist())), np.r_[0, tokens.cell_size[codes].cumsum()][(n_a + n_b).cumsum()]
    groups = [line[s : max(s, e - 1)] for s, e in zip([0, *end.tolist()], end.tolist())]
    return table, groups, (a[link_a] << 32) | b[link_b]


def align(units: Units, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """``n_a, n_b, n_groups, n_links`` of each text and its groups; and the text and unit of each unit that has links."""
    number, sizes = units.numbers(texts)
    of = np.repeat(np.arange(len(texts)), sizes)
    whole = np.bincount(of, units.table[number, 0] == 0, minlength=len(texts)) == 0  # texts whose units are all spelled
    counts = np.stack([np.bincount(of, units.table[number, k], minlength=len(texts)).astype(np.int64) for k in range(1, 5)], axis=1) * whole[:, None]
    get, listed, ends = units.groups.__getitem__, number.tolist(), sizes.cumsum().tolist()
    groups = [b";".join(map(get, listed[e - n : e])).decode() if on else "" for n, e, on in zip(sizes.tolist(), ends, whole.tolist())]
    keep = whole[of]
    return counts, groups, of[keep], number[keep]


# -- bitmaps


def pack(documents: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Compressed bitmaps of runs of increasing document numbers; ``starts`` of the runs. Returns where each begins, and all bytes.

    A run that is denser than one document in eight is a plain bitmap; else the gaps follow each other, in
    one byte below 128 and in two above.
    """
    n = np.diff(np.r_[starts, len(documents)])
    dense = n >= _BITMAP
    gap = np.diff(documents, prepend=0)
    gap[starts] = documents[starts]
    thin = ~np.repeat(dense, n)
    gaps = gap[thin]
    wide = gaps > 127
    of_gap = np.zeros(len(documents), np.int64)
    of_gap[thin] = 1 + wide
    sizes = np.where(dense, _BITMAP, np.add.reduceat(of_gap, starts) if len(starts) else 0)
    ends = sizes.cumsum()
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    begins = ends - sizes
    if len(gaps):
        before = of_gap.cumsum() - of_gap
        place = (before - np.repeat(before[starts], n) + np.repeat(begins, n))[thin]
        out[place] = np.where(wide, (gaps & 127) | 128, gaps)
        out[place[wide] + 1] = gaps[wide] >> 7
    for i in np.flatnonzero(dense).tolist():
        bits = np.zeros(BLOCK, np.uint8)
        bits[documents[starts[i] : starts[i] + n[i]]] = 1
        out[begins[i] : ends[i]] = np.packbits(bits, bitorder="little")
    return begins, out.tobytes()


def unpack(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document numbers of bitmaps with so many bytes each, one after another, and how many each has."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    begins = sizes.cumsum() - sizes
    bitmap = sizes == _BITMAP  # gaps that long would be at least as many documents, which is a plain bitmap
    inside = np.repeat(bitmap, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # gaps: a byte above 127 goes on in the next one
    g, g_owner = raw[~inside], owner[~inside]
    second = np.zeros(len(g), bool)
    if len(g):
        second[1:] = g[:-1] > 127
        # after a first byte comes a second one, whose own size says nothing
        run = np.flatnonzero(second)
        if len(run):
            second = _alternate(g > 127)
    first = ~second
    value = g[first] & 127
    more = np.flatnonzero(second)
    at_first = np.cumsum(first) - 1
    value[at_first[more]] += g[more] << 7
    owner_thin = g_owner[first]
    total = value.cumsum()
    begin = np.flatnonzero(np.r_[True, owner_thin[1:] != owner_thin[:-1]]) if len(owner_thin) else np.empty(0, np.int64)
    base = np.repeat(total[begin] - value[begin], np.diff(np.r_[begin, len(owner_thin)])) if len(begin) else 0
    documents, owners = [total - base], [owner_thin]
    for i in np.flatnonzero(bitmap).tolist():
        found = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, _BITMAP, int(begins[i])), bitorder="little"))
        documents.append(found)
        owners.append(np.full(len(found), i))
    docs, who = np.concatenate(documents), np.concatenate(owners)
    return docs, who


def _alternate(high: np.ndarray) -> np.ndarray:
    """Which bytes are second ones: the one after a first byte that is high. Second bytes are below 128, so none is high itself."""
    return np.r_[False, high[:-1]]


class Block:
    """The pairs of a block's documents so far."""

    def __init__(self):
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.documents = self.links = 0

    def add(self, units: Units, text_of: np.ndarray, number: np.ndarray, texts: int) -> None:
        """Links of the next texts, by their units: (pair, document) with the number of its links. Slices are merged when the block closes."""
        alike, times = np.unique(number * BLOCK + text_of, return_counts=True)
        unit, document = alike // BLOCK, alike % BLOCK + self.documents
        n = units.table[unit, 4]
        place = np.arange(int(n.sum())) + np.repeat(units.ends[unit] - (n.cumsum() - n), n)
        pairs = units.pairs[place]
        # 32 bits of A, of which 17 are used, and of B 15: a pair and a document fit into 64
        packed = ((pairs >> 32) << 27 | (pairs & 0x7FFF) << 12) | np.repeat(document, n)
        order = np.argsort(packed)
        packed, weight = packed[order], np.repeat(times, n)[order]
        starts = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.empty(0, np.int64)
        if len(starts):
            self.codes.append(packed[starts])
            self.times.append(np.add.reduceat(weight, starts))
        self.documents += texts
        self.links += int((units.table[number, 4]).sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Pair, plane, documents, begin of each bitmap, and their bytes. Plane 0 has all documents, plane k + 1 bit k of the further links."""
        codes = np.concatenate(self.codes) if self.codes else np.empty(0, np.int64)
        times = np.concatenate(self.times) if self.times else np.empty(0, np.int64)
        if len(self.codes) > 1:  # slices have documents of their own: their OR is a merge
            order = np.argsort(codes, kind="stable")
            codes, times = codes[order], times[order]
        if not len(codes):
            return (*(np.empty(0, np.int64),) * 4, b"")
        pair, document, plane = [codes >> 12], [codes & 4095], [np.zeros(len(codes), np.int64)]
        further = times - 1
        for k in range(int(further.max()).bit_length()):
            on = (further >> k) & 1 > 0
            pair.append(codes[on] >> 12)
            document.append(codes[on] & 4095)
            plane.append(np.full(int(on.sum()), k + 1))
        p, d, k = map(np.concatenate, (pair, document, plane))
        starts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (k[1:] != k[:-1])])
        begins, data = pack(d, starts)
        first = p[starts]
        return (first >> 15) << 32 | (first & 0x7FFF), k[starts], np.diff(np.r_[starts, len(p)]), begins, data


_SCHEMA = "block long, document int, n_a long, n_b long, n_groups long, n_links long, groups string, pair long, plane int, n int, bits binary"


def align_documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two kinds of rows: documents (``key, block, document``, counts and ``groups``), and bitmaps (``block, pair, plane, n, bits``)."""
    with open(b_path, "rb") as f:  # vocabulary files: a few MB, whatever the corpus
        shipped = docs.sparkSession.sparkContext.broadcast((bpe.vocabulary(docs.sparkSession, a_path).value, f.read()))
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", *(x.split()[0] for x in _SCHEMA.split(", "))]

    def run(batches):
        units = load(*shipped.value)
        number, block = TaskContext.get().partitionId() << 32, Block()

        def closed():
            pair, plane, n, begins, data = block.rows()
            offsets = np.r_[begins, len(data)].astype(np.int32)
            for at in range(0, len(pair), 50_000):
                end = min(at + 50_000, len(pair))
                bits = pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer(offsets[at : end + 1].tobytes()), pa.py_buffer(data)])
                fields = [pa.array(np.full(end - at, number)), *(pa.nulls(end - at, t) for t in (pa.int32(), *(pa.int64(),) * 4, pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.nulls(end - at, key_type), *fields, pa.array(pair[at:end]), pa.array(plane[at:end].astype(np.int32)), pa.array(n[at:end].astype(np.int32)), bits], names)

        for batch in batches:
            key_type = batch.column("key").type
            for part, texts in text_slices(batch):
                for at in range(0, len(texts), BLOCK):
                    some = texts[at : at + BLOCK]
                    if block.documents and (block.documents + len(some) > BLOCK or block.links >= BLOCK_LINKS):
                        yield from closed()
                        number, block = number + 1, Block()
                    counts, groups, text_of, numbers = align(units, some)
                    documents = np.arange(block.documents, block.documents + len(some), dtype=np.int32)
                    block.add(units, text_of, numbers, len(some))
                    fields = [pa.array(np.full(len(some), number)), pa.array(documents), *(pa.array(c) for c in counts.T), pa.array(groups, pa.string())]
                    yield pa.RecordBatch.from_arrays([part.column("key").slice(at, len(some)), *fields, *(pa.nulls(len(some), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names)
        if block.documents:
            yield from closed()

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, {_SCHEMA}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, documents, links``: sums of popcounts; a document in plane k + 1 stands for 2 ** k further links."""
    weight = F.when(F.col("plane") == 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    return aligned.where("pair is not null").groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("documents"), F.sum(F.col("n") * weight).alias("links"))


def with_best(counts: DataFrame) -> DataFrame:
    """With ``best``: whether no other pair of the same B has more links."""
    b = F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int")
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))  # a row a token of B
    return counts.withColumn("b", b).join(most, "b").select("pair", "documents", "links", (F.col("links") == F.col("most")).alias("best"))


def scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``block, document, n_best, count_sum`` of documents with links, from the postings of their block's pairs."""
    names = ["block", "document", "n_best", "count_sum"]

    def run(batches):
        held, best, total = None, None, None

        def out():
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), held)), pa.array(some.astype(np.int32)), pa.array(best[some]), pa.array(total[some])], names)

        for batch in batches:
            blocks = np.asarray(batch.column("block"), np.int64)
            borders = np.r_[np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]), len(blocks)] if len(blocks) else []
            for s, e in zip(borders[:-1], borders[1:]):
                if blocks[s] != held:
                    if held is not None:
                        yield out()
                    held, best, total = int(blocks[s]), np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
                part = batch.slice(int(s), int(e - s))
                bits = part.column("bits").to_pylist()
                documents, who = unpack(b"".join(bits), np.fromiter(map(len, bits), np.int64, len(bits)))
                plane, links = np.asarray(part.column("plane"), np.int64), np.asarray(part.column("links"), np.int64)
                weight = 1 << np.maximum(plane - 1, 0)
                np.add.at(total, documents, (weight * links)[who])
                np.add.at(best, documents, (weight * np.asarray(part.column("best")))[who])
        if held is not None:
            yield out()

    postings = aligned.where("pair is not null").select("block", "pair", "plane", "bits").join(counts.select("pair", "links", "best").hint("merge"), "pair")  # pairs have no proven bound to be sent around
    dealt = postings.select("block", "plane", "bits", "links", "best").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "block long, document int, n_best long, count_sum long")


def scored(aligned: DataFrame) -> DataFrame:
    """The documents of a written ``aligned`` with ``n_best`` (links whose pair is the best of its B) and ``count_sum`` (links of their pairs)."""
    counts = cut(with_best(cut(pair_counts(aligned), "pair-links")), "pair-counts")
    found = scores(aligned, counts)
    documents = aligned.where("document is not null").drop("pair", "plane", "n", "bits")
    return documents.join(found, ["block", "document"], "left").na.fill(0, ["n_best", "count_sum"])
