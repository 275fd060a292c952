"""Near copies by the rule of the pipeline: five-word shingles and an exact Jaccard similarity of 0.8 or more.

SimHash finds and ranks them. Texts with the same words in the same order (ASCII case and white space aside) are one node
from the start. Nodes meet in buckets: a bucket for each group that ``simhash`` links at 3 bits or fewer, and, as few bits
miss much at 0.8 (9.7 of 64 differ there, with a deviation of 2.9), for each of ``BANDS`` bands of the least of
``ROWS`` permutations of the shingles. Two texts of similarity s share a band with chance 1 - (1 - s ** ROWS) ** BANDS,
0.999997 at 0.8, and none by chance as the corpus grows. Within a bucket SimHashes of 512 bits estimate how like each pair
is, and of all pairs that may be close only a forest that spans them comes out, fewer rows than the bucket has. What these
forests connect is a family, and every pair that may be close lies in one.

A family's texts come to one task, once. There all its pairs that may be close and aren't in one group yet are judged by
their shingles, and a link of each node to its group comes out: never a row for each pair, however many are refused.

A family with over ``MOST`` nodes (or ``SHINGLES`` shingles) is cut by a hash, twice, which joins most of what belongs
together. What is still apart then meets in tasks of that size, two parts in each: the largest group's parts each meet all
parts of the rest, and those each other, but what is one group already isn't compared again. Families that are very much
larger meet so by bucket. The work in a family of which no two belong together grows with its pairs, spread over tasks; the
rows with its size times its parts.

Defined results: a text of fewer than five words is one shingle; texts without words (null or empty too) are copies of
each other; nodes and shingles are 64-bit hashes; rows that repeat in key and text are one; an empty table gives an empty
table; further columns, whatever their names, stay as they are.
Texts of any length are compared whole; all close pairs between groups are judged, so ties of estimates don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewatch.llm import simhash
from ratewatch.llm.common import cut, drop, first_rows, keep_first, plain_names, text_slices
from ratewatch.llm.components import components
from ratewatch.llm.simhash import SEED, _join, _mix, line_of, shingle_hashes

WORDS = 5
#: Percent of the shingles of either text that both have.
LEAST = 80
BANDS, ROWS = 24, 4
#: 64-bit words of the long SimHash, and how many of its bits may differ: at 0.8 it is 78 of 512, with a deviation of 8, and 96
#: and 9 for texts of eight or nine words.
WIDE, MOST_BITS = 8, 140
#: Nodes that are compared in one place, and shingles of their texts.
MOST, SHINGLES = 2048, 4_000_000
#: Parts of a family up to which it meets whole, and not by bucket.
PARTS = BANDS
#: Bytes of the bitmaps of a family's shingles.
BITMAPS = 64_000_000
_rnd = np.random.default_rng(SEED)
_FACTORS = _rnd.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_WIDE_SALTS = np.concatenate([np.zeros(1, np.uint64), _mix(np.arange(101, 100 + WIDE, dtype=np.uint64))])


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The long SimHash of a set of shingles (its first word is the 64-bit one), and a key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024]
        np.minimum(least, np.multiply.outer(_FACTORS, part).min(axis=1), out=least)
        many = np.empty((len(part), WIDE), np.uint64)
        many[:, 0] = part
        many[:, 1:] = _mix(part[:, None] ^ _WIDE_SALTS[1:])
        counts += np.unpackbits(many.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    bands = _SALTS
    for row in least.reshape(BANDS, ROWS).T:
        bands = _mix(bands + row)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64), bands


def sketches(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, hash`` (of the text), ``node, n`` (distinct shingles), ``fp, wide`` and ``bands`` of each row."""

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                nodes, sizes, fps, wides, found = [], [], [], [], []
                for t in texts:
                    line = line_of(t)
                    hashes = np.unique(shingle_hashes(line, words))
                    nodes.append(xxhash.xxh64_intdigest(line, SEED))
                    sizes.append(len(hashes))
                    wide, bands = sketch(hashes)
                    fps.append(wide[0])
                    wides.append(wide.tobytes())
                    found.append(bands.view(np.int64) if len(hashes) else np.empty(0, np.int64))
                longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
                columns = [part.column("key"), part.column("hash"), longs[0], pa.array(sizes, pa.int32()), longs[1], pa.array(wides, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "hash", "node", "n", "fp", "wide", "bands"])

    plain, names = plain_names(docs)
    kind = docs.schema[key].dataType.simpleString()
    rows = plain.select(F.col(names[key]).alias("key"), F.xxhash64(names[text]).alias("hash"), F.col(names[text]).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, hash long, node long, n int, fp long, wide binary, bands array<long>")


def judged(rows: DataFrame, least: int = LEAST, words: int = WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """``a, b``: links between the groups of nodes in ``rows (key, node, root, wide, side, text)`` with the same key, a forest of each key.

    All pairs of different groups are judged by their texts, but not those of the same ``side``, unless it is null.
    """

    def run(batches):
        held, key, out = [], None, []
        for whole in batches:
            for batch, texts in text_slices(whole):
                for k, *row, text in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "root", "wide", "side")), texts):
                    if k != key:
                        out += _links(held, least, most_bits)
                        held, key = [], k
                    held.append((*row, np.unique(shingle_hashes(line_of(text), words))))
                if len(out) >= 10_000:
                    yield _pairs(out)
                    out = []
        yield _pairs(out + _links(held, least, most_bits))

    return rows.select("key", "node", "root", "wide", "side", "text").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _links(family: list[tuple], least: int, most_bits: int) -> list[tuple[int, int]]:
    """The roots that belong together in a family of ``(node, root, wide, side, shingles)``, each with the first one of its group."""
    n = len(family)
    if n < 2:
        return []
    _, roots, wides, sides, sets = zip(*family)
    _, first, at = np.unique(np.array(roots, np.int64), return_index=True, return_inverse=True)
    label = before = first[at]
    wide = np.frombuffer(b"".join(wides), np.uint64).reshape(n, -1)
    side = np.array([-1 - i if x is None else x for i, x in enumerate(sides)])
    sizes = np.fromiter(map(len, sets), np.int64, n)
    both = _shared(sets)
    label = label.copy()
    for lag in range(1, n):
        i = np.flatnonzero((label[:-lag] != label[lag:]) & (side[:-lag] != side[lag:]))
        i = i[100 * np.minimum(sizes[i], sizes[i + lag]) >= least * np.maximum(sizes[i], sizes[i + lag])]
        i = i[np.bitwise_count(wide[i] ^ wide[i + lag]).sum(axis=1, dtype=np.int32) <= most_bits]
        if len(i):
            common = both(i, i + lag)
            i = i[100 * common >= least * (sizes[i] + sizes[i + lag] - common)]
            label = _join(label, i, i + lag)
    return [(roots[i], roots[label[i]]) for i in np.unique(before).tolist() if label[i] != i]


def _shared(sets: tuple[np.ndarray, ...]):
    """A function that counts the common shingles of the pairs (i, j): by bitmaps of those that several sets have, if these are small."""
    flat = np.concatenate(sets)
    values, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    several = counts > 1
    width = -(-int(several.sum()) // 64)
    if 8 * width * len(sets) > BITMAPS:
        return lambda i, j: np.fromiter((len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())), np.int64, len(i))
    number, used = np.cumsum(several) - 1, several[at]
    bit = number[at[used]]
    maps = np.zeros((len(sets), max(1, width)), np.uint64)
    np.bitwise_or.at(maps, (np.repeat(np.arange(len(sets)), list(map(len, sets)))[used], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    step = max(1, 8_000_000 // (8 * maps.shape[1]))
    return lambda i, j: np.concatenate([np.bitwise_count(maps[i[s : s + step]] & maps[j[s : s + step]]).sum(axis=1, dtype=np.int64) for s in range(0, len(i), step)])


# -- forests of buckets


def _forest(key: np.ndarray, wide: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs of the forests of all buckets, which span all pairs with at most so many different bits."""
    n = len(key)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    left = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n])) - np.arange(n) - 1  # rows of the same key after this one
    label, rows, lag = np.arange(n), np.flatnonzero(left >= 1), 1
    found = []
    while len(rows):
        near = rows[label[rows] != label[rows + lag]]
        near = near[np.bitwise_count(wide[near] ^ wide[near + lag]).sum(axis=1, dtype=np.int32) <= most_bits]
        if len(near):
            label = _join(label, near, near + lag)
        lag += 1
        rows = rows[left[rows] >= lag]
    found = np.flatnonzero(label != np.arange(n))
    return found, label[found]


def forests(rows: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``a, b``: forests of the buckets in ``rows (key, node, wide)``."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def passed(table: pa.Table):
            key, node = (np.asarray(table.column(c), np.int64) for c in ("key", "node"))
            wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE)
            i, j = _forest(key, wide, most_bits)
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 50_000:
                table = pa.Table.from_batches(held)
                key = np.asarray(table.column("key"))
                end = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])  # the last bucket may go on
                if end:
                    yield passed(table.slice(0, end))
                held, size = table.slice(end).to_batches(), len(key) - end
        if size:
            yield passed(pa.Table.from_batches(held))

    return rows.select("key", "node", "wide").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def families(buckets: DataFrame, most: int = MOST, most_bits: int = MOST_BITS) -> DataFrame:
    """``node, family``: what pairs that may be close connect; a bucket with over ``most`` nodes is of one family."""
    crowded = F.broadcast(buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where(F.col("n") > most).select("key", "first"))
    close = forests(buckets.join(crowded, "key", "left_anti"), most_bits)
    return components(close.unionByName(buckets.join(crowded, "key").select(F.col("node").alias("a"), F.col("first").alias("b")))).withColumnRenamed("root", "family")


def _parts(count: str, shingles: str, most: int):
    """Parts of half the size that is compared in one place, so that two of them fit."""
    return F.ceil(F.greatest(F.col(count) / max(1, most // 2), F.col(shingles) / (SHINGLES // 2))).cast("int")


def parted(rows: DataFrame, salt: int) -> DataFrame:
    """``rows (key, parts, ...)`` in parts by a hash."""
    return rows.withColumns({"key": F.xxhash64("key", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("parts"))), "side": F.lit(None).cast("int")})


def met(rows: DataFrame, most: int) -> DataFrame:
    """``rows (key, node, root, n, wide)`` once for each two parts of a key, so that any two nodes of different groups meet; nothing of a key that is one group."""
    groups = rows.groupBy("key", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    sums = groups.groupBy("key").agg(F.sum("rows").alias("all"), F.sum("n").alias("all_n"), F.max(F.struct("rows", "root", "n")).alias("bulk")).where(F.col("all") > F.col("bulk.rows"))
    sizes = sums.select("key", F.col("bulk.root").alias("most_root"), F.col("bulk.rows").alias("x"), F.col("bulk.n").alias("x_n"), (F.col("all") - F.col("bulk.rows")).alias("y"), (F.col("all_n") - F.col("bulk.n")).alias("y_n"))
    sizes = sizes.select("key", "most_root", _parts("x", "x_n", most).alias("bulk_parts"), _parts("y", "y_n", most).alias("rest_parts"))
    each = rows.join(sizes, "key").withColumn("bulk", F.col("root") == F.col("most_root"))
    each = each.withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("bulk"), F.col("bulk_parts")).otherwise(F.col("rest_parts"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).cast("int").alias("side"))
    with_bulk = F.transform(upto("bulk_parts"), lambda i: place(i, F.col("mine"), 1))
    with_rest = F.transform(upto("rest_parts"), lambda j: place(F.least("mine", j), F.greatest("mine", j), None))
    of_bulk = F.transform(upto("rest_parts"), lambda j: place(F.col("mine"), j, 0))
    each = each.withColumn("at", F.explode(F.when(F.col("bulk"), of_bulk).otherwise(F.concat(with_bulk, with_rest))))
    return each.select(F.xxhash64("key", F.col("at.side").isNull(), "at.a", "at.b").alias("key"), "node", "root", "wide", F.col("at.side").alias("side"))


def buckets_of(nodes: DataFrame, most_bits: int = 3) -> DataFrame:
    """``key, node, wide``: nodes by band, and by group of SimHashes, where there are several.

    Near copies share many bands, so many buckets have the same nodes: of these one stays.
    """
    by_band = nodes.select(F.explode("bands").alias("key"), "node", "wide")
    fps = nodes.select("fp").distinct()
    near = components(simhash.links(cut(fps, "fingerprints"), most_bits))
    by_fp = nodes.join(near.withColumnRenamed("node", "fp"), "fp", "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"), "node", "wide")
    every = by_band.unionByName(by_fp)
    alike = ["rows", "x", "y"]
    sums = every.groupBy("key").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("rows > 1")
    return every.join(sums.groupBy(*alike).agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def linked(docs: DataFrame, rows: DataFrame, least: int = LEAST, words: int = WORDS, text: str = "text", most: int = MOST, most_bits: int = MOST_BITS) -> DataFrame:
    """``node, root`` of the nodes of ``rows`` (the sketches) that are linked with others."""
    nodes = cut(rows.where("n > 0").groupBy("node").agg(F.first("fp").alias("fp"), F.first("wide").alias("wide"), F.first("bands").alias("bands"), F.min("hash").alias("hash"), F.first("n").alias("n")), "nodes")
    buckets = cut(buckets_of(nodes), "buckets")
    named = families(buckets, most, most_bits)
    sizes = named.join(nodes.select("node", "n"), "node").groupBy("family").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    parts = F.when((F.col("rows") <= most) & (F.col("n") <= SHINGLES), 1).otherwise(_parts("rows", "n", most)).alias("parts")
    members = cut(named.join(sizes.select("family", parts), "family").join(nodes.select("node", "wide", "hash", "n"), "node").withColumnRenamed("family", "key"), "members")
    plain, names = plain_names(docs)
    bodies = plain.select(F.xxhash64(names[text]).alias("hash"), F.col(names[text]).alias("text")).join(members.select("hash"), "hash", "left_semi").dropDuplicates(["hash"])
    texts = cut(bodies.join(members.select("hash", "node"), "hash").select("node", "text"), "texts", "zstd")
    drop(nodes)

    def judge(asked: DataFrame) -> DataFrame:
        return cut(judged(asked.join(texts, "node"), least, words, most_bits), "links")

    links = judge(members.where("parts = 1").withColumns({"root": F.col("node"), "side": F.lit(None).cast("int")}))
    large = members.where("parts > 1")
    if not large.isEmpty():
        for turn in range(3):
            groups = cut(components(links), "groups")
            labelled = large.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
            if turn < 2:
                links = links.unionByName(judge(parted(labelled, turn)))
            else:
                asked = met(labelled.where(F.col("parts") <= PARTS), most)
                if not (vast := labelled.where(F.col("parts") > PARTS)).isEmpty():
                    asked = asked.unionByName(met(buckets.select("key", "node").join(vast.drop("key"), "node"), most))
                links = links.unionByName(judge(asked))
    return components(links)


def near_copies(docs: DataFrame, least: int = LEAST, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, component`` (the hash of one of its lines) of each row."""
    rows = cut(sketches(docs, words, key, text), "sketches")
    groups = linked(docs, rows, least, words, text)
    return rows.join(groups, "node", "left").select(F.col("key").alias(key), F.coalesce("root", "node").alias("component"))


def keep_one(docs: DataFrame, least: int = LEAST, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, with all its columns, of each component: by the smallest key, nulls last, then the hash of its text."""
    rows = cut(sketches(docs, words, key, text), "sketches")
    return keep_first(docs, first_rows(rows, linked(docs, rows, least, words, text)), key, text)
