"""SimHash fingerprints, and their near-duplicate groups by the generalised pigeonhole principle.

If two 64-bit fingerprints differ in at most ``most`` bits, and the bits are grouped into m partitions with thresholds
t_1 .. t_m that sum to ``most - m + 1``, then in some partition i they differ in at most t_i bits. (A threshold of -1
leaves a partition out.) Correlated bits are put into one partition, so that the others stay selective, and a dynamic
programme allots the thresholds by the number of candidates that they are expected to give; both come from counts over
all fingerprints. Fingerprints that share a signature (a partition's bits with t_i of them blanked out) are verified.

Equal fingerprints are one row from the start, whatever the number of copies. A signature with more than
``most_in_bucket`` fingerprints (a large group of near copies that all differ) is not gathered in one place: its members
are cut by a hash into chunks of half that size, and each two chunks meet in a task. Within a bucket only a spanning set
of the verified links is emitted, a link a row at most; components don't need more.

Defined results: a text without words (null or empty too) has fingerprint zero, linked like any other; repeated rows
are copies of each other; a null doc_id is never a component's id unless its whole component has none; an empty table
gives an empty table.
Texts of any length are hashed whole, in parts; a bit that exactly half of the shingles have is 0; further columns aren't looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewatch.llm.common import LOWER, UPPER, cut, first_rows, keep_first, text_slices
from ratewatch.llm.components import components

BITS = 64
SEED = 42
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def line_of(text: str | None) -> bytes:
    """The words of a text in lower case, with a space between them."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_TO_LOWER).split())


def shingle_hashes(line: bytes, words: int) -> np.ndarray:
    """The hash of each shingle, in order; a line with fewer words is one shingle, and an empty one has none."""
    if not line:
        return np.empty(0, np.uint64)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(line)]
    k, digest = min(words, len(starts)), xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[k - 1 :])), np.uint64, len(starts) - k + 1)


def fingerprint(text: str | None, words: int) -> int:
    """64 bits; one is set if more than half of the shingles' hashes have it."""
    hashes = shingle_hashes(line_of(text), words)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text", keep: list[str] = []) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a signed long) of each row, then the columns ``keep``."""

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                fps = np.array([fingerprint(t, words) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(fps.view(np.int64)), *(part.column(c) for c in keep)], ["key", "fp", *keep])

    fields = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), *(docs[c] for c in keep))
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, fp long{fields}").withColumnRenamed("key", key)


# -- the plan


@dataclass(frozen=True)
class Plan:
    """The bits of each partition and its threshold."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]

    def masks(self) -> list[int]:
        """The bits that each signature keeps."""
        return [sum(1 << b for b in set(bits) - set(blank)) for bits, t in zip(self.parts, self.thresholds) if t >= 0 for blank in combinations(bits, t)]


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and in how many of them each pair of bits is set (64 x 64, whatever the input)."""

    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(np.asarray(batch.column("fp"), np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both.ravel()), pa.array(np.full(BITS * BITS, n))], ["i", "j", "set", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, set double, n long").groupBy("i", "j").agg(F.sum("set").alias("set"), F.sum("n").alias("n")).collect()
    out = np.zeros((BITS, BITS))
    for r in rows:
        out[r.i, r.j] = r.set
    return (rows[0].n if rows else 0), out


def make_plan(n: int, both: np.ndarray, most: int, pair_cost: float = 1.0, signature_cost: float = 200.0) -> Plan:
    """The cheapest number of partitions, grouping and thresholds by the expected pairs and the signatures to make."""
    p = np.diag(both) / max(n, 1)
    p11 = both / max(n, 1)
    p10 = p[:, None] - p11
    p01, p00 = p10.T, 1 - p11 - p10 - p10.T
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    bond = np.abs(p11 - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(bond, 0)
    agree = p**2 + (1 - p) ** 2  # that two fingerprints have the same bit
    agree2 = np.maximum(p11**2 + p10**2 + p01**2 + p00**2, 1e-12)  # the same two bits
    best: tuple[float, Plan] | None = None
    for m in range(2 if most else 1, most + 2):
        parts, free = [], set(range(BITS))
        for i in range(m):  # from a bit with strong bonds on, add what is most bound to the group so far
            width = (len(free) + (m - i) - 1) // (m - i)
            group = [max(free, key=lambda b: (bond[b, list(free)].sum(), -b))]
            free.discard(group[0])
            while len(group) < width:
                group.append(max(free, key=lambda b: (bond[b, group].sum(), -b)))
                free.discard(group[-1])
            parts.append(tuple(group))
        total = most - m + 1
        costs = []
        for bits in parts:
            differ = [1 - agree[bits[0]]] + [1 - min(1.0, agree2[a, b] / agree[a]) for a, b in zip(bits, bits[1:])]
            by_distance = np.zeros(len(bits) + 1)
            by_distance[0] = 1
            for d in differ:  # the distribution of the number of differing bits
                by_distance[1:] = by_distance[1:] * (1 - d) + by_distance[:-1] * d
                by_distance[0] *= 1 - d
            signatures, cost = 1.0, [0.0]
            for t in range(total + m):
                if t > 3:  # C(width, t) signatures a row: never worth it
                    cost.append(np.inf)
                    continue
                signatures = signatures * (len(bits) - t + 1) / t if t else 1.0
                blanked = sum(by_distance[k] * np.prod([(t - x) / max(1, len(bits) - x) for x in range(k)]) for k in range(t + 1))
                cost.append(pair_cost * n * n / 2 * blanked * signatures + signature_cost * n * signatures)
            costs.append(cost)
        state: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for cost in costs:  # state: by the sum of t + 1 so far
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (c, chosen) in state.items():
                for t1 in range(min(len(cost), most + 2 - used)):
                    if (now := c + cost[t1]) < step.get(used + t1, (np.inf,))[0]:
                        step[used + t1] = (now, (*chosen, t1 - 1))
            state = step
        if (most + 1) in state and (best is None or state[most + 1][0] < best[0]):
            best = (state[most + 1][0], Plan(tuple(parts), state[most + 1][1]))
    assert best is not None
    return best[1]


# -- signatures and verification


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _batch(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, fp)], ["key", "fp"])


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name), np.int64).view(np.uint64)


def first_signatures(fps: DataFrame, plan: Plan) -> DataFrame:
    """``key, fp`` for each signature of each fingerprint."""
    masks = np.array(plan.masks(), np.uint64)
    salts = _mix(np.arange(1, len(masks) + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            fp = _unsigned(batch, "fp")
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                yield _batch(_mix((part[:, None] & masks) ^ salts).ravel(), np.repeat(part, len(masks)))

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def pairs_of_chunks(crowded: DataFrame, most_in_bucket: int) -> DataFrame:
    """The members of crowded buckets once for each pair of chunks that they belong to: any two members meet in one."""
    sizes = crowded.groupBy("key").agg(F.ceil(F.count("*") / max(1, most_in_bucket // 2)).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    each = crowded.join(sizes, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return each.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the pairs (i, j): each row has the smallest row of its set."""
    while len(i):
        a, b = label[i], label[j]
        on = a != b
        i, j, a, b = i[on], j[on], a[on], b[on]
        if not len(i):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def _spanning(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what the pairs within ``most`` bits connect, in rows sorted by key."""
    n = len(key)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    left = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n])) - np.arange(n) - 1  # rows of the same key after this one
    label, rows, lag = np.arange(n), np.flatnonzero(left >= 1), 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    while len(rows):
        near = rows[(np.bitwise_count(fp[rows] ^ fp[rows + lag]) <= most) & (label[rows] != label[rows + lag])]
        if len(near):
            found.append((near, near + lag))
            waiting += len(near)
        if waiting > 300_000:
            label, found, waiting = _join(label, *map(np.concatenate, zip(*found))), [], 0
        lag += 1
        rows = rows[left[rows] >= lag]
    if found:
        label = _join(label, *map(np.concatenate, zip(*found)))
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def verify(signatures: DataFrame, most: int, most_in_bucket: int) -> DataFrame:
    """``a, b`` of spanning links, and with a ``key`` the members (as ``a``) of buckets that are too large to compare."""

    def run(batches):
        key = fp = np.empty(0, np.uint64)
        crowded = None  # the key of a large bucket whose rows still come

        def out(a, b, k=None):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64()) if k is None else pa.array(k.view(np.int64))], ["a", "b", "key"])

        def passed(n):
            """The first n rows, which are whole buckets."""
            sizes = np.diff(np.r_[0, np.flatnonzero(key[1:n] != key[: n - 1]) + 1, n])
            large = np.repeat(sizes, sizes) > most_in_bucket
            if large.any():
                yield out(fp[:n][large], fp[:n][large], key[:n][large])
            a, b = _spanning(key[:n][~large], fp[:n][~large], most)
            if len(a):
                yield out(a, b)

        for batch in batches:
            key, fp = (np.concatenate([x, _unsigned(batch, c)]) for x, c in ((key, "key"), (fp, "fp")))
            if crowded is not None:
                n = int((key == crowded).argmin()) if (key != crowded).any() else len(key)
                if n:
                    yield out(fp[:n], fp[:n], key[:n])
                    key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                crowded = None
            if len(key) < 100_000:
                continue
            n = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])  # where the last bucket begins
            if n:
                yield from passed(n)
                key, fp = key[n:], fp[n:]
            if len(key) > most_in_bucket:
                yield out(fp, fp, key)
                crowded, key, fp = key[0], key[:0], fp[:0]
        if len(key):
            yield from passed(len(key))

    return signatures.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long, key long")


def links(fps: DataFrame, most: int = 3, most_in_bucket: int = 4096) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints ``fp`` that differ in at most ``most`` bits."""
    if most_in_bucket < 2:
        raise ValueError("a bucket needs room for a pair")
    plan = make_plan(*bit_counts(fps), most)
    checked = cut(verify(first_signatures(fps, plan), most, most_in_bucket), "links")
    found, crowded = checked.where("key is null"), checked.where("key is not null")
    if not crowded.isEmpty():
        pairs = pairs_of_chunks(crowded.select("key", F.col("a").alias("fp")), most_in_bucket)
        # parts are cut by a hash to about half the bound, so two of them always fit and none is handed on
        found = found.unionByName(cut(verify(pairs, most, 1 << 62), "chunk-links"))
    return found.select("a", "b").distinct()


def _grouped(rows: DataFrame, most: int, most_in_bucket: int, key: str) -> DataFrame:
    """``fp, component_id``, ``root`` (a fingerprint of the component, so never null) and ``n`` (rows) of each fingerprint."""
    distinct = cut(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    groups = components(links(distinct, most, most_in_bucket))
    linked = groups.join(distinct, F.col("node") == F.col("fp")).select("root", "fp", "least")
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = linked.join(by_root, "root").select("fp", "component_id", "root")
    return distinct.join(ids, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"), "n")


def with_groups(rows: DataFrame, grouped: DataFrame, hot_share: int = 1000) -> DataFrame:
    """Rows with their fingerprint's ``component_id``.

    A fingerprint that more than 1 in ``hot_share`` rows have is looked up where its rows are: there are fewer than
    ``hot_share`` of these, whatever the input. Only the others are dealt out by fingerprint.
    """
    ids = cut(grouped.select("fp", "component_id", "n"), "groups-of-fingerprints")
    total = ids.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(ids.where(F.col("n") * hot_share > total).select("fp", F.col("component_id").alias("id"), F.lit(True).alias("hot")))
    marked = rows.join(often, "fp", "left")
    rest = marked.where("hot is null").drop("id", "hot").join(ids.where(F.col("n") * hot_share <= total).drop("n"), "fp")
    return rest.unionByName(marked.where("hot").withColumnRenamed("id", "component_id").select(*rest.columns))


def near_duplicates(docs: DataFrame, most: int = 3, words: int = 3, most_in_bucket: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp, component_id`` of each row; component_id: the smallest key that links can reach, its own included."""
    rows = cut(fingerprints(docs, words, key, text), "fingerprints")
    return with_groups(rows, _grouped(rows, most, most_in_bucket, key)).select(key, "fp", "component_id")


def keep_one(docs: DataFrame, most: int = 3, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, with all its columns, of each component: by the smallest key, nulls last, then the hash of its text.

    Rows are chosen one by one: a key that repeats with other texts, or is null, says nothing about copies.
    """
    hashed = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("hash"))
    rows = cut(fingerprints(hashed, words, "key", "text", ["hash"]), "fingerprints")
    groups = _grouped(rows, most, 4096, "key").select(F.col("fp").alias("node"), "root")
    return keep_first(docs, first_rows(rows.withColumnRenamed("fp", "node"), groups), key, text)
