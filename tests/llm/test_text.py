import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ratewatch.llm import components, cws, katz, langid, sharding, simhash, telephony, toxicity
from ratewatch.llm.queries import queries

SF = "/root/testdata/sf0.01"

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.decode("utf-8", "replace") for w in (text or "").encode().translate(LOW).split()]


# -- simhash


def plain_fingerprint(text, k=3):
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, most):
    """All pairs, by breadth."""
    values = sorted(set(fps))
    x = np.array(values, np.uint64)
    root, seen = {}, set()
    for v in values:
        if v in seen:
            continue
        group, todo = {v}, [v]
        while todo:
            near = x[np.bitwise_count(x ^ np.uint64(todo.pop())) <= most]
            new = {int(n) for n in near} - group
            group |= new
            todo += new
        seen |= group
        root |= {g: v for g in group}
    return root


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints(odd):
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in simhash.fingerprints(odd).collect():
        assert r.fp == signed(plain_fingerprint(texts[r.doc_id]))
    assert simhash.fingerprint("one two", 3) == plain_fingerprint("one two")


def clustered(n, seed=0):
    """Fingerprints in balls and chains, with a few bits that hang together, and one crowded ball."""
    rnd = random.Random(seed)
    out = set()
    for _ in range(n // 4):
        v = rnd.getrandbits(64) & ~0xFF | (0xFF if rnd.random() < 0.8 else 0)
        for _ in range(rnd.randint(1, 6)):
            out.add(v)
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                v ^= 1 << b
    ball = rnd.getrandbits(64)
    for _ in range(n // 4):
        v = ball
        for b in rnd.sample(range(64), rnd.randint(0, 4)):
            v ^= 1 << b
        out.add(v)
    return out


@pytest.mark.parametrize(("most", "in_bucket"), [(3, 4096), (3, 5), (7, 4096), (7, 6), (0, 50)])
def test_links_lose_no_component(spark, most, in_bucket):
    fps = clustered(600)
    df = spark.createDataFrame([(signed(v),) for v in fps], "fp long").repartition(3)
    wanted = plain_components(fps, most)
    found = {r.node: r.root for r in components.components(simhash.links(df, most, in_bucket)).collect()}
    groups = {}
    for v in fps:
        groups.setdefault(wanted[v], set()).add(signed(v))
    for group in groups.values():
        assert len({found.get(v, v) for v in group}) == 1
    assert len({found.get(signed(v), signed(v)) for v in fps}) == len(groups)


@pytest.mark.parametrize("most", [0, 1, 3, 7])
def test_plan_keeps_the_pigeonhole(most):
    rnd = np.random.default_rng(0)
    bits = (rnd.random((4000, 64)) < rnd.random(64)).astype(float)
    bits[:, 1] = bits[:, 0]
    plan = simhash.make_plan(4000, bits.T @ bits, most)
    assert sorted(b for p in plan.parts for b in p) == list(range(64))
    assert sum(t + 1 for t in plan.thresholds) == most + 1
    masks = np.array(plan.masks(), np.uint64)
    for _ in range(300):
        d = sum(1 << int(b) for b in rnd.choice(64, most, replace=False))
        assert (masks & np.uint64(d) == 0).any()


def test_near_duplicates(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    texts = [(r.doc_id, plain_fingerprint(r.text)) for r in odd.collect()]
    root = plain_components([f for _, f in texts], 3)
    least = {}
    for d, f in texts:
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    for r in rows:
        assert r.component_id == least.get(root[r.fp % (1 << 64)])
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(3) <= 1 and None in ids
    assert len([i for i in ids if i in (4, 5, 6)]) == 1  # three texts without words are copies
    assert simhash.keep_one(empty).count() == 0


def test_keep_one_decides_by_row(spark):
    rnd = random.Random(3)
    a, b, c, d, e = (" ".join(f"w{rnd.randrange(5000)}" for _ in range(80)) for _ in range(5))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (None, e), (None, e), (None, c)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, a), (2, b), (3, c), (3, d), (None, e)} and kept.count() == 5


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    root = plain_components(fps.values(), 3)
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(least.get(root[f], d), d)
    rows = queries()["op1_simhash"](spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(d, f"{f:016x}", least[root[f]]) for d, f in fps.items()}


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[1000 + i] for i in range(300)} == {1000} and 5000 not in found


# -- shards


def test_shards_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op2_virtual_slots"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    shards = {}
    for r in rows:
        assert (r.size, r.text_crc32) == (len(docs[r.doc_id]) + 8, zlib.crc32(docs[r.doc_id]))
        shards.setdefault(r.shard, []).append(r)
    assert sorted(shards) == list(range(24))
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    loads = [sum(r.size for r in m) for m in shards.values()]
    assert max(loads) < 1.01 * min(loads)
    after = [sum(r.size for r in rows if r.shard_after == s) for s in range(25)]
    assert all(r.shard_after in (r.shard, 24) for r in rows) and max(after) < 1.3 * min(after)  # few documents a slot here


def test_map_has_every_slot_and_lasts(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}" * (i % 7)) for i in range(400)], "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    placed, slot_map = sharding.shard_documents(docs.where("doc_id % 2 = 0"), shards=3, slots=512, map_path=path)
    assert placed.count() == 200 and sorted(r.virtual_slot for r in slot_map.where("version = 1").collect()) == list(range(512))
    stored = sharding.read_map(spark, path)
    assert stored.exceptAll(slot_map).isEmpty() and {r.version for r in stored.collect()} == {1, 2}
    rows = sharding.records(docs, 512)  # records that came after the map
    assert sharding.assign(rows, sharding.slot_sizes(rows, 512), stored).count() == 400
    with pytest.raises(Exception, match="no shard for virtual slot"):
        sharding.assign(rows, sharding.slot_sizes(rows, 512), stored.where("virtual_slot < 100")).collect()


def test_adding_a_shard_moves_only_into_it(odd):
    rows = sharding.records(odd, 64)
    sizes = sharding.slot_sizes(rows, 64)
    first = sharding.first_map(sizes, 4)
    second = sharding.add_shard(first, sizes, 4)
    old = {r.virtual_slot: r.shard for r in sharding.current(first).collect()}
    new = {r.virtual_slot: r.shard for r in sharding.current(second).collect()}
    assert old.keys() == new.keys() and all(new[s] in (old[s], 4) for s in old)
    assert {r.version for r in second.collect()} <= {1, 2} and set(old.values()) <= {0, 1, 2, 3}


def test_odd_shards(odd, empty):
    placed, slot_map = sharding.shard_documents(odd, shards=5, slots=16)
    rows = placed.collect()
    assert len(rows) == odd.count() and slot_map.where('version = 1').count() == 16
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert next(r for r in rows if r.doc_id == 4).size == 8
    assert sharding.shard_documents(empty)[0].count() == 0


# -- weighted sampling


def jaccard(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_sampling_collides_like_jaccard(spark):
    rows = [(i, " ".join(random.Random(i).choices([f"w{k}" for k in range(40)], k=120))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in cws.fingerprint_documents(df).collect()}
    off = []
    for i, text in rows:
        after = rows[i - 1][1] if i else rows[-1][1]
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        off += [found[i].near_edited - jaccard(text, edited), found[i].near_next - jaccard(text, after)]
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.09


def test_sampling_query(spark):
    import hashlib

    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    rows = {r.doc_id: r for r in queries()["op3_weighted_sampling"](spark, SF).collect()}
    assert len(rows) == len(docs)
    by_text = {}
    for i, (d, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        assert (rows[d].n_chars, rows[d].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, rows[d].fingerprint) == rows[d].fingerprint
        if text == edited:
            assert rows[d].near_edited == 1
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()]) + 0.3


def test_one_draw_by_hand(spark):
    """The digits of a fingerprint from the definition: hashes, gamma draws, and the least of ln a."""
    text = "a a a b b c"
    fp = cws.fingerprint_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), samples=4).first().fingerprint
    unit = lambda bits, width: ((bits & ((1 << width) - 1)) + 0.5) / (1 << width)
    digits = ""
    for j in range(4):
        least = None
        for term, w in Counter(text.split()).items():
            row = spark.sql(f"select xxhash64(xxhash64('{term}'), {j}) as h1, xxhash64({j}, xxhash64('{term}')) as h2").first()
            h1, h2 = row.h1 % (1 << 64), row.h2 % (1 << 64)
            r = -math.log(unit(h1 >> 40, 24) * unit(h1 >> 16, 24))
            log_c = math.log(-math.log(unit(h2 >> 42, 22) * unit(h2 >> 20, 22)))
            beta = unit(h2, 20)
            t = math.floor(math.log(w) / r + beta)
            log_a = log_c - r * (t - beta) - r
            least = log_a if least is None else min(least, log_a)
        near = [spark.sql(f"select lower(lpad(hex(xxhash64({v}L) & 65535), 4, '0')) as d").first().d for v in (math.floor(least * 2.0**40) + k for k in (-1, 0, 1))]
        assert fp[4 * j : 4 * j + 4] in near
        digits += fp[4 * j : 4 * j + 4]
    assert digits == fp


def test_case_of_a_cut_word(spark):
    """A sigma at the end of a piece is the same letter as within a word."""
    docs = spark.createDataFrame([(2, "x" * 6 + " ΟΔΟΣ ΟΔΟΣ"), (1, "y")], "doc_id long, text string")
    assert {r.doc_id: r.near_edited for r in cws.fingerprint_documents(docs, samples=16).collect()}[2] < 1
    lowered = docs.select(cws._lower("text").alias("t")).collect()
    assert all("ς" not in r.t for r in lowered)


def test_odd_samples(odd, empty):
    rows = cws.fingerprint_documents(odd, samples=8).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint
    assert by_id[4].fingerprint == by_id[5].fingerprint == by_id[6].fingerprint == "ffff" * 8
    assert by_id[None].n_chars == len("no id here")
    assert cws.fingerprint_documents(empty).count() == 0


# -- Katz


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_equals_brute_force(spark, order):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()][:60]
    rows = [*docs, (5000, None), (5001, ""), (5002, "Only new words, no others")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in katz.score_documents(df, ~katz.held_out(F.col("doc_id")), order=order, block_tokens=2000, bucket_tokens=500).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    tokens = lambda t: [*words(t), "\n"]
    grams = [Counter() for _ in range(order + 1)]
    for d, t in rows:
        if not held[d]:
            w = ["^"] * (order - 1) + tokens(t)
            for p in range(order - 1, len(w)):
                for k in range(1, order + 1):
                    grams[k][tuple(w[p - k + 1 : p + 1])] += 1
    levels = [katz.Level(tuple(sum(v == i for v in grams[k].values()) for i in range(1, 7)), len(grams[k]), sum(grams[k].values())) for k in range(1, order + 1)]
    held_by = [Counter() for _ in range(order + 1)]
    after = {}
    for k in range(2, order + 1):
        for g, n in grams[k].items():
            held_by[k][g[:-1]] += n
            after.setdefault((k, g[:-1]), []).append(g)
    lost = lambda k, r: levels[k - 1].lost()[min(r, len(levels[k - 1].lost()) - 1)]
    total = levels[0].tokens

    @lru_cache(None)
    def alpha(k, h):
        seen = after[(k, h)]
        return (1 - sum(grams[k][g] - lost(k, grams[k][g]) for g in seen) / held_by[k][h]) / (1 - sum(chance(k - 1, g[1:]) for g in seen))

    @lru_cache(None)
    def chance(k, g):
        r = grams[k][g]
        if k == 1:
            return (r - lost(1, r)) / total if r else levels[0].left() / total
        if r:
            return (r - lost(k, r)) / held_by[k][g[:-1]]
        return (alpha(k, g[:-1]) if held_by[k][g[:-1]] else 1) * chance(k - 1, g[1:])

    for d, t in rows:
        w = ["^"] * (order - 1) + tokens(t)
        r = found[d]
        assert math.isclose(r.score, sum(math.log10(chance(order, tuple(w[p - order + 1 : p + 1]))) for p in range(order - 1, len(w))), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((grams[1][(x,)] + 0.5) / (total + 0.5 * (levels[0].types + 1))) for x in tokens(t)), rel_tol=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(tokens(t)), sum(grams[1][(x,)] > 0 for x in tokens(t)), total)
    for h in list(held_by[order])[:5] if order > 1 else [()]:
        assert math.isclose(sum(chance(order, (*h, *g)) for g in grams[1]) + chance(order, (*h, "unknown word")), 1, rel_tol=1e-9)


def test_katz_beats_the_base(spark):
    rows = queries()["op4_katz"](spark, SF).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_odd_katz(odd, empty):
    rows = katz.score_documents(odd, ~katz.held_out(F.col("doc_id"))).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5, 6)} == {1}
    untrained = katz.score_documents(odd, F.lit(False)).collect()
    assert all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in untrained)
    assert katz.score_documents(empty, F.lit(True)).count() == 0


# -- language


def test_code_lengths_are_exact(spark):
    texts = [("en", "the cat sat on the mat, and the dog"), ("de", "der Hund und die Katze")]
    model = langid.fit(langid.gram_counts(spark.createDataFrame(texts, "lang string, text string")), least=2)
    rnd = random.Random(0)
    for before in [b"the", b"\n\n\n", b"\xff\xffx", bytes(rnd.choices(range(97, 123), k=3))]:
        every = np.exp2(-(model.code_lengths([before + bytes([b]) for b in range(256)]) - model.code_lengths([before]))).reshape(256, 2)
        # A and a share a node, so that each capital counts for its small letter too
        keep = [b for b in range(256) if not 65 <= b <= 90]
        assert np.allclose(every[keep].sum(axis=0) + 26 * model_unseen(model, before), 1, atol=1e-4)


def plain_ppm(texts, least, order=3):
    """Code length of a text by escapes with exclusion, from dictionaries of counts."""
    seen = Counter()
    for t in texts:
        x = b"\n" * order + t.translate(LOW)
        for i in range(order, len(x)):
            for k in range(order + 1):
                seen[(x[i - k : i], x[i])] += 1
    after = {}
    for (h, b), n in seen.items():
        after.setdefault(h, {})[b] = n

    def chance(h, b):
        if h is None:
            return 1 / 256
        shorter = h[1:] if h else None
        kept = after.get(h, {}) if len(h) < 2 or sum(after.get(h, {}).values()) >= least else {}
        if not kept:
            return chance(shorter, b)
        total, q = sum(kept.values()), len(kept)
        if b in kept:
            return kept[b] / (total + q)
        return q / (total + q) * chance(shorter, b) / (1 - sum(chance(shorter, x) for x in kept))

    def bits(text):
        x = b"\n" * order + text.translate(LOW)
        return -sum(math.log2(chance(x[i - order : i], x[i])) for i in range(order, len(x)))

    return bits


def test_code_lengths_equal_brute_force(spark):
    rows = [(r.lang, r.text[:400]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    model = langid.fit(langid.gram_counts(spark.createDataFrame(rows, "lang string, text string")), least=3)
    plain = {lang: plain_ppm([t.encode() for name, t in rows if name == lang], 3) for lang in model.languages}
    texts = [rows[0][1].encode()[:120], "Überall 123 zażółć".encode(), b"", b"q\xff", b"Zzz the"]
    found = model.code_lengths(texts)
    for t, row in zip(texts, found):
        assert np.allclose(row, [plain[lang](t) for lang in model.languages], rtol=1e-5)


def test_long_texts_are_coded_in_pieces(spark, monkeypatch):
    rows = [("en", "the cat sat on the mat"), ("de", "der Hund und die Katze")]
    model = langid.fit(langid.gram_counts(spark.createDataFrame(rows, "lang string, text string")), least=2)
    texts = [b"the cat and the dog " * 50, b"", b"der Hund", b"x" * 333, b""]
    whole = model.code_lengths(texts)
    monkeypatch.setattr(langid, "_PIECE", 7)
    assert np.allclose(model.code_lengths(texts), whole)


def test_sample_is_bounded(spark):
    rows = [(i, f"text number {i}", "en") for i in range(3000)] + [(5, "hot", "de")] * 2000 + [(9000 + i, f"Wort {i}", "de") for i in range(2000)]
    drawn = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200)
    n = Counter(r.lang for r in drawn.collect())
    assert 120 < n["en"] < 280 and 50 < n["de"] < 280


def model_unseen(model, before):
    """What a byte that no sample has gets in this context; capitals are such bytes before they are lower-cased."""
    return np.exp2(-(model.code_lengths([before + b"\xfe"]) - model.code_lengths([before]))).ravel()


def test_gram_rows_do_not_hang_on_how_texts_were_dealt(spark):
    """Of a sample in very many partitions each gram comes out a few times at most, with the same sums."""
    rows = [("en", f"the same few words again and again {i % 3}") for i in range(300)] + [("de", "immer wieder dasselbe"), ("de", "")]
    texts = spark.createDataFrame(rows, "lang string, text string")
    counts = {tuple(r) for r in langid.gram_counts(texts.coalesce(1)).collect()}
    dealt = texts.repartition(60)
    assert {tuple(r) for r in langid.gram_counts(dealt).collect()} == counts
    assert langid.task_counts(dealt).count() <= langid.TASKS * len(counts)


def test_language_query(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op5_ppm_language"](spark, SF).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_odd_languages(odd, empty):
    model = langid.learn(odd)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(rows[d].lang_pred == "und" and rows[d].score == 0 for d in (4, 5, 6, 9))
    assert rows[100].lang_pred == "en"
    kept = langid.keep_known(odd, model, lang="lang")
    assert {r.doc_id: r.lang for r in kept.collect()}[101] == "en"
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {100, 101} and not {r.doc_id for r in kept.collect()} & {4, 5, 6, 9}
    nothing = langid.learn(empty)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


# -- toxicity


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries()["op7_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]  # every label that was not learned from
    caught = [labels[r.doc_id] for r in held if r.predicted]
    assert len(held) > 700 and np.mean(caught) > 0.9  # precision
    assert np.mean([r.predicted for r in held if labels[r.doc_id]]) > 0.8  # recall
    assert np.mean([r.predicted for r in held if not labels[r.doc_id]]) < 0.015


def test_features_see_hidden_insults_and_nearness():
    names, none = toxicity.FEATURES, toxicity.Kinds(frozenset())
    f = dict(zip(names, toxicity.features("You id1ot! WHAT a day", none)))
    assert f["hidden_insults"] == 1 and f["hidden"] > 0 and f["exclaims"] > 0 and f["capitals"] > 0
    close, far = (dict(zip(names, toxicity.features(t, none)))["near_you"] for t in ("you idiot", "you went to the town to see an idiot"))
    assert close > far > 0
    assert toxicity.features("", none)[-1] == 0
    learned = dict(zip(names, toxicity.features("stinkende stink Stinker word", toxicity.Kinds(frozenset({"stink+", "word"})))))
    assert learned["learned_hits"] == 3 and learned["fixed_hits"] == 0


def test_odd_toxicity(odd, empty, spark):
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(30)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.score < 0.5 for r in rows)
    none = toxicity.fit(odd, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


# -- telephony


def test_tables_and_blocks():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    rnd = np.random.default_rng(0)
    blocks = rnd.integers(0, 256, (5, 192), dtype=np.uint8)
    got = telephony.decode_adpcm(blocks)
    for block, pcm in zip(blocks, got):  # one sample after another
        sample, index, out = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(int(block[2]), 88), []
        out.append(sample)
        for byte in block[4:]:
            for nibble in (int(byte) & 15, int(byte) >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                sample = max(-32768, min(32767, sample - change if nibble & 8 else sample + change))
                index = max(0, min(88, index + int(telephony.MOVES[nibble & 7])))
                out.append(sample)
        assert pcm.tolist() == out


@pytest.mark.parametrize("hertz", [300, 1000, 2000, 3000, 3400])
@pytest.mark.parametrize("up", [2, 3])
def test_resampling_keeps_a_tone_and_no_image(hertz, up):
    """The tone comes out as it would have been sampled at the higher rate; its images are 40 dB down and more."""
    n = 4000
    tone = lambda rate, k: 12_000 * np.sin(2 * np.pi * hertz * np.arange(k) / rate)
    wide = telephony.resample(np.rint(tone(8000, n)).astype(np.int16), telephony.phases(up)).astype(float)
    assert (wide[::up] == np.rint(tone(8000, n))).all()
    inner = slice(50 * up, (n - 50) * up)
    assert np.abs(wide - tone(8000 * up, n * up))[inner].max() < 0.012 * 12_000
    spectrum = np.abs(np.fft.rfft(wide[inner] * np.hanning(len(wide[inner]))))
    at = lambda f: spectrum[int(round(f * len(wide[inner]) / (8000 * up))) + np.arange(-3, 4)].max()
    assert 20 * np.log10(at(hertz) / at(8000 - hertz)) > 40
    assert telephony.resample(np.full(100, -777, np.int16)).tolist() == [-777] * 200


def test_adpcm_keeps_a_tone():
    tone = (8000 * np.sin(np.arange(377 * 3) * 0.1)).astype(np.int16).reshape(3, 377)
    again = telephony.decode_adpcm(telephony.encode_adpcm(tone))
    assert np.abs(again[:, 60:].astype(int) - tone[:, 60:]).mean() < 400


def plain_pcm(codec, payload):
    """Samples one after another, by the formats' own rules."""
    out = []
    if codec != "adpcm":
        for byte in payload:
            if codec == "mulaw":
                u = ~byte & 255
                size = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
                out.append(-size if u & 128 else size)
            else:
                a = byte ^ 0x55
                size = (a & 15) << 4
                size = size + 8 if not a >> 4 & 7 else (size + 264) << ((a >> 4 & 7) - 1)
                out.append(size if a & 128 else -size)
        return out
    for at in range(0, len(payload), 192):
        block = payload[at : at + 192]
        sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out.append(sample)
        for byte in block[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                sample = max(-32768, min(32767, sample - change if nibble & 8 else sample + change))
                index = max(0, min(88, index + int(telephony.MOVES[nibble & 7])))
                out.append(sample)
    return out


def test_features_by_hand(spark):
    import hashlib
    import struct

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    some = {r.doc_id: r for r in queries()["op9_telephony"](spark, "/root/testdata/sf0.001").collect()}
    for d, raw in sorted(docs.items(), key=lambda x: len(x[1]))[:60]:
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        codec = ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]
        pcm = plain_pcm(codec, payload)
        (taps,) = telephony.phases(2).tolist()
        beyond = [pcm[0]] * 15 + list(pcm) + [pcm[-1]] * 16
        between = [(sum(h * beyond[i + n] for n, h in enumerate(taps)) + 2**14) >> 15 for i in range(len(pcm))]
        wide = [v for x, y in zip(pcm, between) for v in (x, max(-32768, min(32767, y)))]
        data = struct.pack(f"<{len(wide)}h", *wide)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        assert some[d].feature == f"{codec} samples={len(pcm)} peak={max(map(abs, pcm))} level={sum(map(abs, pcm)) // len(pcm)} crossings={crossings} pcm16k={zlib.crc32(data):08x}"
        assert some[d].pcm == data
        fmt = struct.pack("<HHIIHHHH", 17, 1, 8000, 8000 * 192 // 377, 192, 4, 2, 377) if codec == "adpcm" else struct.pack("<HHIIHHH", 7 if codec == "mulaw" else 6, 1, 8000, 8000, 1, 8, 0)
        body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
        file = b"RIFF" + struct.pack("<I", len(body)) + body
        assert (some[d].media_bytes, some[d].media_sha256) == (len(file), hashlib.sha256(file).hexdigest())


def test_telephony_query(spark):
    import hashlib

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op9_telephony"](spark, SF).collect()
    assert len(rows) == len(docs) and {r.feature.split()[0] for r in rows} == set(telephony.CODECS)
    for r in rows:
        raw = docs[r.doc_id]
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes > r.payload_bytes


def test_odd_media(odd, empty):
    media = telephony.to_media(odd)
    rows = telephony.from_media(media, ["doc_id", "n_bytes"]).collect()
    assert len(rows) == odd.count() and all(len(r.payload) % 192 == 0 and r.payload for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].payload == by_id[5].payload == b" " * 192 and by_id[1].feature == by_id[2].feature
    for r in rows:
        codec = r.feature.split()[0]
        samples = len(r.payload) // 192 * 377 if codec == "adpcm" else len(r.payload)
        assert len(r.pcm) == 4 * samples
    assert telephony.from_media(telephony.to_media(empty), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        telephony.unriff(b"nothing")


def test_counting_asks_the_encoder_only_for_new_words():
    from ratewatch.llm import bpe, edit_counts
    from ratewatch.llm import queries as queries_module

    encoder = bpe.load(open(queries_module.BYTE_BPE, encoding="utf-8").read(), special=False)
    pieces = encoder.pre_tokens("one two three four")
    encoder.know(set(pieces))
    tree = edit_counts.TokenTree(pieces, encoder)
    tree.edit(4, 7, "three")
    encoder.know(tree.unknown())
    asked = []
    tree.encoder = type("E", (), {"pieces": encoder.pieces, "know": lambda self, words: asked.append(words)})()
    assert tree.tokens > 0 and asked == []
