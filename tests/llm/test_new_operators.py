"""Alignment, mixing and conversation repair: brute force, SQL, odd rows, invariants."""

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ratewatch.llm import alignment, mixing, queries, repair
from ratewatch.llm.bpe import byte_letters

SF = "/root/testdata/sf0.01"


# -- op11


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def units():
    with open(queries.BYTE_BPE, encoding="utf-8") as f, open(queries.PIECE_BPE, "rb") as g:
        return alignment.load(f.read(), g.read())


def aligned(text, libraries):
    """n_a, n_b, groups, and the links, token by token."""
    a_lib, b_lib = libraries
    letters = byte_letters()
    if not text:
        return 0, 0, [], []
    a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
    spell_a = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
    pieces = [b_lib.id_to_piece(i) for i in b]
    spell_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    if b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
        return 0, 0, [], []
    end_a, end_b = np.cumsum([len(x) for x in spell_a]).tolist(), np.cumsum([len(x) for x in spell_b]).tolist()
    links, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        links.append((a[i], b[j]))
        x, y = end_a[i], end_b[j]
        i, j = i + (x <= y), j + (y <= x)
    shared = sorted(set(end_a) & set(end_b))
    at_a, at_b = ([0, *(bisect_right(ends, e) for e in shared)] for ends in (end_a, end_b))
    groups = [(a[p:q], b[x:y]) for p, q, x, y in zip(at_a, at_a[1:], at_b, at_b[1:])]
    return len(a), len(b), groups, links


def text_of(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


ALPHABET = [*"aeinrst  \n\n\t.,'0123éüß日本🙂 ▁ﬁ<>|x\r\0\x85  ", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "'s", "'ll", "  "]


def test_alignment_of_odd_strings(units, libraries):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.choice([1, 3, 10, 60]))) for _ in range(1500)]
    texts += ["", "x" * 5000, " " * 3000 + "a", "a " * 2000 + "b", "\n" * 500, "ab " * 60_000 + "end"]
    counts, groups, of, number = alignment.align(units, texts)
    for i, t in enumerate(texts):
        if len(t) > 50_000:
            assert counts[i, 0] > 50_000 and counts[i, 0] + counts[i, 1] - counts[i, 2] == counts[i, 3]
            continue
        n_a, n_b, wanted, links = aligned(t, libraries)
        got = [(int(p) >> 32, int(p) & 0xFFFFFFFF) for u in number[of == i].tolist() for p in units.pairs[units.ends[u] : units.ends[u + 1]]]
        assert (*counts[i].tolist(), groups[i], sorted(got)) == (n_a, n_b, len(wanted), len(links), text_of(wanted), sorted(links)), repr(t)


def test_words_that_come_often_stay(libraries):
    with open(queries.BYTE_BPE, encoding="utf-8") as f, open(queries.PIECE_BPE, "rb") as g:
        small = alignment.Units(alignment.Tokenizers(f.read(), g.read()), most=50)
    rnd = random.Random(4)
    for _ in range(30):
        texts = [" ".join(rnd.choice(["the", "rate", f"w{rnd.randrange(400)}"]) for _ in range(40)) for _ in range(3)]
        counts, groups, *_ = alignment.align(small, texts)
        for c, g, t in zip(counts.tolist(), groups, texts):
            n_a, n_b, wanted, links = aligned(t, libraries)
            assert (c, g) == ([n_a, n_b, len(wanted), len(links)], text_of(wanted))


def test_bitmaps_round_trip():
    rnd = np.random.default_rng(1)
    for _ in range(40):
        runs = [np.sort(rnd.choice(4096, rnd.integers(1, rnd.choice([2, 10, 600, 4097])), replace=False)) for _ in range(20)]
        begins, data = alignment.pack(np.concatenate(runs), np.cumsum([0] + [len(x) for x in runs[:-1]]))
        documents, who = alignment.unpack(data, np.diff(np.r_[begins, len(data)]))
        for i, run in enumerate(runs):
            assert sorted(documents[who == i].tolist()) == run.tolist()


def brute_scores(rows, libraries):
    """Rows as op11 returns them, from (doc_id, text)."""
    found = [(d, *aligned(t, libraries)) for d, t in rows]
    count = Counter(p for *_, links in found for p in links)
    best: dict[int, int] = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    digest = lambda g: hashlib.sha256(text_of(g).encode()).hexdigest() if g else ""
    return [(d, n_a, n_b, len(g), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest(g)) for d, n_a, n_b, g, links in found]


def op11_rows(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def test_op11_against_brute_force(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    wanted = brute_scores([(r.doc_id, r.text) for r in docs], libraries)
    assert op11_rows(queries.op11_pair_bitmaps(spark, SF)) == sorted(wanted, key=repr)


def test_op11_blocks_and_odd_rows(spark, libraries, odd, empty, monkeypatch, tmp_path):
    """Many small blocks, of one text each at the end, give the same scores; nulls, repeated rows and clashing names."""
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    wanted = sorted(brute_scores(rows, libraries), key=repr)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_rows(queries.op11_pair_bitmaps(spark, str(tmp_path))) == wanted
    aligned_rows = alignment.align_documents(odd.repartition(5), queries.BYTE_BPE, queries.PIECE_BPE).persist()
    pairs = Counter(p for _, t in rows for p in aligned(t, libraries)[3])
    documents = Counter(p for _, t in rows for p in set(aligned(t, libraries)[3]))
    got = {(r.pair >> 32, r.pair & 0xFFFFFFFF): (r.documents, r.links) for r in alignment.pair_counts(aligned_rows).collect()}
    assert got == {p: (documents[p], n) for p, n in pairs.items()}
    aligned_rows.unpersist()
    assert alignment.scored(alignment.align_documents(empty, queries.BYTE_BPE, queries.PIECE_BPE)).count() == 0


# -- op12


def test_words_are_counted_as_the_pattern_does(spark):
    texts = ["", " ", "a", " a b\t\n c ", "日本 x　y", "\x1cq\x0bz", "x" * 100_000 + " y", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.words_of(F.col("t")).alias("n")).collect()
    assert [r.n for r in sorted(got)] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def brute_targets(sizes, weights, share, most):
    """Round after round: what is above its limit stops there, the excess is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    rest = share * sum(sizes.values())
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(open_):
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.remove(s)
    return target


def check_mix(rows, mixed, weights=(5, 2, 1), share=1.5, most=2.0):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += words(r["text"])
        largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
    wanted = brute_targets(dict(sizes), weights, share, most)
    assert Counter((r.doc_id, r.source, r.size) for r in mixed) == Counter((r["doc_id"], r["source"], words(r["text"])) for r in rows)
    taken = Counter()
    for r in mixed:
        assert r.target == pytest.approx(wanted[r.source], rel=1e-9, abs=1e-6) and r.source_size == sizes[r.source]
        ratio = r.target / r.source_size if r.source_size else 0
        assert int(ratio) <= r.copies <= -(-ratio // 1) if r.size else True
        taken[r.source] += r.size * r.copies
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= largest[s] + 1e-6


def test_op12_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix_documents(docs).collect()
    check_mix([r.asDict() for r in docs.collect()], mixed)
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert sorted(mixed, key=repr) == sorted(again, key=repr)
    check_mix([r.asDict() for r in docs.collect()], mixing.mix_documents(docs, weights=(1, 3), share=0.4, most=1.0).collect(), (1, 3), 0.4, 1.0)


def test_targets_match_sql(spark, duck):
    got = {(r.source, r.source_size, r.target) for r in queries.mix_targets(spark, SF).collect()}
    assert got == set(duck.sql(queries.MIX_TARGETS_SQL).project("source, source_size, target").fetchall())


def test_op12_odd_rows_and_repeats(spark, odd, empty):
    check_mix([r.asDict() for r in odd.select("doc_id", "source", "text").collect()], mixing.mix_documents(odd).collect())
    many = spark.createDataFrame([(1, "a b c", "hot")] * 500 + [(None, "a b", None)] * 40 + [(i, f"x{i} y z w", "big") for i in range(900)], "doc_id long, text string, source string").repartition(6)
    mixed = mixing.mix_documents(many).collect()
    check_mix([r.asDict() for r in many.collect()], mixed)
    assert sorted(mixed, key=repr) == sorted(mixing.mix_documents(many.repartition(3)).collect(), key=repr)
    assert mixing.mix_documents(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target) for r in mixing.mix_documents(none).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_op12_is_fair(spark):
    """Over seeds each document is taken as often as its source's target says."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "s" if i % 3 else "t") for i in range(60)], "doc_id long, text string, source string")
    times, runs = Counter(), 4
    for seed in range(runs):
        mixing.SEED = seed
        for r in mixing.mix_documents(docs, weights=(1,), share=0.5, most=1.0).collect():
            times[r.doc_id] += r.copies
    mixing.SEED = 20
    assert sum(times.values()) == pytest.approx(runs * 30, rel=0.1)
    assert len(times) == 60 and max(times.values()) - min(times.values()) >= 2


def test_op12_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = mixing.mix_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in text and "InArrow" not in text and "InPandas" not in text


# -- op13


def brute_repair(initials, faults):
    """The least (cost, audit) over all rows by a table of four states."""
    labels = {0: (0, "")}

    def inserted(labels):
        out = dict(labels)
        for _ in range(4):
            for q, (cost, audit) in list(out.items()):
                to, new = repair._STEP[q, repair._NEXT[q]], (cost + 2, audit + "I")
                out[to] = min(out.get(to, new), new)
        return out

    for i, fault in zip(initials, faults):
        new: dict = {}
        for q, (cost, audit) in inserted(labels).items():
            ways = [(q, cost + 3, "D")]
            if fault not in ("b", "d"):
                more = cost + (fault == "t")
                ways += [(repair._STEP[q, repair._NEXT[q]], more + 2, "R"), *([(repair._STEP[q, i], more, "K")] if (q, i) in repair._STEP else [])]
            for to, c, letter in ways:
                new[to] = min(new.get(to, (c, audit + letter)), (c, audit + letter))
        labels = new
    labels = inserted(labels)
    return min(labels[q] for q in (0, 3) if q in labels)


def test_lattice_against_a_table_of_states():
    rnd = random.Random(3)
    for _ in range(3000):
        n = rnd.randrange(0, 10)
        initials = [rnd.choice(["s", "u", "a", "u", "a", "t", "", " "]) for _ in range(n)]
        faults = [rnd.choice(["", "", "", "t", "b", "d"]) for _ in range(n)]
        wanted = brute_repair(initials, faults)
        assert repair.Lattice(initials, faults).cheapest() == wanted
        cuts = sorted({0, n, *(rnd.randrange(0, n + 1) for _ in range(3))})
        cost, chosen = repair.choose([repair.Lattice(initials[s:e], faults[s:e], tail=False).between() for s, e in zip(cuts, cuts[1:])])
        assert n == 0 or (cost, "".join(a for _, a in chosen)) == wanted
    long = [rnd.choice("ua") for _ in range(600)], [rnd.choice(["", "t", "b"]) for _ in range(600)]
    assert repair.Lattice(*long).cheapest() == brute_repair(*long)


ROWS13 = "conv_id long, turn long, role string, text string"


def compared(spark, rows, most=repair.SEGMENT):
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    c.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    c.sql("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM given")
    wanted = c.sql(queries.OP13_SQL)
    names = wanted.columns
    summary, texts = repair.repair(repair.damage(spark.createDataFrame(rows, ROWS13).repartition(5)), most)
    got = sorted((tuple(r[n] for n in names) for r in summary.collect()), key=repr)
    assert got == sorted(wanted.fetchall(), key=repr)
    return summary, texts


def test_op13_matches_sql(spark, duck):
    found = queries.op13_lattice_repair(spark, SF)
    wanted = duck.sql(queries.OP13_SQL)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert sorted((tuple(r[c] for c in wanted.columns) for r in found.collect()), key=repr) == sorted(wanted.fetchall(), key=repr)


def odd_conversations():
    rnd = random.Random(6)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "system", "Be kind."), (1, 0, "user", "A."), (1, 0, "user", "A."), (1, 1, "assistant", "B"), (2, 0, "tool", " \n"), (3, 0, "", "x."), (4, 5, "assistant", "long " * 30_000 + ".")]
    for conv in range(10, 60):
        rows += [(conv, t, rnd.choice(["user", "assistant", "system", "other"]), rnd.choice(["Yes.", "no", "", "Wait! ", f"number {t}?", "Zwei Wörter.\r\n"])) for t in range(rnd.randrange(1, 12))]
    rows += [(7, t, "user" if t % 3 else "assistant", f"turn {t}." if t % 11 else "same.") for t in range(700)]  # a third of all rows and more
    return rows


def test_op13_odd_rows_and_long_conversations(spark):
    """Nulls, ties of turn, repeated rows, and a conversation that lies in many segments and partitions."""
    summary, texts = compared(spark, odd_conversations(), most=64)
    pieces = [r.repaired for r in texts.where("conv_id = 7").orderBy("segment").collect()]
    assert len(pieces) > 9
    digest = summary.where("conv_id = 7").first().repaired_sha256
    assert hashlib.sha256("\n".join(p for p in pieces if p is not None).encode()).hexdigest() == digest


def test_op13_rows_that_all_go(spark):
    dropped = [(c, t, "user", "Hi.") for c in range(400) for t in range(1)]
    summary, _ = compared(spark, dropped)
    gone = summary.where("audit = '' and cost = 0").collect()
    assert gone and all(r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in gone)
    empty = repair.repair(repair.damage(spark.createDataFrame([], ROWS13)))
    assert empty[0].count() == 0 and empty[1].count() == 0
    more = spark.createDataFrame([(1, 0, "user", "Hi.", "x")], ROWS13 + ", segment string").withColumn("a.b", F.lit(1)).withColumn("fault", F.lit("z"))
    assert repair.repair(repair.damage(more))[0].count() == 1
