import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratewatch.llm import bpe, edit_counts, packing
from ratewatch.llm.queries import BYTE_BPE, PROMPT_SHARE, SEQUENCE, queries

SF = "/root/testdata/sf0.01"

SPEC = open(BYTE_BPE, encoding="utf-8").read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def mixed_texts(n=3000):
    rnd = random.Random(5)
    letters = "ab '\nst\t.1é \x85\x1c"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(n)] + ["a<|endoftext|>b", "!!<|endoftext|>", "a" * 4000, "ab" * 2000, " \n" * 300, "日本語 テキスト🙂", "don't I'll've"]


def test_ids_and_texts_equal_the_librarys(library):
    own, texts = bpe.ByteBPE(SPEC), mixed_texts()
    for text, wanted, ids in zip(texts, library.encode_batch(texts, add_special_tokens=False), own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == wanted.ids, text[:50]
        assert own.decode(ids) == library.decode(wanted.ids, skip_special_tokens=False)
    assert own.seen["merged"] < own.seen["words"]


def test_every_token_encodes_itself():
    own = bpe.ByteBPE(SPEC)
    assert (own.merge_all(list(own.token_of))[0] == 1).all()


def test_compatible_is_what_merging_says():
    own, rnd = bpe.ByteBPE(SPEC), random.Random(1)
    tokens = list(own.token_of.items())
    pairs = [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(3000)]
    said = own.compatible(np.array([a[1] for a, _ in pairs]), np.array([b[1] for _, b in pairs]))
    for (a, b), ok in zip(pairs, said):
        sizes, flat = own.merge_all([a[0] + b[0]])
        assert ok == (flat.tolist() == [a[1], b[1]])


def test_query_over_documents(spark, library):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op10_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    wanted = dict(zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False)))
    for r in rows:
        ids = np.array(wanted[r.doc_id].ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(odd, empty, library):
    rows = bpe.decode_documents(bpe.encode_documents(odd, BYTE_BPE), BYTE_BPE).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        assert r.text == texts[r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids
    assert bpe.encode_documents(empty, BYTE_BPE).count() == 0


# -- edits


def test_edits_equal_counting_anew():
    own, rnd = bpe.ByteBPE(SPEC, special=False), random.Random(3)
    letters = "ab  '\n\nst\t1é."
    make = lambda n: "".join(rnd.choice(letters) for _ in range(n))

    def split(text):
        pieces = own.pre_tokens(text)
        if missing := [p for p in set(pieces) if p not in own.pieces]:
            own.learn(missing)
        return pieces, sum(len(own.pieces[p]) // 4 for p in pieces)

    for k in range(400):
        text = make(rnd.choice([0, 1, 5, 30, 300, 3000 if k % 20 == 0 else 100]))
        tree = edit_counts.TokenTree(split(text)[0], own)
        for _ in range(4):
            start = rnd.randint(0, len(text) + 2)
            stop, new = start + rnd.choice([0, 1, 3, 20, 200]), make(rnd.choice([0, 1, 2, 10, 50]))
            tree.edit(start, stop, new)
            start = min(start, len(text))
            text = text[:start] + new + text[max(start, min(stop, len(text))) :]
            assert tree.text() == text
            assert (tree.tokens, tree.chars) == (split(text)[1], len(text))


def test_edit_encodes_only_what_it_touches(spark):
    rows = queries()["op8_edit_counts"](spark, SF).where("edited_chars > 5000").collect()
    assert rows and all(r.encoded_again < r.edited_chars / 4 for r in rows)


def test_edit_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library.encode_special_tokens = True
    try:
        for r in queries()["op8_edit_counts"](spark, SF).collect():
            t = docs[r.doc_id]
            n = len(t)
            edited = t[: n // 3] + t[: n // 20][::-1] + t[n // 3 + n // 10 :] + " " + t[:40]
            assert (r.n_tokens, r.edited_chars, r.edited_tokens) == (len(library.encode(t, add_special_tokens=False).ids), len(edited), len(library.encode(edited, add_special_tokens=False).ids))
    finally:
        library.encode_special_tokens = False


def test_edits_of_odd_rows(odd, empty, library):
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("stop"), F.lit("new").alias("text")), F.struct(F.lit(None).cast("int").alias("start"), F.lit(5).alias("stop"), F.lit("x").alias("text")))
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in edit_counts.count_edits(odd.withColumn("edits", edits), BYTE_BPE).collect():
        t = texts[r.doc_id]
        assert r.edited_text == t[:2] + "new" + t[5:]
    assert edit_counts.count_edits(odd.withColumn("edits", F.lit(None).cast("array<struct<start:int,stop:int,text:string>>")), BYTE_BPE).where("edited_tokens <> n_tokens").count() == 0
    assert edit_counts.count_edits(empty.withColumn("edits", edits), BYTE_BPE).count() == 0


# -- packing


def check_packing(rows, limits):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(r.loss_tokens for r in pieces) <= limits.loss_tokens
    return by_doc, by_sequence


def test_pieces_hold_each_id_once(odd, empty, library):
    limits = packing.Limits(tokens=64, segments=3, loss_tokens=40)
    rows = packing.pack_documents(odd, BYTE_BPE, limits, pool=8, least_cut=4).collect()
    by_doc, _ = check_packing(rows, limits)
    for r in odd.collect():
        wanted = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[(r.doc_id, len(wanted))], key=lambda p: p.start)
        copies = 2 if r.doc_id == 3 else 1
        assert sum(p.length for p in pieces) == copies * len(wanted)
        if copies == 1:
            assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces]).tolist() == wanted
            assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
    assert packing.pack_documents(empty, BYTE_BPE).count() == 0


def test_loss_limit_counts_only_ids_with_loss(spark):
    docs = spark.createDataFrame([(i, "word " * 30, 20) for i in range(20)], "doc_id long, text string, prompt int").coalesce(1)
    limits = packing.Limits(tokens=128, segments=10, loss_tokens=24)
    rows = packing.pack_documents(docs, BYTE_BPE, limits, loss_from="prompt").collect()
    check_packing(rows, limits)
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.loss_tokens
    assert set(whole.values()) == {rows[0].doc_tokens - 20}


def test_little_padding(spark):
    rows = queries()["op6_vector_packing"](spark, SF).collect()
    _, sequences = check_packing(rows, SEQUENCE)
    loads = [sum(r.loss_tokens for r in s) for s in sequences.values()]
    assert np.mean([n == SEQUENCE.loss_tokens for n in loads]) > 0.1  # the loss limit decides
    padded = sum(2048 - n for s in sequences.values() if (n := sum(r.length for r in s)) & (n - 1))
    assert padded < 0.005 * sum(r.length for r in rows)


@pytest.mark.parametrize("lengths", [[3], [1], [2, 3000], [1, 40, 700]])
def test_little_padding_whatever_the_lengths(spark, lengths):
    """Very short texts end sequences by their number; such a sequence gets a size without padding."""
    texts = [" ".join(["rate"] * lengths[i % len(lengths)]) for i in range(20_000 if max(lengths) < 10 else 600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(docs, BYTE_BPE, SEQUENCE, prompt_share=0.25).collect()
    by_doc, sequences = check_packing(rows, SEQUENCE)
    assert all(sum(p.length for p in pieces) == n for (_, n), pieces in by_doc.items())
    total = sum(r.length for r in rows)
    padded = sum(2048 - n for s in sequences.values() if (n := sum(r.length for r in s)) & (n - 1))
    assert padded < 0.01 * total
    if max(lengths) < 10:
        assert np.mean([len(s) == SEQUENCE.segments for s in sequences.values()]) > 0.1


def test_packing_query_against_the_library(spark, library):
    import zlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    wanted = dict(zip(docs, library.encode_batch(list(docs.values()), add_special_tokens=False)))
    by_doc = {}
    for r in queries()["op6_vector_packing"](spark, SF).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for d, pieces in by_doc.items():
        ids = np.array([*wanted[d].ids, 1], "<u4")
        at, free = 0, int(PROMPT_SHARE * len(ids))
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            assert p.loss_tokens == max(0, at + p.length - max(at, free))
            at += p.length
        assert at == len(ids)


def test_ids_of_very_long_texts(library):
    words = mixed_texts()
    made = packing.Ids(SPEC)
    for text in ("word don't  12 é\n" * 30_000, " ".join(words) * 20, "<|endoftext|> x " * 30_000):
        assert len(text) > packing.LONG_TEXT
        assert made(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_caches_stay_bounded_and_right(library):
    own = bpe.ByteBPE(SPEC, max_cached=50)
    texts = mixed_texts(600)
    for at in range(0, len(texts), 20):
        some = texts[at : at + 20] + texts[:5]
        for wanted, ids in zip(library.encode_batch(some, add_special_tokens=False), own.encode(some)):
            assert np.frombuffer(ids, "<u4").tolist() == wanted.ids


def test_limits_are_checked(odd):
    with pytest.raises(ValueError):
        packing.pack_documents(odd, BYTE_BPE, packing.Limits(tokens=0))
