import random

import corpus_pipeline
from ratewatch.llm import near_copies

SF = "/root/testdata/sf0.01"


def test_pipeline_keeps_clean_documents_and_drops_the_others(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == documents.columns
        from ratewatch.llm.common import cut

        docs = cut(after, f"test-{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = {r.doc_id: r for r in documents.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    plain = [d for d in rows if labels.get(d) == 0]
    assert len(kept["language"]) > 0.995 * len(rows)
    assert len([d for d in plain if d in kept["toxicity"]]) > 0.97 * len(plain)
    texts = [rows[d].text for d in kept["near_duplicates"]]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept["near_duplicates"]


def test_language_rejects_junk_and_keeps_its_prediction(spark):
    rnd = random.Random(1)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [
        "".join(rnd.choice("0123456789abcdef") for _ in range(2000)),
        " ".join(str(rnd.randrange(10**12)) for _ in range(100)) + " x",
        "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000)),
        "Съешь ещё этих мягких французских булок " * 20,
        "%%% ### $$$ 123",
        "",
        None,
    ]
    added = documents.unionByName(spark.createDataFrame([(-1 - i, t, None, None, None) for i, t in enumerate(junk)], documents.schema))
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, added, SF).collect()}
    assert min(kept) >= 0 and len(kept) > 0.995 * documents.count()
    assert None not in kept.values() and "und" not in kept.values()


def test_stages_take_odd_rows_and_names(spark, odd):
    """Nulls, empty and long texts, ties, repeated rows, and further columns with dots and with names used inside."""
    docs, counts = odd, [odd.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == odd.columns
        rows = after.collect()
        docs = spark.createDataFrame(rows, odd.schema)
        counts.append(len(rows))
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[3] < counts[2]
    assert corpus_pipeline.pack(spark, docs, SF).select("doc_id").distinct().count() >= 30


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def shingles(text):
    w = text.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    """The smallest index of each text's group, by all pairs."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 10 * both >= 8 * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return [top(i) for i in range(len(texts))]


def edited(words, n, rnd):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"edit{rnd.randrange(10**6)}"
    return " ".join(out)


def groups_of(rows, docs, **how):
    found = rows.join(near_copies.linked(docs, rows, **how), "node", "left").selectExpr("key", "coalesce(root, node) as root").collect()
    least = {}
    for r in found:
        least[r.root] = min(least.get(r.root, r.key), r.key)
    return [d for _, d in sorted((r.key, least[r.root]) for r in found)]


def test_recall_over_documents(spark):
    """Of pairs of documents at a similarity of 0.8 or more, all but one in a hundred share a group, and no group is false."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.component for r in near_copies.near_copies(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {d: {hash(x) for x in shingles(t)} for d, t in texts.items()}
    having = {}
    for d, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(d)
    pairs = joined = 0
    for d in (d for d in texts if d % 10 == 0 and sets[d]):  # against all rows
        shared = {}
        for x in sets[d]:
            for e in having[x]:
                shared[e] = shared.get(e, 0) + 1
        for e, n in shared.items():
            if e != d and texts[e] != texts[d] and 10 * n >= 8 * (len(sets[d]) + len(sets[e]) - n):
                pairs += 1
                joined += found[d] == found[e]
    assert pairs > 20 and joined >= 0.99 * pairs


def test_a_family_of_near_misses_loses_no_link(spark):
    """Copies of one text with five words replaced in each: most pairs are a little below 0.8, few reach it."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    texts = [edited(base, 5, rnd) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_components(texts)
    assert len(set(expected)) < len(texts) - 5
    assert groups_of(near_copies.sketches(docs), docs) == expected


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(5)
    texts = [f"short text {i} here" for i in range(60)] + ["", "  "]
    for k in range(60):  # copies at similarities from 0.5 to 1, and chains of edits
        base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(base), *(edited(base, n, rnd) for n in (1, 2, 3, 4, 5, 6, 8, 10))]
    texts += [edited(base, 2, rnd) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert groups_of(near_copies.sketches(docs), docs) == brute_components(texts)
    assert groups_of(near_copies.sketches(docs), docs, most=10) == brute_components(texts)  # buckets that are cut
    found = {r.doc_id: r.component for r in near_copies.near_copies(docs).collect()}
    least = {}
    for d, c in found.items():
        least[c] = min(least.get(c, d), d)
    expected = brute_components(texts)
    assert [least[found[d]] for d in range(len(texts))] == expected
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(expected))


def test_judging_gives_a_forest_and_no_row_for_each_pair(spark):
    """Hundreds of copies that are all a little too different, and one group: all pairs are judged, links alone come out."""
    from pyspark.sql import functions as F

    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    texts = [edited(base, 6, rnd) for _ in range(250)] + [edited(base, 1, rnd) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_copies.sketches(docs)
    asked = rows.join(docs, F.col("key") == F.col("doc_id")).select(F.lit(1).alias("key"), "node", F.col("node").alias("root"), "wide", F.lit(None).cast("int").alias("side"), "text")
    links = near_copies.judged(asked).collect()
    assert len(links) < len(texts)
    assert len(links) == len(texts) - len(set(brute_components(texts)))
    again = near_copies.linked(docs, rows, most=40)  # parts meet in twos
    found = {r.key: r.root for r in rows.join(again, "node", "left").selectExpr("key", "coalesce(root, node) as root").collect()}
    assert len(set(found.values())) == len(set(brute_components(texts)))
