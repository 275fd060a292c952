"""The queries of this subpackage over the shared tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewatch.llm import alignment, bpe, cws, edit_counts, katz, langid, mixing, packing, repair, sharding, simhash, telephony, toxicity
from ratewatch.llm.common import cut, documents

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at 3 or fewer differing bits."""
    found = simhash.near_duplicates(documents(spark, sf_dir), most=3, words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents in 24 shards of nearly equal bytes, and in 25 by the next version of the map."""
    placed, _ = sharding.shard_documents(documents(spark, sf_dir), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "shard_after")


def op3_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return cws.fingerprint_documents(documents(spark, sf_dir))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff scores of every document under trigrams of four fifths of them."""
    return katz.score_documents(documents(spark, sf_dir), train=~katz.held_out(F.col("doc_id")), order=3)


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of the labelled ones."""
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


#: Sequences of op6 and the pipeline: the first quarter of each document is its prompt, without loss; seven eighths of a
#: sequence may bear loss; and it has at most 64 segments.
SEQUENCE, PROMPT_SHARE = packing.Limits(tokens=2048, segments=64, loss_tokens=1792), 0.25


def packed(docs: DataFrame) -> DataFrame:
    """Documents packed into sequences of at most 2048 tokens."""
    pieces = packing.pack_documents(docs, BYTE_BPE, SEQUENCE, end_id=1, prompt_share=PROMPT_SHARE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packed(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four fifths of the labels."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after two edits: a passage replaced in its middle, and a few words added."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    third, tenth = F.floor(n / 3).cast("int"), F.floor(n / 10).cast("int")
    passage = F.struct(third.alias("start"), (third + tenth).alias("stop"), F.reverse(F.left("text", F.floor(n / 20).cast("int"))).alias("text"))
    ending = F.struct((2 * n).alias("start"), (2 * n).alias("stop"), F.concat(F.lit(" "), F.left("text", F.lit(40))).alias("text"))
    counted = edit_counts.count_edits(docs.withColumn("edits", F.array(passage, ending)), BYTE_BPE)
    return counted.select("doc_id", "n_tokens", F.char_length("edited_text").cast("long").alias("edited_chars"), "edited_tokens", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "encoded_again")


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as telephony audio: written, read back, expanded, described; the resampled PCM is the column ``pcm``."""
    media = cut(telephony.to_media(documents(spark, sf_dir)), "media")
    media = media.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    read = telephony.from_media(media, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    tail = F.substring("payload", -16, 16)
    return read.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "pcm")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded text."""
    both = bpe.decode_documents(bpe.encode_documents(documents(spark, sf_dir), BYTE_BPE), BYTE_BPE)
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers aligned over every document, with digests of the groups and scores from the pairs' counts over all."""
    aligned = alignment.align_documents(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE).withColumnRenamed("key", "doc_id")
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).when(F.col("n_a") == 0, "")
    found = alignment.scored(cut(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources takes from every document."""
    mixed = mixing.mix_documents(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: Targets of op12: the level is the highest that any set of the first sources to stop gives.
MIX_TARGETS_SQL = r"""
WITH sized AS (SELECT source, sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS s FROM documents GROUP BY 1),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM sized),
stops AS (SELECT *, 1.5 * sum(s) OVER () AS total, sum(w) OVER () AS every, sum(2.0 * s) OVER k AS given, sum(w) OVER () - sum(w) OVER k AS open
          FROM weighed WINDOW k AS (ORDER BY 2.0 * s / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT greatest(max(total / every), max(CASE WHEN open > 0.5 THEN (total - given) / open END)) AS l FROM stops)
SELECT source, s::BIGINT AS source_size, round(least(2.0 * s, w * l), 6)::DOUBLE AS target FROM weighed CROSS JOIN level
"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op12 aims at: the words to take from each source."""
    found = mixing.targets(cut(mixing.records(documents(spark, sf_dir)), "mix-records"), weights=(5, 2, 1), share=1.5, most=2.0)
    return found.select("source", "source_size", F.round("target", 6).alias("target"))


def op13_lattice_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations with their faults and the cheapest edits that repair them."""
    summary, _ = repair.repair(repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return summary


#: What op13 returns: damage, faults, and the repair as a recursion over rows with the best path to each of four states.
OP13_SQL = r"""
WITH RECURSIVE spelled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
summed AS (  -- crc32: each byte goes in, then eight shifts
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(name, ''),
         lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) ELSE xor(h >> 1, CASE WHEN h & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END) END),
         4294967295::BIGINT) % 20 AS kind
  FROM spelled),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM summed WHERE kind <> 0),
marked AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS i,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged),
faulty AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair
  FROM marked),
counted AS (
  SELECT conv_id, max(n) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank,
         count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
-- the best (cost, audit) that leads to each state before row n + 1: nothing yet, after s, after u, after a; null: no way
paths AS (
  SELECT conv_id, 0::BIGINT AS n, {'c': 0, 'a': ''} AS z, NULL::STRUCT(c INTEGER, a VARCHAR) AS s, NULL::STRUCT(c INTEGER, a VARCHAR) AS u, NULL::STRUCT(c INTEGER, a VARCHAR) AS v
  FROM counted
  UNION ALL
  SELECT conv_id, n, {'c': oz.c + 3, 'a': oz.a || 'D'}, list_min([{'c': os.c + 3, 'a': os.a || 'D'}, CASE WHEN stays AND i = 's' THEN {'c': oz.c + more, 'a': oz.a || 'K'} END]),
         list_min([{'c': ou.c + 3, 'a': ou.a || 'D'}] || list_transform([oz, os, ov], lambda x: CASE WHEN stays THEN {'c': x.c + more + CASE WHEN i = 'u' THEN 0 ELSE 2 END, 'a': x.a || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END} END)),
         list_min([{'c': ov.c + 3, 'a': ov.a || 'D'}, CASE WHEN stays THEN {'c': ou.c + more + CASE WHEN i = 'a' THEN 0 ELSE 2 END, 'a': ou.a || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END} END])
  FROM (
    SELECT p.conv_id, f.n, f.i, fault NOT IN ('b', 'd') AS stays, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS more, z AS oz, s AS os,
           list_min([u, {'c': z.c + 2, 'a': z.a || 'I'}, {'c': s.c + 2, 'a': s.a || 'I'}, {'c': v.c + 2, 'a': v.a || 'I'}]) AS ou,
           list_min([v, {'c': u.c + 2, 'a': u.a || 'I'}, {'c': z.c + 4, 'a': z.a || 'II'}, {'c': s.c + 4, 'a': s.a || 'II'}]) AS ov
    FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1)),
ended AS (
  SELECT p.conv_id, list_min([z, v, {'c': u.c + 2, 'a': u.a || 'I'}, {'c': s.c + 4, 'a': s.a || 'II'}]) AS best
  FROM paths p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.n = c.rows_),
letters AS (
  SELECT conv_id, unnest(string_split(best.a, '')) AS letter, unnest(range(1, length(best.a) + 1)) AS pos FROM ended WHERE best.a <> ''),
used AS (
  SELECT *, count_if(letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM letters),
kept AS (
  SELECT l.conv_id, pos, letter, CASE WHEN letter <> 'I' THEN f.text ELSE '' END AS text, f.role,
         row_number() OVER (PARTITION BY l.conv_id ORDER BY pos) AS place
  FROM used l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n WHERE letter <> 'D'),
named AS (
  SELECT conv_id, pos, text, CASE WHEN letter = 'K' THEN role WHEN
         (place + max(CASE WHEN place = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role
  FROM kept),
told AS (SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY pos)) AS digest FROM named GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_virtual_slots": op2_virtual_slots,
        "op3_weighted_sampling": op3_weighted_sampling,
        "op4_katz": op4_katz,
        "op5_ppm_language": op5_ppm_language,
        "op6_vector_packing": op6_vector_packing,
        "op7_toxicity": op7_toxicity,
        "op8_edit_counts": op8_edit_counts,
        "op9_telephony": op9_telephony,
        "op10_bpe": op10_bpe,
        "op11_pair_bitmaps": op11_pair_bitmaps,
        "op12_pivotal_mixing": op12_pivotal_mixing,
        "op13_lattice_repair": op13_lattice_repair,
        "mix_targets": mix_targets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op13_lattice_repair": OP13_SQL, "mix_targets": MIX_TARGETS_SQL}
