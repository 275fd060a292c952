"""Document fingerprints by consistent weighted sampling, in DataFrame code only.

A document is a bag of terms (lower-cased words) weighted by their counts. For each of ``samples`` samples k a term s
of weight w draws r, c ~ Gamma(2, 1) and beta ~ Uniform(0, 1) from hashes of (s, k) alone, and

    t = floor(ln w / r + beta),   ln y = r (t - beta),   ln a = ln c - ln y - r.

The term with the smallest ln a is the sample, known by (s, t). Two documents agree in a sample with probability
sum(min(w)) / sum(max(w)), their generalised Jaccard similarity. A fingerprint is 4 hex digits of each sample's hash.

A document and its edited copy are fingerprinted together: words before the edit are counted once for both.

Defined results: a null text counts as empty; a text without words has only the digits ffff, and is like any other such
text; rows equal in doc_id and text are one document whose result is given for each row; equal doc_ids with other texts
follow one another by a hash of the text; an empty table gives an empty table. doc_id is an integer; null comes last.
Texts of any length are counted whole; of terms with the same least draw it makes no difference which one is meant; further
columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ratewatch.llm.common import WORD_PATTERN, cut

SAMPLES = 64
_GAP = "[\\x20\\x09-\\x0D]+"
_KEY = ["id", "th"]


def _unit(bits: Column, width: int) -> Column:
    """A number in (0, 1) from so many bits."""
    return (bits.bitwiseAND(F.lit((1 << width) - 1)).cast("double") + 0.5) / float(1 << width)


def _draw(term: Column, sample: Column, log_w: Column) -> Column:
    """ln a as a long; null if log_w is null. It tells (s, t) apart as well: no two of them have the same ln a."""
    h1, h2 = F.xxhash64(term, sample), F.xxhash64(sample, term)
    r = -F.ln(_unit(F.shiftrightunsigned(h1, 40), 24) * _unit(F.shiftrightunsigned(h1, 16), 24))
    log_c = F.ln(-F.ln(_unit(F.shiftrightunsigned(h2, 42), 22) * _unit(F.shiftrightunsigned(h2, 20), 22)))
    beta = _unit(h2, 20)
    return F.floor((log_c - r * (F.floor(log_w / r + beta) - beta + 1)) * float(1 << 40))


def _lower(text: str) -> Column:
    """Lower case that doesn't hang on where a piece of text ends: a sigma is the same one at the end of a word."""
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, th, text``: th tells texts under one id apart."""
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(body).alias("th"), body.alias("text"))


def neighbours(rows: DataFrame) -> DataFrame:
    """``id, th, n_chars, n, next_id, next_th``: the next document in descending order, the first after the last.

    Ranges of ids are numbered within; where a range ends, the first document of the next range follows. That takes
    one row a range.
    """
    distinct = rows.select("id", "th", F.char_length("text").cast("long").alias("n_chars")).groupBy("id", "th", "n_chars").agg(F.count("*").alias("n"))
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(distinct.repartitionByRange(ranges, F.desc("id"), F.desc("th")).withColumn("part", F.spark_partition_id()), "ordered")
    inside = W.partitionBy("part").orderBy(F.desc("id"), F.desc("th"))
    heads = placed.groupBy("part").agg(F.max(F.struct("id", "th")).alias("head"))
    over = W.partitionBy(F.lit(0)).orderBy("part")  # one row a range
    after = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("after"))
    out = placed.withColumn("lead", F.lead(F.struct("id", "th")).over(inside)).join(after, "part")
    return out.select("id", "th", "n_chars", "n", F.coalesce("lead", "after").alias("next")).select("id", "th", "n_chars", "n", F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th"))


def edited(rows: DataFrame, order: DataFrame) -> DataFrame:
    """``id, th, n_chars, keep, own, other``: the text up to the edit, what was there, and what comes instead.

    Texts are dealt by their key once; both joins and the counting of words later use that.
    """
    once = rows.withColumn("row", F.row_number().over(W.partitionBy(*_KEY).orderBy("th"))).where("row = 1").drop("row")
    wanted = order.select(F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.col("id").alias("for_id"), F.col("th").alias("for_th"), "n_chars")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    heads = once.join(wanted, _KEY).select(F.col("for_id").alias("id"), F.col("for_th").alias("th"), "n_chars", F.left("text", third).alias("other"))
    stay = (F.col("n_chars") - third).cast("int")
    return once.join(heads, _KEY).select(*_KEY, "n_chars", F.left("text", stay).alias("keep"), F.substring("text", stay + 1, third).alias("own"), "other")


def fingerprint_pairs(parts: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``id, th, fp, edited_fp`` of texts with at least a word in either version."""
    keep = _lower("keep")
    broken = F.reverse(F.regexp_extract(F.reverse(keep), f"^{WORD_PATTERN}", 0))  # a word that the edit may cut
    split = parts.select(*_KEY, keep.alias("keep"), broken.alias("broken"), _lower("own").alias("own"), _lower("other").alias("other"))
    words = split.select(
        *_KEY,
        F.split(F.expr("left(keep, char_length(keep) - char_length(broken))"), _GAP).alias("both"),
        F.split(F.concat("broken", "own"), _GAP).alias("first"),
        F.split(F.concat("broken", "other"), _GAP).alias("second"),
    )
    each = words.select(*_KEY, F.size("both").alias("n_both"), F.size("first").alias("n_first"), F.posexplode(F.concat("both", "first", "second")).alias("at", "term")).where("term <> ''")
    in_first = F.col("at") < F.col("n_both") + F.col("n_first")
    in_second = (F.col("at") < F.col("n_both")) | ~in_first
    counts = each.groupBy(*_KEY, "term").agg(F.sum(in_first.cast("int")).alias("w1"), F.sum(in_second.cast("int")).alias("w2"))
    # a term of the same weight in both versions is drawn for once
    weights = F.when(F.col("w1") == F.col("w2"), F.array(F.struct(F.lit(0).alias("side"), F.col("w1").alias("w")))).otherwise(F.array(F.struct(F.lit(1).alias("side"), F.col("w1").alias("w")), F.struct(F.lit(2).alias("side"), F.col("w2").alias("w"))))
    terms = counts.select(*_KEY, F.xxhash64("term").alias("term"), F.inline(weights)).where("w > 0").select(*_KEY, "side", "term", F.ln("w").alias("log_w"))
    # the draws stand inside the aggregates: each becomes a small method of the generated code
    least = terms.groupBy(*_KEY, "side").agg(*[F.min(_draw(F.col("term"), F.lit(j), F.col("log_w"))).alias(f"a{j}") for j in range(samples)])
    sides = least.select(*_KEY, "side", F.array(*[f"a{j}" for j in range(samples)]).alias("a"))
    both = sides.groupBy(*_KEY).agg(*[F.max(F.when(F.col("side") == i, F.col("a"))).alias(f"s{i}") for i in range(3)])
    digits = lambda v: F.lower(F.lpad(F.hex(F.xxhash64(v).bitwiseAND(F.lit(0xFFFF))), 4, "0"))
    # an absent side counts for nothing: least() passes over nulls
    version = lambda i: F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.least(F.get(F.col("s0"), k), F.get(F.col(f"s{i}"), k)))
    pairs = both.select(*_KEY, version(1).alias("a"), version(2).alias("b"))
    spell = lambda c: F.array_join(F.transform(c, lambda v: F.when(v.isNull(), "ffff").otherwise(digits(v))), "")
    return pairs.select(*_KEY, spell("a").alias("fp"), spell("b").alias("edited_fp"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.substring(a, k * 4 + 1, F.lit(4)) == F.substring(b, k * 4 + 1, F.lit(4)))) / samples


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and how like the first is to that and to the next document's."""
    if not 1 <= samples <= 90:
        raise ValueError("1 to 90 samples: wider rows are not compiled")
    rows = keyed(docs, key, text)
    order = cut(neighbours(rows), "neighbours")
    parts = edited(rows, order)
    none = "ffff" * samples
    digests = parts.select(*_KEY, F.sha2(F.concat("keep", "other").cast("binary"), 256).alias("edited_sha256"))
    found = digests.join(fingerprint_pairs(parts, samples), _KEY, "left")
    # written before they are compared: else each of the many comparisons would spell both fingerprints anew
    fps = cut(found.select(*_KEY, "edited_sha256", F.coalesce("fp", F.lit(none)).alias("fp"), F.coalesce("edited_fp", F.lit(none)).alias("edited_fp")), "cws", "zstd")
    following = fps.select(F.col("id").alias("next_id"), F.col("th").alias("next_th"), F.col("fp").alias("next_fp"))
    near = lambda other: likeness(F.col("fp"), F.col(other), samples)
    out = order.join(fps, _KEY).join(following, ["next_id", "next_th"]).withColumns({"near_edited": near("edited_fp"), "near_next": near("next_fp")})
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return out.select(F.nullif("id", F.lit(-(1 << 63))).alias(key), "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")
