"""Toxicity scores: gradient-boosted trees over a few dense features, calibrated by isotonic regression.

Features of a whole text: how dense words of two lexicons are (a fixed one, and one learned from labels), how near the
next second-person word is to such a word, shares of capitals and punctuation, how often words hide letters behind
digits or signs, and length. The learned lexicon has words, and heads of 4 to 8 letters that longer words begin with, for
languages that build their insults. The trees and the calibration are Spark ML models.

Labels are learned from a hash sample of about ``most_labels`` rows that are not held out, cut in three by another hash:
the lexicon comes from the first part, the trees from the second, the calibration from the third. The learned lexicon has
at most ``MOST_WORDS`` words and heads, those of most toxic texts: a size of the model, as the depth of its trees is. All texts are
scored.

Defined results: a null text counts as empty and is scored like an empty text; repeated rows are scored alike; labels
that are null or have no document are not learned from, and rows with equal doc_ids each count; without labels of both
kinds every score is the share of toxic labels (0 if there are none); an empty table gives an empty table.
Texts of any length are scored whole; a score of exactly 0.5 is toxic; ``keep_clean`` keeps further columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewatch.llm.common import cut, plain_names, text_slices

#: Labelled rows that the models are fit on, about.
MOST_LABELS = 24_000
#: Words and heads of the learned lexicon, at most.
MOST_WORDS = 300
#: Common insults.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool fools loser losers trash garbage scum pathetic worthless disgusting clown jerk creep freak vermin liar ugly hate "
    "idiota idiotas estúpido estúpida imbécil basura asqueroso inútil payaso idiote idiotes imbécile stupide ordure débile crétin dumm dummkopf trottel abschaum widerlich wertlos depp".split()
)
#: Words that address somebody, in four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur tu tus te ti usted ustedes vosotros toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer".split())
#: Signs that stand for letters.
SIGNS = str.maketrans("013457@$!|", "oieastasil")
FEATURES = ("fixed_density", "learned_density", "fixed_hits", "learned_hits", "near_you", "you_density", "capitals", "exclaims", "punctuation", "hidden", "hidden_insults", "log_words")

#: Letters of the heads that the learned lexicon may have.
HEADS = range(4, 9)

_words = re.compile(r"[^\W\d_]+").findall
_hidden = re.compile(r"(?<!\w)[^\W\d_]+(?:[0-9@$!|*]+[^\W\d_]+)+").findall
_signs = re.compile(r"[0-9@$!|*]").search
_CAPITALS, _PUNCTUATION = bytes(range(65, 91)), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def heads(word: str) -> list[str]:
    """The heads of a word that has more letters than they; a plus sign tells them from words."""
    return [word[:n] + "+" for n in HEADS if n < len(word)]


class Kinds(dict):
    """What each word is: 1 if it is in the fixed lexicon, 2 if in the learned one, 3 if in both. Bounded."""

    def __init__(self, learned: frozenset[str]):
        self.learned, self.by_head = learned, any(w.endswith("+") for w in learned)

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        known = word in self.learned or self.by_head and not self.learned.isdisjoint(heads(word))
        self[word] = kind = (word in INSULTS) + 2 * known
        return kind


def features(text: str, kinds: Kinds) -> list[float]:
    raw = text.encode("utf-8", "replace")
    lower = text.lower()
    words = _words(lower)
    n, size = max(1, len(words)), max(1, len(raw))
    found = np.fromiter(map(kinds.__getitem__, words), np.uint8, len(words))
    fixed, more, hits = np.flatnonzero(found & 1), np.flatnonzero(found & 2), np.flatnonzero(found)
    second = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
    near = 0.0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(second[np.maximum(at - 1, 0)] - hits))
        near = float((1.0 / (1.0 + gap)).max())
    hidden = _hidden(lower) if _signs(lower) else []
    plain = [h.translate(SIGNS).replace("*", "") for h in hidden]
    return [
        len(fixed) / n,
        len(more) / n,
        float(len(fixed)),
        float(len(more)),
        near,
        len(second) / n,
        (size - len(raw.translate(None, _CAPITALS))) / size,
        raw.count(b"!") / size,
        (size - len(raw.translate(None, _PUNCTUATION))) / size,
        len(hidden) / n,
        float(sum(kinds[p] > 0 for p in plain)),
        float(np.log1p(len(words))),
    ]


def featurize(rows: DataFrame, learned: frozenset[str], keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``x``, an array of the features."""
    shipped = rows.sparkSession.sparkContext.broadcast(learned)  # at most a few hundred words
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        kinds = Kinds(shipped.value)
        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                x = pa.array([features(t, kinds) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), x], [*keep, "x"])

    return rows.select(*keep, rows[text].alias("__text")).mapInArrow(run, f"{fields}, x array<double>")


def learn_lexicon(labelled: DataFrame, least_docs: int = 5, least_share: float = 0.005, least_precision: float = 0.9, most_words: int = MOST_WORDS) -> frozenset[str]:
    """Words and heads that stand mostly in toxic texts, by the number of texts that have them (``text, toxic``)."""

    def run(batches):
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set(_words((text or "").lower()))
                found = list(words.union(*map(heads, words)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int64())], ["word", "toxic"])

    each = labelled.dropDuplicates(["text"]).select("text", F.col("toxic").cast("long").alias("toxic"))
    toxic_docs = each.agg(F.sum("toxic")).first()[0] or 0
    counts = each.mapInArrow(run, "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    best = counts.where((F.col("bad") >= max(least_docs, least_share * toxic_docs)) & ((F.col("bad") + 0.5) / (F.col("n") + 1) >= least_precision)).orderBy(F.desc("bad"), "word").limit(most_words)
    return frozenset(r.word for r in best.collect())


@dataclass
class Model:
    lexicon: frozenset[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of the labels that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic"))
    n = known.count()
    parts = 1_000_000
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(parts)) < int(parts * min(1.0, most_labels / max(n, 1))))
    if chosen.count() <= 2 * most_labels:
        chosen = F.broadcast(chosen)
    rows = cut(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "key"), F.lit(3)).cast("int")), "toxicity-sample")
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    lexicon = learn_lexicon(rows.where("fold = 0"))
    seen = cut(featurize(rows.where("fold > 0"), lexicon, ["toxic", "fold"]).select("toxic", "fold", array_to_vector("x").alias("features")).coalesce(4), "toxicity-features")
    both = {(r.fold, r.toxic) for r in seen.select("fold", "toxic").distinct().collect()}
    if not {(1, 0), (1, 1)} <= both:
        return Model(lexicon, None, None, float(share))
    trees = GBTClassifier(labelCol="toxic", maxDepth=3, maxIter=16, maxBins=32, stepSize=0.3, minInstancesPerNode=5, seed=7, cacheNodeIds=False).fit(seen.where("fold = 1"))
    judged = trees.transform(seen.where("fold = 2")).select(F.col("toxic").cast("double").alias("label"), vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw").fit(judged) if {(2, 0), (2, 1)} <= both else None
    return Model(lexicon, trees, calibration, float(share))


def _judged(rows: DataFrame, model: Model, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` (named by ``plain_names``, so that none clashes with the models' columns) and ``judged``."""
    found = featurize(rows, model.lexicon, keep, text)
    if model.trees is None:
        return found.select(*keep, F.lit(model.share).alias("judged"))
    found = model.trees.transform(found.withColumn("features", array_to_vector("x"))).select(*keep, vector_to_array("probability")[1].alias("raw"))
    if model.calibration is not None:
        model.calibration.setPredictionCol("step")
        # the raw score settles ties of the steps, by a hair
        found = model.calibration.transform(found).withColumn("raw", F.col("step") * 0.999 + F.col("raw") * 0.001)
    return found.select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "raw")).alias("judged"))


def keep_clean(docs: DataFrame, model: Model, below: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below ``below``."""
    plain, names = plain_names(docs)
    return _judged(plain, model, plain.columns, names[text]).where(F.col("judged") < below).select(*plain.columns).toDF(*docs.columns)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of each row; the text goes no further than the features."""
    rows = docs.select(docs[key].alias("c0"), docs[text].alias("c1"))
    return _judged(rows, model, ["c0"], "c1").toDF(key, "score")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
