"""Article tables: union, first-wins dedup, newest first, digests for a model, and its replies.

``feed_rank`` and ``entry_seq`` are the order in which articles came in; they settle every tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ratewatch.functions import any_keyword, is_true, prefix, split_once, tidy

#: Words that make an article important when no model says so.
KEYWORDS = ["petróleo", "oil", "banrep", "tasas", "interés", "inflación", "dólar"]
#: Texts and labels of the defaults.
FALLBACK_REASON = "fallback: keyword heuristic"
NO_NEWS, NO_ANALYSIS = "No news available.", "News analysis unavailable."
TOPIC, SEVERITY, IMPORTANT = "other", "low", "high"
MOST_ARTICLES, DIGEST_ARTICLES = 50, 20
_ITEM = "array<struct<index:int,topic:string,severity:string,bullish_cop:boolean,reasoning:string>>"
_ARRIVAL = ("feed_rank", "entry_seq")


def newest_first() -> list[Column]:
    """Ties in the order of arrival."""
    return [F.desc("published_at"), *map(F.col, _ARRIVAL)]


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All articles, copies included."""
    return reduce(lambda a, b: a.unionByName(b), feeds)


def dedup_by_url(articles: DataFrame) -> DataFrame:
    """The first article to come in of each url, to the letter; those without one count as one.

    An aggregate with partial results in each task, so a url that is everywhere (or empty) is no hot spot.
    """
    first = articles.groupBy("url").agg(F.min_by(F.struct(*articles.columns), F.struct(*_ARRIVAL)).alias("a"))
    return first.select("a.*")


def latest_articles(articles: DataFrame, n: int = MOST_ARTICLES, by: str | None = None) -> DataFrame:
    """The newest n articles, or n of each value of ``by``; ties in the order of arrival."""
    if by is None:
        return articles.orderBy(*newest_first()).limit(n)
    return articles.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*newest_first()))).where(F.col("rank") <= n)


def classify_keywords(articles: DataFrame, keywords: list[str] = KEYWORDS) -> DataFrame:
    """Labels without a model: important if title or summary have a keyword."""
    hit = any_keyword(F.concat_ws(" ", "title", "summary"), keywords)
    return articles.withColumns({"topic": F.lit(TOPIC), "severity": F.when(hit, IMPORTANT).otherwise(SEVERITY), "bullish_cop": F.lit(False), "reasoning": F.lit(FALLBACK_REASON)})


def number_articles(articles: DataFrame, batch: str, index_base: int = 0, most: int | None = None) -> DataFrame:
    """Articles with their ``index`` in their batch, newest first."""
    numbered = articles.withColumn("index", F.row_number().over(W.partitionBy(batch).orderBy(*newest_first())))
    if most is not None:  # on the bare row number, so that each task hands on no more than so many of a batch
        numbered = numbered.where(F.col("index") <= most)
    return numbered.withColumn("index", F.col("index") - 1 + index_base)


def build_digest(articles: DataFrame, batch: str, style: str = "classifier", most: int | None = None, summary_chars: int | None = None, index_base: int | None = None) -> DataFrame:
    """``batch, digest``: one line an article. Styles: ``classifier`` (from 0, 300 characters) and ``narrative`` (from 1, 200, 20 articles)."""
    classifier = style == "classifier"
    if not classifier and style != "narrative":
        raise ValueError(f"no style {style}")
    most = most if classifier or most else DIGEST_ARTICLES
    base = index_base if index_base is not None else 0 if classifier else 1
    summary = prefix(F.col("summary"), summary_chars or (300 if classifier else 200))
    told = F.concat(F.lit("] title='"), "title", F.lit("' summary='"), summary, F.lit("'")) if classifier else F.concat(F.lit("] "), "title", F.lit(" — "), summary)
    short = articles.select(F.col(batch).alias("batch"), "published_at", *_ARRIVAL, told.alias("told"))  # whole summaries stay where they are
    numbered = number_articles(short, "batch", base, most).select("batch", "index", F.concat(F.lit("["), F.col("index").cast("string"), "told").alias("line"))
    return numbered.groupBy("batch").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY index)").alias("digest"))


def call_model(digests: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """``batch, raw``: what ``fn`` replies to each digest; null where it fails, which leaves other batches alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            replies = []
            for digest in part["digest"]:
                try:
                    replies.append(fn([digest])[0])
                except Exception:  # noqa: BLE001  whatever a caller's function raises is a failed batch
                    replies.append(None)
            yield pd.DataFrame({"batch": part["batch"], "raw": pd.Series(replies, dtype=object)})

    return digests.select("batch", "digest").mapInPandas(run, "batch string, raw string")


def _array(text: Column) -> Column:
    """The items of a JSON array; null if it isn't one from its first character to its last."""
    whole = tidy(text)
    return F.when(F.startswith(whole, F.lit("[")) & F.endswith(whole, F.lit("]")), F.from_json(whole, _ITEM))


def parse_reply(replies: DataFrame) -> DataFrame:
    """``batch, items, narrative`` of replies with an array, a line of three dashes and a text."""
    before, after = split_once(F.col("raw"))
    items = _array(before)
    return replies.select("batch", items.alias("items"), F.when(items.isNotNull(), after).otherwise(F.lit(NO_ANALYSIS)).alias("narrative"))


def reply_items(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``batch, index, item`` of replies that are one array, the last item of an index; and the batches that failed."""
    parsed = replies.select("batch", _array(F.col("raw")).alias("items"))
    each = parsed.select("batch", F.posexplode("items").alias("at", "item")).where(F.col("item.index").isNotNull())
    return each.groupBy("batch", F.col("item.index").alias("index")).agg(F.max_by("item", "at").alias("item")), parsed.where(F.col("items").isNull()).select("batch").distinct()


def attach_labels(numbered: DataFrame, items: DataFrame, batch: str = "batch") -> DataFrame:
    """Every article once, with its item's labels or the defaults. Items of no article are left out."""
    joined = numbered.join(items.withColumnRenamed("batch", batch), [batch, "index"], "left")
    item = lambda name, default: F.coalesce(F.col(f"item.{name}"), F.lit(default))
    return joined.withColumns({"topic": item("topic", TOPIC), "severity": item("severity", SEVERITY), "bullish_cop": is_true(F.col("item.bullish_cop")), "reasoning": item("reasoning", "")}).drop("item")


def classify(articles: DataFrame, replies: DataFrame, batch: str = "batch", keywords: list[str] = KEYWORDS, index_base: int = 0) -> DataFrame:
    """Labels from the replies; a batch whose reply can't be read, or has none, gets those of keywords."""
    numbered = number_articles(articles, batch, index_base)
    items, failed = reply_items(replies)
    answered = replies.select("batch").distinct().join(failed, "batch", "left_anti").withColumnRenamed("batch", batch)
    labelled = attach_labels(numbered.join(answered, batch, "left_semi"), items, batch)
    return labelled.unionByName(classify_keywords(numbered.join(answered, batch, "left_anti"), keywords))


def narrative_or_default(runs: DataFrame, narratives: DataFrame, key: str = "run_date") -> DataFrame:
    """Every run with its narrative, or the text that says there was no news."""
    return runs.join(narratives.select(key, "narrative"), key, "left").withColumn("narrative", F.coalesce("narrative", F.lit(NO_NEWS)))


def fold_narratives(narratives: DataFrame, run_date: str) -> DataFrame:
    """``run_date, narrative``: one row with the narratives of all batches, a line each, in their order; failed ones only if there is no other.

    Batches are few: each has one short text here, however many articles it has.
    """
    told = F.col("narrative") != NO_ANALYSIS
    lines = F.expr("listagg(narrative, '\n') WITHIN GROUP (ORDER BY batch)")
    folded = narratives.where(told).agg(lines.alias("told")).crossJoin(narratives.agg(F.max("narrative").alias("any")))  # one row each
    return folded.select(F.lit(run_date).alias("run_date"), F.coalesce("told", "any").alias("narrative")).where(F.col("narrative").isNotNull())
