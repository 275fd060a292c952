"""Articles from landed feeds and API answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewatch.functions import published_at
from ratewatch.sources.markup import empty_files, read_feed_files

ARTICLE = ("url", "title", "summary", "published_at", "source", "tags", "feed_rank", "entry_seq")
_ARTICLE = "struct<title:string,description:string,url:string,publishedAt:string,source:string>"


def _text(c: Column | str) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def _articles(rows: DataFrame, run_ts: Column, feed_rank: int, when: str) -> DataFrame:
    return rows.select(
        _text("url").alias("url"),
        _text("title").alias("title"),
        _text("summary").alias("summary"),
        published_at(F.col(when), run_ts).alias("published_at"),
        "source",
        F.array().cast("array<string>").alias("tags"),
        F.lit(feed_rank).alias("feed_rank"),
        F.col("entry_seq").cast("long").alias("entry_seq"),
    )


def _errors(rows: DataFrame, message: Column) -> DataFrame:
    return rows.select(F.col("file").alias("series_id"), F.lit("news").alias("stage"), message.alias("message"))


def read_feeds(spark: SparkSession, path: str, run_ts: Column, feed_rank: int = 0) -> tuple[DataFrame, DataFrame]:
    """Articles of RSS 2.0, RSS 1.0 and Atom files, and errors. Each file gives articles or an error; one that breaks off gives both.

    The source is the feed's title, else the file's path. ``entry_seq``: place in the file.
    """
    rows = read_feed_files(spark, path)
    entries = rows.where(F.col("error").isNull()).select(F.col("link").alias("url"), "title", "summary", "when", F.coalesce("channel", "file").alias("source"), "entry_seq")
    return _articles(entries, run_ts, feed_rank, "when"), _errors(rows.where(F.col("error").isNotNull()), F.col("error")).unionByName(_errors(empty_files(spark, path), F.lit("empty file")))


def read_news_json(spark: SparkSession, path: str, run_ts: Column, feed_rank: int = 1_000, unnamed: str = "NewsAPI") -> tuple[DataFrame, DataFrame]:
    """Articles of JSON answers, and errors: of files without a readable list of articles, of empty lists, and of single articles.

    A source without a name gets ``unnamed``. Articles are read one by one, so one that can't be read costs no other.
    """
    files = spark.read.schema("articles array<string>, _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE").withColumn("file", F.col("_metadata.file_path"))
    whole = F.col("_corrupt_record").isNull() & F.col("articles").isNotNull()
    articles = files.where(whole).select("file", F.posexplode("articles").alias("entry_seq", "json")).withColumn("a", F.from_json("json", _ARTICLE))
    is_object = lambda c: F.startswith(F.ltrim(c), F.lit("{"))
    bad = ~F.coalesce(is_object(F.col("json")) & is_object(F.coalesce("a.source", F.lit("{}"))), F.lit(False))
    flat = articles.where(~bad).select(F.col("a.url").alias("url"), F.col("a.title").alias("title"), F.col("a.description").alias("summary"), F.col("a.publishedAt").alias("when"), F.coalesce(F.get_json_object("a.source", "$.name"), F.lit(unnamed)).alias("source"), "entry_seq")
    unread = _errors(empty_files(spark, path), F.lit("empty file")).unionByName(_errors(files.where(~whole), F.lit("unreadable file"))).unionByName(_errors(files.where(whole & (F.size("articles") == 0)), F.lit("no articles")))
    return _articles(flat, run_ts, feed_rank, "when"), unread.unionByName(_errors(articles.where(bad), F.concat(F.lit("unreadable article "), F.col("entry_seq").cast("string"))))
