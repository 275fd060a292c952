"""The shared test tables as rate panels and article tables, in DataFrame code and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _panel(rows: DataFrame, series: Column, when: str, value: str) -> DataFrame:
    """Daily means. Summed in cents, so that no order of addition shows."""
    day = rows.select(series.alias("series_id"), F.col(when).cast("date").alias("ds"), F.round(F.col(value) * 100).cast("long").alias("cents"))
    return day.groupBy("series_id", "ds").agg((F.sum("cents").cast("double") / (F.count("*") * 100)).alias("y"))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(table(spark, sf_dir, "events"), F.col("event_type"), "ts", "value")


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), "o_orderdate", "o_totalprice")


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _panel(rows, F.col("c_nationkey").cast("string"), "o_orderdate", "o_totalprice")


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(table(spark, sf_dir, "lineitem"), F.concat("l_returnflag", "l_linestatus"), "l_shipdate", "l_extendedprice")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first line's start as title; hours of arrival that give ties."""
    return table(spark, sf_dir, "documents").select(
        F.md5("text").alias("url"),
        F.substring(F.split("text", "\n", 2)[0], 1, 80).alias("title"),
        F.col("text").alias("summary"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 500).cast("int"))).alias("published_at"),
        "source",
        F.array().cast("array<string>").alias("tags"),
        F.substring("source", 4, 9).cast("int").alias("feed_rank"),
        F.col("doc_id").alias("entry_seq"),
    )


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the articles of one more feed."""
    return table(spark, sf_dir, "pages").select(
        "url", F.col("url").alias("title"), F.col("html").alias("summary"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("published_at"), F.lit("pages").alias("source"), F.array().cast("array<string>").alias("tags"), F.lit(1000).alias("feed_rank"), F.col("page_id").alias("entry_seq")
    )


def replies(spark: SparkSession, sf_dir: str, narrative: bool = True) -> DataFrame:
    """A model's reply for each source, made from labels: an item for each labelled document, toxic ones of high severity.

    Sources whose number leaves 4 when divided by 5 reply with something that can't be read.
    """
    from ratewatch.operators.news import number_articles

    numbered = number_articles(articles(spark, sf_dir).withColumn("batch", F.col("source")), "batch").select("batch", "feed_rank", "index", "entry_seq")
    labelled = numbered.join(table(spark, sf_dir, "labels"), F.col("entry_seq") == F.col("doc_id"), "left")
    item = F.when(F.col("doc_id").isNotNull(), F.struct("index", F.lit("macro").alias("topic"), F.when(F.col("toxic") == 1, "high").otherwise("medium").alias("severity"), (F.col("quality") == 1).alias("bullish_cop"), F.concat(F.lit("label of "), F.col("doc_id").cast("string")).alias("reasoning")))
    by_batch = labelled.groupBy("batch", "feed_rank").agg(F.to_json(F.collect_list(item)).alias("items"))
    tail = F.concat(F.lit("\n---\n  outlook of "), "batch", F.lit(" \n")) if narrative else F.lit("")
    return by_batch.select("batch", F.when(F.col("feed_rank") % 5 == 4, F.lit("not valid json at all {{{")).otherwise(F.concat("items", tail)).alias("raw"))


def _panel_sql(source: str, series: str, when: str, value: str) -> str:
    return f"SELECT {series} AS series_id, CAST({when} AS DATE) AS ds, CAST(SUM(CAST(ROUND({value} * 100) AS BIGINT)) AS DOUBLE) / (COUNT(*) * 100) AS y FROM {source} GROUP BY 1, 2"


SQL = {
    "events_panel": _panel_sql("events", "event_type", "ts", "value"),
    "orders_panel": _panel_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice"),
    "nation_panel": _panel_sql("orders JOIN customer ON o_custkey = c_custkey", "CAST(c_nationkey AS VARCHAR)", "o_orderdate", "o_totalprice"),
    "lineitem_panel": _panel_sql("lineitem", "l_returnflag || l_linestatus", "l_shipdate", "l_extendedprice"),
    "articles": "SELECT md5(text) AS url, substring(split_part(text, chr(10), 1), 1, 80) AS title, text AS summary, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 500 AS BIGINT)) AS published_at, source, CAST(substring(source, 4) AS INTEGER) AS feed_rank, doc_id AS entry_seq FROM documents",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, feed_rank, entry_seq) - 1 AS index FROM articles",
}


def with_tables(sql: str, *names: str, more: str = "") -> str:
    """The statement after the definitions of these tables, and of ``more``, which may be recursive."""
    defined = [f"{n} AS ({SQL[n]})" for n in names] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if more else ''}{', '.join(defined)} {sql}"
