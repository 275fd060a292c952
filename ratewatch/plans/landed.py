"""Queries of the readers, the writer and the parsers: payloads, tables, feeds and answers that Spark makes from the shared tables.

Where a reader takes files, they are written to the shared folder first. Some values are made unreadable on purpose.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewatch import functions as fn
from ratewatch.operators import panel
from ratewatch.plans import tables as t
from ratewatch.plans.registry import query
from ratewatch.plans.steps import shared_folder
from ratewatch.sources import rates
from ratewatch.sources.news import read_feeds, read_news_json
from ratewatch.sources.sinks import write_reports

#: Articles in a feed or an answer.
MOST = 100
#: The run's time, and as seconds since 1970.
RUN, RUN_S = "2024-06-01 12:00:00+00:00", 1717243200


def path_of(spark, label: str) -> str:
    """A new folder's path among the shared ones."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _landed(df: DataFrame, label: str, by: str | None = None) -> str:
    """The path of a new text folder, with a file for each value of ``by``."""
    path = path_of(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).text(path)
    return path


# -- rates


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def _two(cents: Column) -> Column:
    return F.lpad((cents % 100).cast("string"), 2, "0")


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_NUMBER = f"CAST({_CENTS} // 100 || '.' || lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0') AS DOUBLE)"


def _payloads(spark, sf_dir) -> DataFrame:
    """A payload for each customer's orders: the dearest one of a day; some have an error, a note, or are cut off."""
    orders = t.table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.max(_cents("o_totalprice")).alias("cents"))
    close = F.concat((F.col("cents") / 100).cast("long").cast("string"), F.lit("."), _two(F.col("cents")))
    days = F.map_from_entries(F.collect_list(F.struct(F.date_format("day", "yyyy-MM-dd"), F.create_map(F.lit("1. open"), F.lit("0"), F.lit(rates.CLOSE), close))))
    key = F.col("o_custkey")
    named = F.when(key % 11 == 3, F.lit("bad call")).when(key % 11 == 4, F.lit("")), F.when(key % 11 == 4, F.lit("too many calls"))
    json = F.to_json(F.struct(days.alias(rates.SERIES), named[0].alias("Error Message"), named[1].alias("Note")))
    payloads = orders.groupBy("o_custkey").agg(json.alias("value"))
    return payloads.select(key.cast("string").alias("series_id"), F.when(key % 11 == 5, F.lit("{cut off")).otherwise(F.col("value")).alias("value"))


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS ds, max({_NUMBER}) AS y FROM orders WHERE o_custkey % 11 NOT IN (3, 4, 5) GROUP BY 1, 2")
def rates_payloads(spark, sf_dir):
    return rates.rates_of(rates.split_payload_errors(rates.parse_payloads(_payloads(spark, sf_dir)))[0])


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS series_id, 'rates' AS stage, CASE o_custkey % 11 WHEN 3 THEN 'bad call' WHEN 4 THEN 'too many calls' ELSE 'unreadable payload' END AS message FROM orders WHERE o_custkey % 11 IN (3, 4, 5)")
def rates_payload_errors(spark, sf_dir):
    return rates.split_payload_errors(rates.parse_payloads(_payloads(spark, sf_dir)))[1]


@query(f"SELECT 'orders' AS series_id, CAST(o_orderdate AS DATE) AS ds, {_NUMBER} AS y FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0")
def rates_table(spark, sf_dir):
    """Orders as a landed table of day-first dates and numbers with a decimal comma, some of them unreadable."""
    key, cents = F.col("o_orderkey"), _cents("o_totalprice")
    day = F.when(key % 7 == 0, F.lit("31/02/x")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    number = F.when(key % 5 == 0, F.lit("n/a")).otherwise(F.concat((cents / 100).cast("long").cast("string"), F.lit(","), _two(cents)))
    lines = t.table(spark, sf_dir, "orders").select(F.concat_ws(";", day, number).alias("value"))
    return rates.read_rates_table(spark, _landed(lines, "table"), "orders", header=False)


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 5 <> 0 THEN {_NUMBER} END AS number, {_NUMBER} AS grouped,
CAST(NULL AS DOUBLE) AS ungrouped, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS instant, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS found, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'none' END AS found_or FROM orders"""
)
def scalar_values(spark, sf_dir):
    """Dates, numbers, instants and map values of orders, from their texts."""
    key, cents = F.col("o_orderkey"), _cents("o_totalprice")
    day = F.when(key % 7 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    whole = (cents / 100).cast("long")
    number = F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(whole.cast("string"), F.lit(","), _two(cents)))
    grouped = F.concat((whole / 1000).cast("long").cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(","), _two(cents))
    iso = F.when(key % 3 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    named = F.create_map(F.when(key % 2 == 0, F.lit("a")).otherwise(F.lit("b")), F.col("o_orderpriority"))
    return t.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        fn.day_first_date(day).alias("day"),
        fn.decimal_number(number).alias("number"),
        fn.decimal_number(grouped, thousands=".").alias("grouped"),
        fn.decimal_number(grouped).alias("ungrouped"),
        F.unix_seconds(fn.iso_instant(iso)).alias("instant"),
        fn.map_value(named, "a").alias("found"),
        fn.map_value(named, "a", "none").alias("found_or"),
    )


# -- news

_DOC = f"(SELECT *, doc_id // {MOST} AS block FROM documents)"
_HOURS = "CAST(epoch(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 500 AS BIGINT))) AS BIGINT)"
_ARTICLE_SQL = f"""SELECT md5(text) AS url, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'doc ' || doc_id END AS title, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang || ' text' END AS summary, {{when}} AS published, {{source}} AS source,
{{rank}} AS feed_rank, row_number() OVER (PARTITION BY {{feed}} ORDER BY doc_id) - 1 AS entry_seq FROM {_DOC} WHERE block % 7 <> 3"""


def _documents(spark, sf_dir) -> DataFrame:
    hour = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 500).cast("int"))
    return t.table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        F.floor(F.col("doc_id") / MOST).alias("block"),
        hour.alias("hour"),
        F.md5("text").alias("url"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("title"),
        F.when(F.col("doc_id") % 11 != 0, F.concat("lang", F.lit(" text"))).alias("summary"),
    )


def _told(articles: DataFrame) -> DataFrame:
    return articles.select("url", "title", "summary", F.unix_seconds("published_at").alias("published"), "source", "feed_rank", "entry_seq")


@query(_ARTICLE_SQL.format(when=f"CASE WHEN doc_id % 13 = 0 THEN {RUN_S} WHEN doc_id % 3 = 1 THEN {_HOURS} + 18000 ELSE {_HOURS} END", source="'feed ' || block", rank=3, feed="block"))
def news_rss(spark, sf_dir):
    """Documents as RSS and Atom files, a hundred in each; some files can't be read, and items lack parts or dates."""
    return _told(read_feeds(spark, _feeds(spark, sf_dir), F.lit(RUN).cast("timestamp"), feed_rank=3)[0])


def _feeds(spark, sf_dir, some_empty: bool = False) -> str:
    """The path of feeds: every third is Atom, some break at their first entry, and some may be empty."""
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")), F.lit(""))
    atom = F.col("block") % 3 == 1
    docs = _documents(spark, sf_dir)
    west = F.col("doc_id") % 3 == 1
    when = F.when(F.col("doc_id") % 13 == 0, F.lit("soon")).otherwise(F.concat(F.date_format("hour", "EEE, dd MMM yyyy HH:mm:ss"), F.when(west, F.lit(" -0500")).otherwise(F.lit(" GMT"))))
    iso = F.when(F.col("doc_id") % 13 == 0, F.lit("soon")).otherwise(F.concat(F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss"), F.when(west, F.lit("-05:00")).otherwise(F.lit("Z"))))
    item = F.concat(F.lit("<item>"), tag("title", F.col("title")), tag("link", F.col("url")), tag("description", F.col("summary")), tag("pubDate", when), F.lit("</item>"))
    entry = F.concat(F.lit("<entry>"), tag("title", F.col("title")), F.lit("<link rel='self' href='x'/><link href='"), F.col("url"), F.lit("'/>"), tag("summary", F.col("summary")), tag("updated", iso), F.lit("</entry>"))
    items = docs.groupBy("block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.when(atom, entry).otherwise(item).alias("item")))), lambda x: x["item"]), "").alias("items"))
    broken = F.when(F.col("block") % 7 == 3, F.regexp_replace("items", "</(item|entry)>", "</itm>")).otherwise(F.col("items"))
    if some_empty:
        broken = F.when(F.col("block") % 5 == 1, F.lit("")).otherwise(broken)
    title = F.concat(F.lit("<title>feed "), F.col("block").cast("string"), F.lit("</title>"))
    rss, feed = F.concat(F.lit("<rss><channel>"), title, broken, F.lit("</channel></rss>")), F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>"), title, broken, F.lit("</feed>"))
    return _landed(items.select("block", F.when(atom, feed).otherwise(rss).alias("value")), "feeds", "block")


@query(f"SELECT DISTINCT CAST(block AS VARCHAR) AS block, 'news' AS stage, CASE WHEN block % 5 = 1 THEN 'no entries' ELSE 'broken after 0 entries' END AS message FROM {_DOC} WHERE block % 7 = 3 OR block % 5 = 1")
def news_feed_errors(spark, sf_dir):
    """Files that are empty or break off are errors, each with its name."""
    errors = read_feeds(spark, _feeds(spark, sf_dir, some_empty=True), F.lit(RUN).cast("timestamp"))[1]
    return errors.select(F.regexp_extract("series_id", r"block=(\d+)", 1).alias("block"), "stage", F.split("message", ":")[0].alias("message"))


def _answers(spark, sf_dir, half: bool = False) -> str:
    """The path of JSON answers, a hundred documents in each; some can't be read, and in some articles the source may be no object."""
    when = F.when(F.col("doc_id") % 13 != 0, F.concat(F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("publishedAt")
    source = F.struct(F.when(F.col("doc_id") % 17 != 0, F.col("source")).alias("name")).alias("source")
    article = F.to_json(F.struct("doc_id", F.col("title"), F.col("summary").alias("description"), "url", when, source))
    if half:
        article = F.when(F.col("doc_id") % 29 == 5, F.regexp_replace(article, r'"source":\{[^}]*\}', '"source":"one"')).otherwise(article)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", article.alias("json")))), lambda x: x["json"]), ",")
    answers = _documents(spark, sf_dir).groupBy("block").agg(F.concat(F.lit('{"articles":['), listed, F.lit("]}")).alias("json"))
    return _landed(answers.select("block", F.when(F.col("block") % 7 == 3, F.lit("{cut off")).otherwise(F.col("json")).alias("value")), "answers", "block")


@query(_ARTICLE_SQL.format(when=f"CASE WHEN doc_id % 13 = 0 THEN {RUN_S} ELSE {_HOURS} END", source="CASE WHEN doc_id % 17 = 0 THEN 'NewsAPI' ELSE source END", rank=4, feed="block"))
def news_answers(spark, sf_dir):
    return _told(read_news_json(spark, _answers(spark, sf_dir), F.lit(RUN).cast("timestamp"), feed_rank=4)[0])


@query(f"SELECT DISTINCT CAST(block AS VARCHAR) AS block, 'news' AS stage, 'unreadable file' AS message FROM {_DOC} WHERE block % 7 = 3")
def news_answer_errors(spark, sf_dir):
    errors = read_news_json(spark, _answers(spark, sf_dir), F.lit(RUN).cast("timestamp"))[1]
    return errors.select(F.regexp_extract("series_id", r"block=(\d+)", 1).alias("block"), "stage", "message")


@query(
    f"""WITH placed AS (SELECT block, doc_id % 29 = 5 AS bad, row_number() OVER (PARTITION BY block ORDER BY doc_id) - 1 AS place FROM {_DOC})
SELECT 'articles' AS message, NULL AS block, count(*) AS n FROM placed WHERE block % 7 <> 3 AND NOT bad UNION ALL
SELECT DISTINCT 'unreadable file', CAST(block AS VARCHAR), 1 FROM placed WHERE block % 7 = 3 UNION ALL
SELECT 'unreadable article ' || place, CAST(block AS VARCHAR), 1 FROM placed WHERE block % 7 <> 3 AND bad"""
)
def news_half_answers(spark, sf_dir):
    """Articles of all files, and each error: an article that can't be read costs no other one."""
    articles, errors = read_news_json(spark, _answers(spark, sf_dir, half=True), F.lit(RUN).cast("timestamp"))
    failed = errors.groupBy("message", F.regexp_extract("series_id", r"block=(\d+)", 1).alias("block")).agg(F.count("*").alias("n"))
    return articles.agg(F.lit("articles").alias("message"), F.lit(None).cast("string").alias("block"), F.count("*").alias("n")).unionByName(failed)


# -- reports

_DAYS = "2001-08-01", "2001-08-02"


@query(t.with_tables(f"SELECT series_id, n + again AS n, run_date FROM (SELECT series_id, count(*) AS n FROM orders_panel GROUP BY 1) CROSS JOIN (VALUES ('{_DAYS[0]}', 0), ('{_DAYS[1]}', 1)) v(run_date, again)", "orders_panel"))
def report_store(spark, sf_dir):
    """Two run dates are written, and the later one again: it is replaced, the other one stays."""
    counts = panel.ingest_counts(t.orders_panel(spark, sf_dir)).select("series_id", "n")
    path = path_of(spark, "reports")
    write_reports(counts.withColumn("run_date", F.explode(F.array(*map(F.lit, _DAYS)))), path)
    write_reports(counts.select("series_id", (F.col("n") + 1).alias("n"), F.lit(_DAYS[1]).alias("run_date")), path)
    return spark.read.schema("series_id string, n long, run_date string").parquet(path)
