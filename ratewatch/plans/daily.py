"""The daily run: rates and news on separate branches, joined in one report and one post for each series."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ratewatch.operators import forecast as fc
from ratewatch.operators import news, panel, report
from ratewatch.plans.steps import written
from ratewatch.sources import ledger
from ratewatch.sources.news import read_feeds, read_news_json
from ratewatch.sources.rates import read_rates_html, read_rates_json, read_rates_table, with_fallback
from ratewatch.sources.sinks import post_outbox


@dataclass
class Daily:
    summary: DataFrame
    forecasts: DataFrame
    ensemble: DataFrame
    metrics: DataFrame
    analyzed: DataFrame
    reports: DataFrame
    outbox: DataFrame
    errors: DataFrame
    kept: list[DataFrame]

    def close(self) -> None:
        """Free what was kept between the steps."""
        for df in self.kept:
            df.unpersist()


def run_daily(fx: DataFrame, articles: DataFrame, run_date: date, horizon: int = 7, models: Mapping[str, fc.Model] | None = None, model_reply: Callable[[list[str]], list[str]] | None = None, most_articles: int = news.MOST_ARTICLES, lookback_days: int = panel.LOOKBACK_DAYS, publish: bool = False, source_errors: DataFrame | None = None, series: DataFrame | None = None, pairs: DataFrame | None = None, model_name: str = "model", replies_path: str | None = None, posts_path: str | None = None) -> Daily:
    """All tables of one run.

    The rates within the look-back are dealt out by series once; summary, models and back-test use that. Without
    ``model_reply`` (texts in, texts out) articles are labelled by keywords. One branch's failures leave the other alone.
    Replies are written before they are used, so no digest is sent twice. Errors of the readers come in as
    ``source_errors (series_id, stage, message)``; a failed reply is an error of the stage ``news``.

    ``series`` (``series_id``; else found once in ``fx``) get a report each, ``pairs (series_id, base, quote, tags)`` say what their rates are. With
    ``replies_path`` digests that this model has answered before aren't sent again; with ``posts_path`` a post is handed out once,
    and ``outbox`` has those that are out now.
    """
    if lookback_days < 30:
        raise ValueError("look back 30 days or more")
    if not 1 <= most_articles <= 200:
        raise ValueError("1 to 200 articles")
    models = models or {"trend": fc.trend_model(), "arima": fc.arima_model()}
    spark, day = fx.sparkSession, run_date.isoformat()
    recent = panel.lookback(fx, run_date, lookback_days).repartition("series_id").persist(StorageLevel.MEMORY_AND_DISK)
    summary = panel.fx_summary(recent)
    if series is None:
        series = fx.select("series_id").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    kept = [recent, series]
    forecasts, failed = fc.forecast_all(recent, models, horizon, series=series, kept=kept)
    ensemble, uneven = fc.ensemble(forecasts)
    metrics, _ = fc.backtest(recent, models, horizon, kept=kept)

    latest = news.latest_articles(news.dedup_by_url(articles), most_articles).withColumn("batch", F.lit(day))
    if model_reply is None:
        analyzed = news.classify_keywords(news.number_articles(latest, "batch"))
        told = latest.select("batch").distinct().select(F.col("batch").alias("run_date"), F.lit(news.NO_ANALYSIS).alias("narrative"))
    else:
        digests = news.build_digest(latest, "batch", "narrative", index_base=0)
        replies = written(news.call_model(digests, model_reply), "replies") if replies_path is None else ledger.ask(digests, model_name, model_reply, replies_path)
        told = news.parse_reply(replies).select(F.col("batch").alias("run_date"), "narrative")
        arrays = replies.select("batch", F.split("raw", "---", 2)[0].alias("raw"))
        analyzed = news.classify(latest, arrays)
    narrative = news.narrative_or_default(spark.createDataFrame([(day,)], "run_date string"), told)
    reports = report.build_reports(summary, narrative, ensemble, metrics, day, horizon, series=series, pairs=pairs)
    posts = report.build_posts(reports)
    outbox, too_long = post_outbox(posts, publish)
    if posts_path is not None:
        outbox = ledger.hand_out(posts, posts_path, publish).where(F.col("run_date") == day)
    errors = panel.summary_errors(summary).unionByName(failed).unionByName(uneven).unionByName(panel.grid_errors(recent)).unionByName(too_long)
    if model_reply is not None:
        errors = errors.unionByName(replies.where(F.col("raw").isNull()).select(F.col("batch").alias("series_id"), F.lit("news").alias("stage"), F.lit("the model gave no reply").alias("message")))
    if source_errors is not None:
        errors = errors.unionByName(source_errors)
    return Daily(summary, forecasts, ensemble, metrics, analyzed, reports, outbox, errors, kept)


def run_landed(spark: SparkSession, rates: str, run_date: date, feeds: Sequence[str] = (), answers: Sequence[str] = (), spare: DataFrame | None = None, tables: Mapping[str, str] | None = None, pages: Mapping[str, str] | None = None, **options) -> Daily:
    """``run_daily`` from landed files: rates as JSON, RSS or Atom ``feeds`` and JSON ``answers``, in this order of arrival.

    A series without readable rates comes as a whole from the first of these that has it: ``spare (series_id, ds, y)``, day-first text
    ``tables`` and HTML ``pages`` (each a path by series). What can't be read is an error row.
    """
    fx, errors = read_rates_json(spark, rates)
    others = [spare] if spare is not None else []
    others += [read_rates_table(spark, path, series_id) for series_id, path in (tables or {}).items()]
    for series_id, path in (pages or {}).items():
        rows, unread = read_rates_html(spark, path, series_id)
        others.append(rows)
        errors = errors.unionByName(unread)
    for other in others:
        fx = with_fallback(fx, other)
    run_ts = F.lit(run_date.isoformat()).cast("timestamp")
    read = [read(spark, path, run_ts, rank) for rank, (read, path) in enumerate([*((read_feeds, p) for p in feeds), *((read_news_json, p) for p in answers)])]
    if read:
        articles = news.union_feeds(*(rows for rows, _ in read))
    else:
        articles = spark.createDataFrame([], "url string, title string, summary string, published_at timestamp, source string, tags array<string>, feed_rank int, entry_seq long")
    for _, unread in read:
        errors = errors.unionByName(unread)
    return run_daily(fx, articles, run_date, source_errors=errors, **options)
