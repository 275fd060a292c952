"""Report and post of each series and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewatch.functions import money, prefix, signed
from ratewatch.operators.news import newest_first
from ratewatch.sources.sinks import MOST_CHARS

#: Marks and headings of the texts.
UP, DOWN, MONEY, GOOD, BAD = "📈", "📉", "💵", "🟢", "🔴"
TABLE_HEAD = "| Date | Forecast | 95% CI |\n|------|----------|--------|\n"
BASE, QUOTE = "USD", "COP"
TAGS = "#COP #Dólar #Colombia"


def forecast_table(ensemble: DataFrame) -> DataFrame:
    """``series_id, forecast_table``: a row for each day under a head."""
    two = lambda c: F.format_string("%.2f", F.round(c, 2))
    line = F.concat(F.lit("| "), F.date_format("ds", "yyyy-MM-dd"), F.lit(" | "), two("yhat"), F.lit(" | "), two("yhat_lower"), F.lit(" – "), two("yhat_upper"), F.lit(" |"))
    rows = ensemble.select("series_id", "step", line.alias("line")).groupBy("series_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY step)").alias("rows"))
    return rows.select("series_id", F.concat(F.lit(TABLE_HEAD), "rows").alias("forecast_table"))


def metrics_section(metrics: DataFrame) -> DataFrame:
    """``series_id, metrics_section``: a line for each model, by name."""
    two = lambda c: F.format_string("%.2f", F.round(c, 2))
    line = F.concat(F.lit("- **"), F.upper("model_name"), F.lit("**: MAE="), two("mae"), F.lit(", RMSE="), two("rmse"), F.lit(", MAPE="), two("mape"), F.lit("%"))
    rows = metrics.select("series_id", "model_name", line.alias("line"))
    return rows.groupBy("series_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY model_name)").alias("metrics_section"))


def build_reports(summary: DataFrame, narrative: DataFrame, ensemble: DataFrame, metrics: DataFrame, run_date: str, horizon: int, series: DataFrame | None = None, pairs: DataFrame | None = None, base: str = BASE, quote: str = QUOTE, tags: str = TAGS) -> DataFrame:
    """``series_id, run_date, latest_rate, rate_change_pct, narrative, report, base, quote, tags`` for each series; what is missing is zero or empty.

    ``narrative`` has one row a run date. The rates of a series are of its base in its quote: from ``pairs (series_id, base,
    quote, tags)``, one row a series, where it has them, else those given.
    """
    rates = summary.select("series_id", "latest_rate", "rate_change_pct")
    if series is not None:
        rates = series.select("series_id").distinct().join(rates, "series_id", "left")
    told = narrative.where(F.col("run_date") == run_date).agg(F.first("narrative", ignorenulls=True).alias("narrative"))  # one row
    rows = rates.join(forecast_table(ensemble), "series_id", "left").join(metrics_section(metrics), "series_id", "left").crossJoin(F.broadcast(told))
    if pairs is None:
        rows = rows.withColumns({n: F.lit(None).cast("string") for n in ("base", "quote", "tags")})
    else:
        rows = rows.join(pairs.select("series_id", "base", "quote", "tags"), "series_id", "left")
    own = [F.coalesce(name, F.lit(default)).alias(name) for name, default in (("base", base), ("quote", quote), ("tags", tags))]
    rate, change = F.coalesce("latest_rate", F.lit(0.0)), F.coalesce("rate_change_pct", F.lit(0.0))
    rows = rows.select("series_id", F.lit(run_date).alias("run_date"), rate.alias("latest_rate"), change.alias("rate_change_pct"), F.coalesce("narrative", F.lit("")).alias("narrative"), F.coalesce("forecast_table", F.lit("")).alias("table"), F.coalesce("metrics_section", F.lit("N/A")).alias("metrics"), *own)
    text = F.concat(
        F.lit("# "), "quote", F.lit("/"), "base", F.lit(" Intelligence Report — "), "run_date", F.lit("\n\n## Current Rate\n**1 "), "base", F.lit(" = "), money(F.col("latest_rate")), F.lit(" "), "quote", F.lit("** "),
        F.when(F.col("rate_change_pct") > 0, UP).otherwise(DOWN), F.lit(" ("), signed(F.col("rate_change_pct")), F.lit("% vs 30 days ago)\n\n## Market Narrative\n"), "narrative",
        F.lit(f"\n\n## {horizon}-Day Forecast\n"), "table", F.lit("\n\n## Model Performance (back-test)\n"), "metrics", F.lit("\n"),
    )
    return rows.select("series_id", "run_date", "latest_rate", "rate_change_pct", "narrative", text.alias("report"), "base", "quote", "tags")


def build_posts(reports: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """``series_id, run_date, post`` of reports, each with its own pair and tags."""
    text = F.concat("quote", F.lit("/"), "base", F.lit(" — "), "run_date", F.lit(f"\n{MONEY} 1 "), "base", F.lit(" = "), money(F.col("latest_rate"), 0), F.lit(" "), "quote", F.lit(" ("), signed(F.col("rate_change_pct"), 1), F.lit("% 30d)\n"), prefix(F.col("narrative"), 120), F.lit("...\n"), "tags")
    return reports.select("series_id", "run_date", prefix(text, most_chars).alias("post"))


def article_line(bullish: Column, severity: Column, topic: Column, title: Column) -> Column:
    mark = F.when(bullish, GOOD).otherwise(BAD)
    wide = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    return F.concat(mark, F.lit(" ["), wide(severity, 6), F.lit("] "), wide(topic, 20), F.lit(" | "), prefix(title, 70))


def article_view(analyzed: DataFrame, n: int = 10) -> DataFrame:
    """``feed_rank, entry_seq, line`` of the n newest articles."""
    line = article_line(F.col("bullish_cop"), F.col("severity"), F.col("topic"), F.col("title"))
    return analyzed.orderBy(*newest_first()).limit(n).select("feed_rank", "entry_seq", line.alias("line"))
