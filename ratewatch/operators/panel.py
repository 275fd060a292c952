"""Rate panels ``(series_id, ds, y)``: windows, grids, splits and summaries.

All work on a series happens within its own partition key; order is by date, and rows count, not days, where it says so.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ratewatch.functions import percent_change

LOOKBACK_DAYS = 365


def _series():
    return W.partitionBy("series_id")


def _weekday(ds: Column) -> Column:
    return F.weekday(ds) < 5


def ordered(series: str = "series_id"):
    """The order that positional operators rely on: by date within a series."""
    return W.partitionBy(series).orderBy("ds")


def lookback(fx: DataFrame, as_of: date | Column, days: int | None = LOOKBACK_DAYS) -> DataFrame:
    """Rows from ``days`` days before ``as_of`` to that date, both included. No days, or zero: the default."""
    days = days or LOOKBACK_DAYS
    end = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return fx.where(F.col("ds").between(F.date_sub(end, days), end))


def fx_summary(fx: DataFrame, n_obs: int = 30) -> DataFrame:
    """The latest rate, the one ``n_obs`` rows from the end (the first if there are fewer), and the change in percent."""
    numbered = fx.withColumn("rn", F.row_number().over(_series().orderBy(F.desc("ds"))))
    out = numbered.groupBy("series_id").agg(
        F.max("ds").alias("latest_ds"),
        F.max_by("y", "ds").alias("latest_rate"),
        F.coalesce(F.max(F.when(F.col("rn") == n_obs, F.col("y"))), F.min_by("y", "ds")).alias("reference_rate"),
        F.count("*").alias("n"),
    )
    return out.withColumn("rate_change_pct", percent_change(F.col("latest_rate"), F.col("reference_rate")))


def summary_errors(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("rate_change_pct").isNull()).select("series_id", F.lit("summary").alias("stage"), F.lit("no rate to compare with").alias("message"))


def to_business_days(fx: DataFrame) -> DataFrame:
    """Every Monday to Friday between a series' first and last date, with the rate of the last business day that has one.

    Weekend rows go, and are not carried into Monday; days before the first business day with a rate are left out.
    Series with a date twice are left out: see ``grid_errors``.
    """
    again = F.coalesce(F.lag("ds").over(ordered()) == F.col("ds"), F.lit(False))
    marked = fx.select("series_id", "ds", "y", again.cast("int").alias("again")).withColumn("last", F.max("ds").over(_series())).withColumn("twice", F.max("again").over(_series()) == 1)
    kept = marked.where(~F.col("twice") & _weekday(F.col("ds")) & F.col("y").isNotNull()).withColumn("until", F.coalesce(F.date_sub(F.lead("ds").over(ordered()), 1), F.col("last")))
    days = kept.select("series_id", "y", F.explode(F.sequence("ds", "until")).alias("ds"))
    return days.where(_weekday(F.col("ds"))).select("series_id", "ds", "y")


def grid_errors(fx: DataFrame) -> DataFrame:
    twice = fx.groupBy("series_id", "ds").agg(F.count("*").alias("n")).where("n > 1").select("series_id").distinct()
    return twice.select("series_id", F.lit("business_days").alias("stage"), F.lit("a date stands twice").alias("message"))


def future_business_days(fx: DataFrame, horizon: int) -> DataFrame:
    """``series_id, step, ds``: the next Mondays to Fridays after each series' last date."""
    last = fx.groupBy("series_id").agg(F.max("ds").alias("last")).where(F.col("last").isNotNull())
    days = F.slice(F.filter(F.sequence(F.date_add("last", 1), F.date_add("last", 2 * horizon + 3)), lambda d: F.weekday(d) < 5), 1, horizon)
    return last.select("series_id", F.posexplode(days).alias("at", "ds")).select("series_id", (F.col("at") + 1).alias("step"), "ds")


def holdout_split(fx: DataFrame, h: int) -> tuple[DataFrame, DataFrame]:
    """All but the last h rows of each series, and those."""
    numbered = fx.withColumn("rn", F.row_number().over(_series().orderBy(F.desc("ds"))))
    return numbered.where(F.col("rn") > h).drop("rn"), numbered.where(F.col("rn") <= h).drop("rn")


def ingest_counts(df: DataFrame, key: str = "series_id", when: str = "ds") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(when).alias("first"), F.max(when).alias("last"))
