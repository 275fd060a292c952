"""A stored rate panel: a folder for each month, and files that are bucketed and sorted by series within it.

The look-back reads only its months, and what works on a series finds it in one place: no exchange is needed.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ratewatch.operators.panel import LOOKBACK_DAYS, lookback

BUCKETS = 32


def write_panel(fx: DataFrame, table: str, path: str | None = None, buckets: int = BUCKETS, mode: str = "overwrite") -> dict:
    """Store ``fx (series_id, ds, y)`` as a table (in ``path``, else in the warehouse). Returns its row count, first and last date.

    They are observed while the rows are written, so counting takes no job of its own.
    """
    seen = Observation()
    rows = fx.select("series_id", "ds", "y", F.date_format("ds", "yyyy-MM").alias("month")).observe(seen, F.count(F.lit(1)).alias("n"), F.min("ds").alias("first"), F.max("ds").alias("last"))
    # by bucket, so that a task writes few files a month
    writer = rows.repartition(buckets, "series_id").write.format("parquet").mode(mode).partitionBy("month").bucketBy(buckets, "series_id").sortBy("series_id", "ds")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return seen.get


def read_panel(spark: SparkSession, table: str, as_of: date | None = None, days: int | None = LOOKBACK_DAYS) -> DataFrame:
    """``series_id, ds, y`` of the look-back before ``as_of`` (all dates without one); other months' folders aren't read."""
    rows = spark.table(table)
    if as_of is not None:
        first = as_of - timedelta(days=days or LOOKBACK_DAYS)
        rows = lookback(rows.where(F.col("month").between(f"{first:%Y-%m}", f"{as_of:%Y-%m}")), as_of, days)
    return rows.select("series_id", "ds", "y")
