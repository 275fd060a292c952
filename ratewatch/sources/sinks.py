"""Writers of reports, and the posts that are ready to go out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 280


def write_reports(reports: DataFrame, path: str, key: str = "run_date") -> None:
    """One folder for each run date; a date that is written again replaces only its own folder."""
    reports.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(key).parquet(path)


def post_outbox(posts: DataFrame, enabled: bool, most_chars: int = MOST_CHARS) -> tuple[DataFrame, DataFrame]:
    """Posts that could go out (marked ``dry-run`` unless enabled), and errors for those that are too long. Empty ones go."""
    filled = posts.where(F.length("post") > 0)
    ready = filled.where(F.length("post") <= most_chars).withColumn("status", F.lit("ready" if enabled else "dry-run"))
    errors = filled.where(F.length("post") > most_chars).select("series_id", F.lit("post").alias("stage"), F.concat(F.lit("post has "), F.length("post").cast("string"), F.lit(" characters")).alias("message"))
    return ready, errors
