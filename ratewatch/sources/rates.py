"""Daily rates from landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewatch.functions import day_first_date, decimal_number, map_value
from ratewatch.sources.markup import read_table_files

#: Names in the payloads.
SERIES, CLOSE = "Time Series FX (Daily)", "4. close"
_PAYLOAD = f"`{SERIES}` map<string,map<string,string>>, `Error Message` string, `Note` string"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``series_id`` (the file's name without its ending) and the parsed ``payload`` of each JSON file."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("series_id"), "value")
    return parse_payloads(raw)


def parse_payloads(raw: DataFrame) -> DataFrame:
    """``series_id, payload`` of ``series_id, value`` (JSON texts)."""
    return raw.select("series_id", F.from_json("value", _PAYLOAD).alias("payload"))


def split_payload_errors(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads without an error, and ``series_id, stage, message`` of the others.

    A payload is refused as a whole if it has an error or a note, or can't be read.
    """
    refused = F.col("payload.`Error Message`").isNotNull() | F.col("payload.Note").isNotNull()
    unreadable = F.col("payload").isNull() | F.col(f"payload.`{SERIES}`").isNull()
    message = F.coalesce(F.nullif(F.col("payload.`Error Message`"), F.lit("")), F.nullif(F.col("payload.Note"), F.lit("")), F.lit("unreadable payload"))
    bad = F.coalesce(refused, F.lit(False)) | unreadable
    return payloads.where(~bad), payloads.where(bad).select("series_id", F.lit("rates").alias("stage"), message.alias("message"))


def rates_of(payloads: DataFrame) -> DataFrame:
    """``series_id, ds, y``: a row for each date of each payload."""
    rows = payloads.select("series_id", F.explode(F.col(f"payload.`{SERIES}`")).alias("ds", "values"))
    return rows.select("series_id", F.col("ds").try_cast("date").alias("ds"), map_value(F.col("values"), CLOSE).try_cast("double").alias("y"))


def read_rates_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rates of all readable payloads, and errors. A payload with a date or rate that can't be read fails as a whole."""
    good, errors = split_payload_errors(read_payloads(spark, path))
    entries = F.map_entries(F.col(f"payload.`{SERIES}`"))
    broken = F.exists(entries, lambda e: e["key"].try_cast("date").isNull() | map_value(e["value"], CLOSE).try_cast("double").isNull())
    return rates_of(good.where(~broken)), errors.unionByName(good.where(broken).select("series_id", F.lit("rates").alias("stage"), F.lit("a date or rate can't be read").alias("message")))


def clean_table(raw: DataFrame, decimal: str = ",", thousands: str | None = None) -> DataFrame:
    """``series_id, ds, y`` of ``series_id, date_str, y`` texts; rows with anything unreadable go."""
    return raw.select("series_id", day_first_date(F.col("date_str")).alias("ds"), decimal_number(F.col("y"), decimal, thousands).alias("y")).dropna(subset=["ds", "y"])


def read_rates_table(spark: SparkSession, path: str, series_id: str, decimal: str = ",", thousands: str | None = None, sep: str = ";", header: bool = True) -> DataFrame:
    """Rates of a two-column text table: day-first dates, and numbers with a decimal sign."""
    raw = spark.read.csv(path, schema="date_str string, y string", sep=sep, header=header)
    return clean_table(raw.withColumn("series_id", F.lit(series_id)), decimal, thousands)


def read_rates_html(spark: SparkSession, path: str, series_id: str, decimal: str = ",", thousands: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rates of the rows of HTML tables with two cells or more, and errors of pages that have none."""
    rows = read_table_files(spark, path)
    cells = rows.where(F.col("error").isNull()).select(F.lit(series_id).alias("series_id"), F.col("first").alias("date_str"), F.col("second").alias("y"))
    errors = rows.where(F.col("error").isNotNull()).select(F.lit(series_id).alias("series_id"), F.lit("rates").alias("stage"), F.concat("error", F.lit(": "), "file").alias("message"))
    return clean_table(cells, decimal, thousands), errors


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "series_id") -> DataFrame:
    """Each series from ``primary``, or as a whole from ``fallback`` if ``primary`` has nothing of it."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))
