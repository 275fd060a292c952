"""Tables that remember what went out: digests that a model has answered, and posts that were handed out.

A ledger is a folder of Parquet files to which rows are added, none is changed; the newest row of a key holds. One run writes
to a ledger at a time: nothing locks it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewatch.sources.sinks import MOST_CHARS

REPLIES = "model string, digest_hash string, raw string, attempts int"
POSTS = "series_id string, run_date string, version long, status string, post string"
#: What a post may be: still within, only shown, gone out, or refused by the other side.
READY, DRY_RUN, SENT, FAILED = "ready", "dry-run", "sent", "failed"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """``model, digest_hash, raw, attempts`` of all digests that were ever sent."""
    return _read(spark, path, REPLIES)


def ask(digests: DataFrame, model: str, fn: Callable[[list[str]], list[str]], path: str, attempts: int = 3, concurrency: int = 8) -> DataFrame:
    """``batch, raw`` of ``digests (batch, digest)``: replies that the ledger has, and those that ``fn`` gives now, which are added to it.

    A digest is known by its text and the model's name, whatever its batch; equal ones are sent once. Each is tried so many
    times, and at most ``concurrency`` tasks send. A failure is written too, but doesn't count as known: the next run tries again.
    """
    spark = digests.sparkSession

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            raws, tried = [], []
            for digest in part["digest"]:
                raw, n = None, 0
                while raw is None and n < attempts:
                    n += 1
                    try:
                        raw = fn([digest])[0]
                    except Exception:  # noqa: BLE001  whatever a caller's function raises is a failed try
                        raw = None
                raws.append(raw)
                tried.append(n)
            yield pd.DataFrame({"model": model, "digest_hash": part["digest_hash"], "raw": pd.Series(raws, dtype=object), "attempts": pd.Series(tried, dtype="int32")})

    named = digests.select("batch", "digest", F.sha2("digest", 256).alias("digest_hash"))
    mine = F.col("model") == model
    known = read_replies(spark, path).where(mine & F.col("raw").isNotNull()).select("digest_hash").distinct()
    new = named.groupBy("digest_hash").agg(F.first("digest").alias("digest")).join(known, "digest_hash", "left_anti")
    new.repartition(concurrency).mapInPandas(run, REPLIES).write.mode("append").parquet(path)
    answers = read_replies(spark, path).where(mine).groupBy("digest_hash").agg(F.max("raw").alias("raw"))
    return named.join(answers, "digest_hash", "left").select("batch", "raw")


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each series and run date."""
    rows = _read(spark, path, POSTS)
    return rows.groupBy("series_id", "run_date").agg(F.max_by(F.struct("version", "status", "post"), "version").alias("x")).select("series_id", "run_date", "x.*")


def _add(path: str, rows: DataFrame) -> None:
    rows.select(*(x.split()[0] for x in POSTS.split(", "))).write.mode("append").parquet(path)


def hand_out(posts: DataFrame, path: str, enabled: bool, most_chars: int = MOST_CHARS) -> DataFrame:
    """Posts that go out now: added to the ledger as ready (or dry-run) and returned, each series and run date once.

    A post that was sent is never handed out again. One that is ready stays, but a new text takes its place; one that failed or
    was only shown comes again. Empty and over-long posts aren't handed out: see ``sinks.post_outbox``.
    """
    status = READY if enabled else DRY_RUN
    last = read_posts(posts.sparkSession, path).select("series_id", "run_date", F.col("version").alias("v"), F.col("status").alias("was"), F.col("post").alias("old"))
    fit = posts.where(F.length("post").between(1, most_chars)).groupBy("series_id", "run_date").agg(F.max("post").alias("post"))
    same = F.col("was").eqNullSafe(F.lit(status)) & (F.col("old") == F.col("post"))
    due = fit.join(last, ["series_id", "run_date"], "left").where(~F.col("was").eqNullSafe(F.lit(SENT)) & ~same)
    _add(path, due.select("series_id", "run_date", (F.coalesce("v", F.lit(0)) + 1).alias("version"), F.lit(status).alias("status"), "post"))
    return read_posts(posts.sparkSession, path).where(F.col("status") == status)


def mark(outcomes: DataFrame, path: str, status: Column | str = "status") -> None:
    """Add what became of posts: ``outcomes (series_id, run_date, status)``, sent or failed. Those that were never handed out are left out."""
    told = outcomes.select("series_id", "run_date", (F.col(status) if isinstance(status, str) else status).alias("new"))
    last = read_posts(outcomes.sparkSession, path)
    _add(path, told.join(last, ["series_id", "run_date"]).where(F.col("new").isin(SENT, FAILED) & (F.col("status") != F.col("new"))).select("series_id", "run_date", (F.col("version") + 1).alias("version"), F.col("new").alias("status"), "post"))
