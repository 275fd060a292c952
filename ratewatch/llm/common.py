"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words (space and tab to carriage return).
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
#: Only A-Z are lower-cased, so that results don't hang on a locale.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = str.maketrans(UPPER, LOWER)


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode, where it may be unset, one temporary folder."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(f"file://{tempfile.mkdtemp(prefix='spark-ratewatch-')}")
    return _own_folder[0]


def cut(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def drop(df: DataFrame) -> None:
    """Remove what ``cut`` wrote, once something later has been written that no longer needs it."""
    jvm, files = df.sparkSession._jvm, df.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def sweep(spark: SparkSession) -> None:
    """Shuffle files of finished steps stay on disk until the driver collects its garbage: let it do so between large steps."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)  # Python's side lets go of the driver's objects in a thread
        spark._jvm.System.gc()


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with the columns named c0, c1, ..., and the new name of each: dots and clashes can't do harm then."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def text_slices(batch: pa.RecordBatch, column: str = "text", chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch with about so many bytes of text (or binary), of which few are Python objects then; null counts as empty."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64).cumsum()
    empty = b"" if pa.types.is_binary(batch.column(column).type) else ""
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars)))
        part = batch.slice(at, end - at)
        yield part, [t or empty for t in part.column(column).to_pylist()]
        at = end


def keep_first(docs: DataFrame, first: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``first (key, hash, rows)`` names: by key and ``xxhash64`` of the text.

    Where ``rows`` says that several rows are alike in both, one of them stays.
    """
    plain, names = plain_names(docs)
    chosen = cut(first.select(F.col("key").alias("__key"), F.col("hash").alias("__hash"), F.col("rows").alias("__rows")), "chosen")
    hashed = plain.withColumn("__text_hash", F.xxhash64(names[text]))
    matched = hashed[names[key]].eqNullSafe(F.col("__key")) & (F.col("__text_hash") == F.col("__hash"))
    kept = hashed.join(chosen.where("__rows = 1"), matched, "left_semi").select(*plain.columns)
    twice = chosen.where("__rows > 1")
    if not twice.isEmpty():
        kept = kept.unionByName(hashed.join(twice, matched, "left_semi").dropDuplicates([names[key], "__text_hash"]).select(*plain.columns))
    return kept.toDF(*docs.columns)


def first_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``key, hash, rows`` of the first row of each component: the smallest key, nulls last, then the smallest hash.

    ``rows (key, hash, node)`` are folded by node before they meet ``groups (node, root)``, so that a node with very many
    copies is one row there.
    """
    same = rows.groupBy("node", "key", "hash").agg(F.count("*").alias("rows"))
    least = lambda: F.min(F.struct(F.isnull("key").alias("none"), "key", "hash", "rows"))
    by_node = same.groupBy("node").agg(least().alias("x"))
    joined = by_node.join(groups, "node", "left").select(F.coalesce("root", "node").alias("root"), "x.*")
    return joined.groupBy("root").agg(least().alias("x")).select("x.key", "x.hash", "x.rows")
