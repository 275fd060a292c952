"""Steps that are written, so that nothing computes them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

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


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as it was read back from the shared folder: a lost executor doesn't compute it again."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
