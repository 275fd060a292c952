"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
SQL can't express a trained model or a fingerprint, so ORACLE_SQL is None. Tests hold the near-duplicate stage against all
pairs, packing against the tokenizers library and the filters against planted documents.

In every stage null and empty texts, repeated rows, an empty table and further columns of any name have the results that
its docstring states; ties don't exist, as each decision hangs on a row's own text or, in near_duplicates, on an order of
keys and texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratewatch.llm import langid, near_copies, toxicity
from ratewatch.llm.common import cut
from ratewatch.llm.queries import packed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are in no language; ``lang`` of the others is the predicted one.

    Rejected: a null or empty text or one without a letter; a text of which no learned language spends fewer than five bits
    a byte (64 bits aside). Repeated rows stay or go together.
    """
    return langid.keep_known(docs, langid.learn(docs), lang="lang")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are more likely toxic than not. A null text is scored as an empty one; repeated rows alike."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies: five-word shingles, Jaccard similarity 0.8 or more.

    The one with the smallest doc_id stays, null last, then by a hash of its text. Texts without words are one group; rows
    that repeat in doc_id and text are one.
    """
    return near_copies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, as ``op6_vector_packing`` does. A null text is an empty one, which
    has one token; each row is packed once, so repeated rows are too."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
