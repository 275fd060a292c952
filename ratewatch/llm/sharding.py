"""Shards by fixed virtual slots.

Each record is hashed into one of a few thousand virtual slots, for good. Bytes are summed by slot, and a table of
(version, slot, shard) says where each slot lives. Only that table, whose size is the number of slots whatever the
corpus, is edited when shards are added: an edit is a few more rows with a higher version. Every slot is in the map from
version 1 on, whether a record is in it or not, so that records that come later have a place. All of it is DataFrame code.

Defined results: a null text has no bytes (size 8, checksum 0); a null doc_id is hashed by its text's checksum;
repeated rows share a slot and get places of their own, in no particular order; an empty table gives an empty table.
Texts of any length are only measured; slots with the same bytes go by their number; further columns aren't looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ratewatch.llm.common import cut, shared_folder

SLOTS = 4096
#: Bytes that a record takes besides its text.
RECORD_BYTES = 8


def records(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, virtual_slot`` of each row."""
    body = F.coalesce(docs[text].cast("binary"), F.lit(b""))
    out = docs.select(docs[key].alias(key), (F.octet_length(body) + RECORD_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    return out.withColumn("virtual_slot", F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), F.col("text_crc32").cast("string")))), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot, bytes, n`` of all slots, 0 of those that no record is in."""
    used = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(used, "virtual_slot", "left").na.fill(0, ["bytes", "n"])


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots in order of bytes, largest first, each to the shard with the fewest bytes so far.

    The fold runs over one array with an entry a slot, a bounded number.
    """
    ordered = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot").alias("slot")))).alias("slots"))

    def place(state: Column, x: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda load, i: F.when(i == least, load - x["less"]).otherwise(load)).alias("loads"),
            F.concat(state["shards"], F.array(least)).alias("shards"),
        )

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("shards"))
    placed = F.aggregate("slots", start, place)
    return ordered.select(F.explode(F.arrays_zip(F.col("slots.slot").alias("slot"), placed["shards"].alias("shard"))).alias("x")).select(F.lit(1).alias("version"), F.col("x.slot").alias("virtual_slot"), F.col("x.shard").alias("shard"))


def current(slot_map: DataFrame) -> DataFrame:
    """The latest shard of each slot."""
    return slot_map.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def add_shard(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The map with a further version in which shard number ``shards`` (so far 0 to shards - 1) is filled.

    Each shard above the new mean gives its smallest slots, up to what it has too much; no other slot moves.
    """
    by_shard = W.partitionBy("shard")
    placed = current(slot_map).join(F.broadcast(sizes), "virtual_slot")
    mean = placed.agg((F.sum("bytes") / (shards + 1)).alias("mean"))
    moved = (
        placed.crossJoin(F.broadcast(mean))  # one row
        .withColumn("given", F.sum("bytes").over(by_shard.orderBy("bytes", "virtual_slot").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("spare", F.sum("bytes").over(by_shard) - F.col("mean"))
        .where("given <= spare")
    )
    version = slot_map.agg((F.max("version") + 1).alias("version"))
    edits = moved.crossJoin(F.broadcast(version)).select("version", "virtual_slot", F.lit(shards).alias("shard"))
    return slot_map.unionByName(edits)


def assign(rows: DataFrame, sizes: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with their shard and ``slot``: their place in it, gapless from 0.

    Rows are numbered within virtual slots, which are many and even; where a slot begins in its shard comes from the
    sizes of the slots. So no task ever holds a whole shard. A row whose slot isn't in the map is an error.
    """
    begins = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    table = current(slot_map).join(F.broadcast(sizes), "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n").over(begins), F.lit(0)).alias("begin"))
    place = F.row_number().over(W.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size"))
    lost = F.raise_error(F.concat(F.lit("no shard for virtual slot "), F.col("virtual_slot"))).cast("int")
    # one row a virtual slot: safe to send to all executors
    placed = rows.withColumn("place", place).join(F.broadcast(table), "virtual_slot", "left").withColumn("shard", F.coalesce("shard", lost))
    return placed.withColumn("slot", (F.col("begin") + F.col("place") - 1).cast("long")).drop("begin", "place")


def write_map(slot_map: DataFrame, path: str) -> None:
    """Store the map, a folder a version: versions that are there stay as they are, new ones are added."""
    slot_map.repartition(1, "version").write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("version").cast("int"), "virtual_slot", "shard")


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents' places and the slot map, which is stored in ``map_path`` (else in the shared folder).

    Version 1 of the map has so many shards, version 2 is its edit for one more; places are those of version 1, and
    ``shard_after`` is the document's shard under version 2.
    """
    spark = docs.sparkSession
    rows = cut(records(docs, slots), "shard-records")
    sizes = cut(slot_sizes(rows, slots), "slot-sizes")
    path = map_path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    write_map(first_map(sizes, shards), path)
    first = read_map(spark, path)
    write_map(add_shard(first, sizes, shards).where("version = 2"), path)
    second = read_map(spark, path)
    after = current(second).withColumnRenamed("shard", "shard_after")
    return assign(rows, sizes, first.where("version = 1")).join(F.broadcast(after), "virtual_slot"), second
