"""Sharding through fixed virtual slots. DataFrame functions only.

A record's id and text are hashed into one of thousands of slots, which never changes. Bytes are summed per slot, and a map of
slots to shards, kept by version, spreads them: the first version gives the slots, heaviest first, each to the shard
with the fewest bytes; a later version edits only the slots it must move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenora.llm.common import hash32
from tenora.session import scratch_path, stored

SLOTS = 4096
SHARDS = 8


def slot_of(key: Column, crc: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of an id with the CRC of its text; nulls count as the text ``null``."""
    return (hash32(key, crc) % slots).cast("int")


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Sum (bytes) and count (n) of rows (virtual_slot, size); at most one row per slot."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(used: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1, (virtual_slot, shard), of the used slots: heaviest first, each to the lightest shard so far.

    The fold runs over one array of at most as many entries as there are slots.
    """
    item = F.struct((-F.col("bytes")).alias("less"), "virtual_slot")
    start = F.struct(
        F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda _: F.lit(0).cast("long")).alias("loads"),
        F.array().cast("array<int>").alias("shards"),
    )

    def place(acc: Column, x: Column) -> Column:
        lightest = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        loads = F.transform(acc["loads"], lambda v, i: F.when(i + 1 == lightest, v - x["less"]).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(acc["shards"], F.array(lightest - 1)).alias("shards"))

    listed = used.agg(F.sort_array(F.collect_list(item)).alias("slots"))
    placed = listed.select("slots", F.aggregate("slots", start, place)["shards"].alias("shards"))
    return placed.select(F.explode(F.arrays_zip("slots", "shards")).alias("z")).select(
        F.col("z.slots.virtual_slot").alias("virtual_slot"), F.col("z.shards").alias("shard"))


def grown_map(current: DataFrame, used: DataFrame, shards: int) -> DataFrame:
    """The next version for one shard more: slots move only into the new shard, ``shards``.

    Every shard gives up slots, lightest first, while what it has given stays within its excess over the new mean.
    """
    joined = current.join(used.select("virtual_slot", "bytes"), "virtual_slot", "left").fillna(0, ["bytes"])
    mean = F.sum("bytes").over(W.partitionBy()) / (shards + 1)
    excess = F.sum("bytes").over(W.partitionBy("shard")) - mean
    given = F.sum("bytes").over(W.partitionBy("shard").orderBy("bytes", "virtual_slot"))
    moves = joined.withColumn("moves", given <= excess)
    return moves.select("virtual_slot", F.when(F.col("moves"), F.lit(shards)).otherwise(F.col("shard")).alias("shard"))


def store_map(path: str, slot_map: DataFrame, version: int) -> None:
    """Write one version of a map; an existing version is never overwritten."""
    slot_map.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def place(rows: DataFrame, used: DataFrame, slot_map: DataFrame, ties: list[str]) -> DataFrame:
    """Add ``shard`` and ``slot``, the row's place in its shard (0, 1, ...), to rows with a ``virtual_slot``.

    Places are counted from per-slot totals, so only the rows of one virtual slot are numbered together. The map is
    broadcast: it has at most one row per slot.
    """
    order = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = slot_map.join(used, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start_"))
    within = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*ties)) - 1
    numbered = rows.withColumn("at_", within).join(F.broadcast(starts), "virtual_slot")
    return numbered.withColumn("slot", F.col("start_") + F.col("at_")).drop("start_", "at_")


def shard(
    spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS,
    slots: int = SLOTS, map_path: str | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot, next_shard) of every document; shards hold near equal bytes.

    The size is the text's UTF-8 bytes plus 1, and 1 for null, whose CRC is null. Rows that share an id (or have none) but
    not a text are spread over the slots; rows equal in both share one. Versions 1 and 2 of the map are stored under
    ``map_path``, or in the scratch folder: the present one, and that for one shard more, which gives ``next_shard``.
    """
    data = F.col(text).cast("binary")
    rows = stored(spark, docs.select(
        F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(data), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"), slot_of(F.col(key), F.crc32(data), slots).alias("virtual_slot"),
    ), "slotted")
    used = stored(spark, slot_bytes(rows), "slot-bytes")
    path = map_path or scratch_path(spark, "slot-map")
    store_map(path, first_map(used, shards), 1)
    current = load_map(spark, path, 1)
    store_map(path, grown_map(current, used, shards), 2)
    grown = load_map(spark, path, 2).withColumnRenamed("shard", "next_shard")
    placed = place(rows, used, current, ["doc_id", "text_crc32", "size"])
    return placed.join(F.broadcast(grown), "virtual_slot")  # at most one row per slot
