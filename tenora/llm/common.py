"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenora.session import stored

#: A word, by code points.
WORD = r"[^\x20\x09-\x0D]+"
#: ``rank_rows`` numbers at most this many rows in one piece of a task, or a MAX_HEAVY-th of all rows if that is more.
PIECE_ROWS = 64
MAX_HEAVY = 65_536


#: Rows of whole texts in one Arrow batch.
TEXT_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame, with the session's Arrow batches cut to TEXT_ROWS rows, as whole texts may be very long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df


def release() -> None:
    """Give what finished batches left behind back to the machine; Python workers stay, and wait, after their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def settled(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``stored``, whose shuffle files are deleted as soon as the table is written, so disk never holds several steps'."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        return stored(spark, df, name)
    finally:
        spark.conf.set(setting, before)


def discard(spark: SparkSession, table: DataFrame) -> None:
    """Delete a table that ``settled`` wrote, once nothing reads it any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash32(*parts: Column) -> Column:
    """The first 32 bits of an MD5 over the parts joined by spaces, nulls as ``null``. Portable to any SQL engine."""
    text = F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def rank_rows(
    spark: SparkSession, rows: DataFrame, narrow: DataFrame, group: str, ordered: list[str], h: str, ties: list[Column],
) -> DataFrame:
    """Add ``rank_`` (1, 2, ... within ``group`` by ``ordered``, then ``h``, then ``ties``) without one task per group.

    ``h`` is a 32-bit hash. ``narrow`` holds ``group``, ``ordered`` and ``h`` of the same rows and is read three times,
    so it should be stored. Only groups of equal ``(group, ordered)`` are numbered together, and those with too many
    rows are cut into ranges of ``h``. Fewer than MAX_HEAVY of them can exist, as each holds more than a MAX_HEAVY-th of
    all rows, which bounds the broadcast. Counts before each piece come from a prefix sum over the counted pieces.
    """
    keys = [group, *ordered]
    total = narrow.count()
    most = max(PIECE_ROWS, math.ceil(total / MAX_HEAVY))
    heavy = F.broadcast(
        narrow.groupBy(*keys).agg(F.count("*").alias("n_")).filter(F.col("n_") > most)
        .select(*[F.col(k).alias(f"{k}_h") for k in keys], F.ceil(F.col("n_") / most).alias("parts_"))
    )

    def cut(df: DataFrame) -> DataFrame:
        same = [df[k] == heavy[f"{k}_h"] for k in keys]
        piece = F.coalesce(F.floor(F.col(h) * F.col("parts_") / F.lit(2**32)), F.lit(0))
        return df.join(heavy, same, "left").withColumn("piece_", piece).drop("parts_", *[f"{k}_h" for k in keys])

    before = W.partitionBy(group).orderBy(*ordered, "piece_").rowsBetween(W.unboundedPreceding, -1)
    pieces = cut(narrow).groupBy(*keys, "piece_").agg(F.count("*").alias("n_"))
    offsets = pieces.select(*keys, "piece_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    within = W.partitionBy(*keys, "piece_").orderBy(h, *ties)
    numbered = cut(rows).withColumn("at_", F.row_number().over(within))
    return (
        numbered.join(offsets, [*keys, "piece_"])
        .withColumn("rank_", F.col("before_") + F.col("at_")).drop("piece_", "at_", "before_")
    )
