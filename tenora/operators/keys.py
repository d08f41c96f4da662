"""Surrogate keys 1, 2, 3, ... for small dimensions and for tables of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenora.session import scratch_path, stored

BUCKETS = 4096


def numbered(
    spark: SparkSession, df: DataFrame, order: Sequence[Column | str] = (), id_column: str = "row_id", start: int = 1,
    unique: bool = False,
) -> DataFrame:
    """Every row of ``df`` with consecutive numbers in ``order``, for tables of any size and any repetition of keys.

    The rows are stored, dealt to ranges of the order, sorted inside each range and stored again; a row's number is its
    place in its file plus the rows of the files before it, so no window ever holds the rows of one key. Rows that tie
    are told apart by their place in the first stored layout, and without ``order`` that layout is the order; where
    the order is ``unique`` that first copy is not needed. The frame returned reads stored files only: every action sees the same numbers. Only the row counts of the files (one
    file a partition) meet in one task and are broadcast.
    """
    name, place = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    rows, ties, by = df, [], [F.col(c) if isinstance(c, str) else c for c in order]
    if not (unique and by):
        rows = stored(spark, df, "unnumbered")
    if by:
        if not unique:
            ties = [F.col("_file"), F.col("_place")]
            rows = rows.select("*", name.alias("_file"), place.alias("_place"))
        path = scratch_path(spark, "ranges")
        rows.repartitionByRange(*by, *ties).sortWithinPartitions(*by, *ties).drop("_file", "_place").write.parquet(path)
        rows = spark.read.schema(df.schema).parquet(path)
    placed = rows.select("*", name.alias("_file"), place.alias("_place"))
    part, chunk = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long"), F.regexp_extract("_file", r"-c(\d+)", 1).cast("long")
    counts = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy(part, chunk).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_place") + start
    return placed.join(F.broadcast(offsets), "_file").select(*df.columns, number.cast("long").alias(id_column))


def append_small_keys(
    target: DataFrame, fresh: DataFrame, order: Sequence[str], id_column: str
) -> DataFrame:
    """Give new dimension members the ids after the current maximum, in natural-key order.

    Members are numbered through :func:`numbered`, so there may be any number of them.
    """
    last = target.select(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    added = numbered(target.sparkSession, fresh, order, "_number", unique=True)
    added = added.withColumn(id_column, (F.col("_number") + last).cast(target.schema[id_column].dataType))
    return target.unionByName(added.select(*target.columns))


def keep_ids(current: DataFrame | None, rows: DataFrame, key: Sequence[str], id_column: str) -> DataFrame:
    """``rows`` with ids that survive a reload: keys of ``current`` keep theirs, new ones follow in key order.

    ``current`` is the table of the load before (None at the first one). ``key`` is unique and never null. Keys that
    are gone leave gaps, and their ids are not given again while ``current`` holds the largest.
    """
    key = list(key)
    if current is None:
        return numbered(rows.sparkSession, rows, key, id_column, unique=True).select(id_column, *rows.columns)
    known = current.select(*key, F.col(id_column).cast("long").alias(id_column))
    last = known.select(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    fresh = numbered(rows.sparkSession, rows.join(known, key, "left_anti"), key, id_column, unique=True)
    fresh = fresh.withColumn(id_column, F.col(id_column) + last)
    columns = [id_column, *rows.columns]
    return rows.join(known, key).select(*columns).unionByName(fresh.select(*columns))


def dense_ids(df: DataFrame, key: Sequence[str], id_column: str, start: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Dense unique ids for a keyed table of any size.

    Rows are numbered inside hash buckets of the unique key, and each bucket starts where the counts of
    the earlier ones end. Only the bucket counts (a fixed number of rows) pass through one task; the
    numbering depends on the set of keys alone, not on partitioning or retries.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    placed = df.withColumn("_bucket", bucket)
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*key))
    return (
        placed.join(F.broadcast(offsets), "_bucket")  # at most ``buckets`` rows
        .withColumn(id_column, (F.col("_before") + inside + (start - 1)).cast("long"))
        .select(id_column, *df.columns)
    )
