"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Within a source every document is expected target / size times. Documents are ordered by size, expected copies are
prefix-summed in that order, one random offset is added per source, and a document is emitted once for each integer
boundary its step crosses. Ordering by size keeps the words taken within one document's size of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenora.llm.common import hash32, rank_rows, word_count
from tenora.session import stored

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 42


def _key(source: Column) -> Column:
    """Sources as text that is never null, in code point order with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def cyclic_weights(sizes: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """Give the sources, in code point order with null last, the weights in turn."""
    place = F.row_number().over(W.orderBy("source_")) - 1
    return sizes.withColumn("weight_", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target_`` to one row per source of (source_, size_, weight_).

    The sum of all sizes is shared by weight. A source gets at most ``max_repeats`` times its size, and what exceeds
    that is shared by weight among the others until none is above. Removing full sources in order of size / weight
    raises the share per weight until the last full one is gone and lowers it after, so the share is a maximum.
    """
    order = W.orderBy(F.col("size_") / F.col("weight_"), "source_")
    full = F.coalesce(F.sum(F.col("size_") * max_repeats).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight_").over(order.rowsBetween(0, W.unboundedFollowing))
    steps = sizes.withColumn("left_", F.sum("size_").over(W.partitionBy()) - full).withColumn("rest_", rest)
    level = F.max_by(F.struct("left_", "rest_"), F.col("left_") / F.col("rest_")).over(W.partitionBy())
    share = F.col("weight_") * F.col("level_.left_") / F.col("level_.rest_")
    target = F.least((F.col("size_") * max_repeats).cast("double"), share.cast("double"))
    return steps.withColumn("level_", level).select("source_", "size_", target.alias("target_"))


def copies(
    spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row per document: ``row`` (its columns, or those in ``keep``), ``size``, ``source_size``, ``target``, ``copies``.

    A null text has size 0. Null sources form one source, the last. Sources without words have target 0 and copies 0.
    The order of equal sizes follows a hash of the id, then the id (null first), so reruns agree whatever the
    partitioning; rows that repeat an id and size are interchangeable.
    """
    own = F.struct(*[F.col(c) for c in (docs.columns if keep is None else keep)])
    rows = docs.select(
        own.alias("row"), F.col(key).alias("id_"), _key(F.col(source)).alias("source_"),
        word_count(F.col(text)).alias("words_"), hash32(F.col(key)).alias("h_"),
    )
    narrow = stored(spark, rows.select("source_", "words_", "h_"), "sizes")
    sizes = narrow.groupBy("source_").agg(F.sum("words_").alias("size_"))
    goal = stored(spark, targets(cyclic_weights(sizes, weights), max_repeats), "targets")
    ranked = rank_rows(spark, rows, narrow, "source_", ["words_"], "h_", [F.col("id_")])
    expected = F.when(F.col("size_") > 0, F.col("target_") / F.col("size_")).otherwise(F.lit(0.0))
    offset = hash32(F.lit("mix"), F.lit(seed), F.col("source_")) / F.lit(float(2**32))
    part = F.col("expected_") - F.floor("expected_")
    reached = F.floor(F.col("rank_") * part + F.col("offset_"))
    crossed = F.least(F.lit(1), reached - F.floor((F.col("rank_") - 1) * part + F.col("offset_")))
    return (
        ranked.join(goal.withColumn("expected_", expected).withColumn("offset_", offset), "source_")
        .select(
            "row", F.col("words_").alias("size"), F.col("size_").alias("source_size"), F.col("target_").alias("target"),
            (F.floor("expected_") + crossed).alias("copies"),
        )
    )


def mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as many times as it is to be read, with the columns of ``docs``."""
    taken = copies(spark, docs, **options)
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: ``copies`` of a documents table in SQL, as (doc_id, size, source_size, target, taken).
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
f AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * {MAX_REPEATS}) OVER (
      ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
    CAST(sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS w
  FROM s),
l AS (SELECT arg_max(rest, rest / w) AS rest, arg_max(w, rest / w) AS w FROM f),
t AS (
  SELECT source, source_size, least(CAST({MAX_REPEATS} * source_size AS DOUBLE), f.weight * l.rest / l.w) AS target,
    CAST('0x' || substr(md5('mix {SEED} ' || source), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM f, l),
e AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e,
    row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id) AS r
  FROM d JOIN t USING (source))
SELECT doc_id, size, source_size, target, CAST(size * (floor(e) + least(1, floor(r * (e - floor(e)) + u)
    - floor((r - 1) * (e - floor(e)) + u))) AS BIGINT) AS taken FROM e
"""
