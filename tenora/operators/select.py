"""Column selection by type, by name and by content, plus row sampling and row ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenora.functions.text import sentinel_to_null, yes_no_flag
from tenora.operators.keys import numbered

# A column is a service when its lower-case name contains one of these.
SERVICE_WORDS = ("phone", "internet", "security", "backup", "protection", "tech", "stream", "unlimited")


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Names of the ``text``, ``int``, ``float`` or ``numeric`` columns."""
    wanted = {
        "text": (T.StringType,),
        "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
        "float": (T.FloatType, T.DoubleType, T.DecimalType),
        "numeric": (T.NumericType,),
    }[kind]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, wanted)]


def service_columns(df: DataFrame, words: Sequence[str] = SERVICE_WORDS) -> tuple[list[str], list[str]]:
    """Service columns split into (text, numeric)."""
    names = [c for c in df.columns if any(w in c.lower() for w in words)]
    text = set(columns_of(df, "text"))
    return [c for c in names if c in text], [c for c in names if c not in text]


def replace_sentinels(df: DataFrame) -> DataFrame:
    return df.withColumns({c: sentinel_to_null(F.col(c)) for c in columns_of(df, "text")})


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct non-null value: minimum equals maximum, so one plain pass."""
    flags = df.agg(*[
        F.coalesce(F.min(c).eqNullSafe(F.max(c)), F.lit(True)).alias(c) for c in df.columns
    ]).first()
    return [c for c in df.columns if flags[c]]


def drop_constant_columns(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, non_null, n_distinct), exact; values are pre-aggregated per column before the shuffle."""
    names = list(columns or df.columns)
    cells = df.select([F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "column", "value")
    per_value = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("value").isNotNull()
    return per_value.groupBy("column").agg(
        F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("non_null"),
        F.count_if(seen).alias("n_distinct"),
    )


def high_cardinality_columns(
    df: DataFrame, keep: Sequence[str] = (), divisor: int = 4, rsd: float = 0.01
) -> list[str]:
    """Text columns with more than ``rows // divisor`` distinct values, never one of ``keep``.

    A sketch settles the clear cases in one pass; only columns close to the limit are counted exactly.
    """
    names = [c for c in columns_of(df, "text") if c not in keep]
    if not names:
        return []
    got = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.approx_count_distinct(c, rsd).alias(c) for c in names],
    ).first()
    limit = got["_rows"] // divisor
    sure = {c for c in names if got[c] > limit * 1.25}
    near = [c for c in names if limit * 0.75 <= got[c] <= limit * 1.25]
    if near:
        exact = distinct_counts(df, near).filter(F.col("n_distinct") > limit)
        sure |= {r["column"] for r in exact.select("column").collect()}
    return [c for c in names if c in sure]


def binary_text_columns(df: DataFrame) -> list[str]:
    """Text columns with exactly two distinct values: everything equals the minimum or the maximum."""
    names = columns_of(df, "text")
    if not names:
        return []
    ends = df.agg(*[F.min(c).alias(f"lo_{c}") for c in names], *[F.max(c).alias(f"hi_{c}") for c in names]).first()
    open_ = [c for c in names if ends[f"lo_{c}"] != ends[f"hi_{c}"]]
    if not open_:
        return []
    others = df.agg(*[
        F.count_if(~F.col(c).isin(ends[f"lo_{c}"], ends[f"hi_{c}"])).alias(c) for c in open_
    ]).first()
    return [c for c in open_ if others[c] == 0]


def encode_binary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Two-valued text columns to 1 (Yes/Male) or 0."""
    names = binary_text_columns(df) if columns is None else list(columns)
    return df.withColumns({c: yes_no_flag(F.col(c)) for c in names})


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Z-scores with the population deviation; a constant column becomes 0. Statistics are one scalar row."""
    names = list(columns)
    stats = df.select(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in names
    ])).scalar()
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - stats[c]["m"], stats[c]["s"]), F.lit(0.0)))
        for c in names
    })


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Keep the first column of each name."""
    seen: set[str] = set()
    positional = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    keep = []
    for i, name in enumerate(df.columns):
        if name not in seen:
            seen.add(name)
            keep.append(F.col(f"_{i}").alias(name))
    return positional.select(*keep)


def sample_rows(df: DataFrame, fraction: float = 1.0, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """Seeded sample; the whole frame at 1.0.

    Rows are chosen by a hash of ``keys`` (all columns if none are named), so every action and every partitioning
    sees the same rows, and equal keys stay together.
    """
    if fraction >= 1.0:
        return df
    place = F.pmod(F.xxhash64(*(keys or df.columns), F.lit(seed)), F.lit(1_000_000))
    return df.filter(place < int(fraction * 1_000_000))


def sample_exact(df: DataFrame, fraction: float, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """Exactly ``round(fraction * rows)`` rows: those with the smallest hashes of ``keys`` (all columns if none).

    The hash is the first 15 hexadecimal digits of an MD5 of the seed and the keys, so any partitioning and any other
    engine choose the same rows. The last hash to take is found digit group by digit group from counts of at most 4096
    values each, without sorting the rows. Rows that tie at it are taken in key order, and equal keys in their stored
    order.
    """
    names = list(keys or df.columns)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    hashed = df.withColumn("_hash", F.substring(F.md5(F.concat_ws(" ", F.lit(str(seed)), *parts)), 1, 15))
    left = want = int(fraction * df.count() + 0.5)
    if want <= 0:
        return df.limit(0)
    prefix = ""
    for _ in range(5):
        digits = F.substring("_hash", len(prefix) + 1, 3).alias("d")
        counts = hashed.filter(F.col("_hash").startswith(prefix)).groupBy(digits).count().orderBy("d").collect()  # at most 4096
        for row in counts:
            if row["count"] >= left:
                prefix += row["d"]
                break
            left -= row["count"]
        else:
            return df
    surely = hashed.filter(F.col("_hash") < prefix).drop("_hash")
    ties = numbered(df.sparkSession, hashed.filter(F.col("_hash") == prefix).drop("_hash"), names, "_place")
    return surely.unionByName(ties.filter(F.col("_place") <= left).drop("_place"))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Consecutive row ids from 1 on for frames without a key, in the order of a stored layout; see ``numbered``."""
    return numbered(df.sparkSession, df, (), name)
