"""Long form of wide numeric frames, and small per-group results brought back to the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 4096


def to_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, value) with a double value, nulls left out.

    Statistics of many columns become a few aggregates over a short group key, which keeps the generated
    code small however wide the frame is.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])
    return (
        df.select(*keys, F.explode(cells).alias("cell"))
        .select(*keys, "cell.*")
        .filter(F.col("value").isNotNull())
    )


def bounded_broadcast(small: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``small`` as a broadcast side whose row count is checked while the query runs.

    More than ``limit`` rows raise an error (none are dropped): the caller should then join on the keys
    without broadcasting.
    """
    gathered = small.limit(limit + 1).agg(F.collect_list(F.struct(*small.columns)).alias("rows"))
    checked = F.when(F.size("rows") <= limit, F.col("rows")).otherwise(
        F.raise_error(F.lit(f"more than {limit} groups: use few_groups=False"))
    )
    return F.broadcast(gathered.select(F.explode(checked).alias("row")).select("row.*"))


def sorted_categories(df: DataFrame, column: str, limit: int = MAX_BROADCAST_ROWS) -> Column:
    """Sorted array of the distinct non-null values as one scalar; more than ``limit`` raise an error."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1)
    gathered = values.agg(F.array_sort(F.collect_list(column)).alias("values"))
    return gathered.select(
        F.when(F.size("values") <= limit, F.col("values")).otherwise(
            F.raise_error(F.lit(f"more than {limit} categories in {column}"))
        )
    ).scalar()


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], few_groups: bool = True) -> DataFrame:
    """Inner join of rows with one-row-per-group results."""
    return rows.join(bounded_broadcast(groups) if few_groups else groups, list(keys))
