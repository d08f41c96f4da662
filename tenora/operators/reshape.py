"""Crosstabs, pivots and unpivots. Work is done on counts, so only small frames are reshaped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenora.functions.rates import share_of
from tenora.operators.aggregate import non_null, value_counts


def unstack(
    df: DataFrame,
    index: Sequence[str],
    column: str,
    value: str | Column,
    values: Sequence | None = None,
    fill: float | None = None,
    prefix: str = "",
) -> DataFrame:
    """Long to wide. An absent cell is null unless ``fill`` is given.

    With ``values`` the plan stays lazy, and a label outside them raises while the query runs, so no cell is
    ever lost (null labels are left out). Without it Spark reads the distinct values first (its own limit on
    pivot width applies).
    """
    if values is not None:
        label = F.col(column)
        message = F.concat(F.lit(f"{column} has a value that is not listed: "), label.cast("string"))
        df = df.withColumn(column, F.when(label.isNull() | label.isin(list(values)), label).otherwise(F.raise_error(message)))
    agg = F.first(value) if isinstance(value, str) else value
    wide = df.groupBy(*index).pivot(column, list(values) if values is not None else None).agg(agg)
    cells = [c for c in wide.columns if c not in index]
    if fill is not None:
        wide = wide.na.fill(fill, subset=cells)
    return wide.withColumnsRenamed({c: f"{prefix}{c}" for c in cells}) if prefix else wide


def crosstab_long(df: DataFrame, row: str, column: str, normalize: str = "index") -> DataFrame:
    """Counts and percentages of the combinations that occur; ``normalize`` is index, columns or all."""
    counts = value_counts(df, column, [row])
    if normalize == "all":
        total = counts.select(F.sum("n")).scalar()
    else:
        by = {"index": row, "columns": column}[normalize]
        total = F.sum("n").over(Window.partitionBy(by))
    return counts.withColumn("pct", share_of(F.col("n"), total))


def crosstab(
    df: DataFrame,
    row: str,
    column: str,
    values: Sequence | None = None,
    normalize: str = "index",
    prefix: str = "pct_",
) -> DataFrame:
    """Percentage crosstab, one row per row label, 0 for absent combinations, null labels left out."""
    shares = crosstab_long(df, row, column, normalize)
    return unstack(shares, [row], column, "pct", values, fill=0.0, prefix=prefix)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], names: tuple[str, str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), *names)


def value_share_by_column(
    df: DataFrame, columns: Sequence[str], group: str, name: str = "Service", value: str = "Value"
) -> DataFrame:
    """For each text column: share of each value inside each group (columns of the pivot add up to 100)."""
    counts = non_null(
        melt(df.select(group, *columns), [group], columns, (name, value)), [group, value]
    ).groupBy(name, value, group).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(name, group))
    return counts.withColumn("pct", share_of(F.col("n"), total))


def transpose(
    df: DataFrame, index: str, name: str = "column", prefix: str = "", labels: Sequence | None = None
) -> DataFrame:
    """Rows to columns for a small result whose cells share a type; new columns carry the index labels.

    With ``labels`` the plan stays lazy, as in :func:`unstack`.
    """
    cells = [c for c in df.columns if c != index]
    return unstack(df.unpivot([index], cells, name, "value"), [name], index, "value", labels, prefix=prefix)
