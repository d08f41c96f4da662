"""Grouped statistics. Groups with a null key are left out, as a data-frame group-by would."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenora.functions.rates import guarded_corr, mean_of, percent_where, share_of, status_rate
from tenora.operators.quantiles import exact_percentiles, join_on_keys

_STATS = {
    "mean": mean_of,
    "std": lambda c: F.stddev_samp(F.col(c).cast("double")),
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
}


def non_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def group_stats(
    df: DataFrame, by: Sequence[str], stats: Mapping[str, Sequence[str]], extra: Sequence[Column] = ()
) -> DataFrame:
    """``<column>_<stat>`` for each requested statistic, in one aggregation (medians in their own)."""
    keys = list(by)
    rows = non_null(df, keys)
    plain = [
        _STATS[s](c).alias(f"{c}_{s}") for c, names in stats.items() for s in names if s != "median"
    ]
    with_median = [c for c, names in stats.items() if "median" in names]
    parts = []
    if plain or extra:
        parts.append(rows.groupBy(*keys).agg(*plain, *extra))
    if with_median:
        parts.append(exact_percentiles(rows, with_median, {"median": 0.5}, keys))
    if len(parts) == 2 and not keys:
        raise ValueError("a median next to other statistics needs a grouping key")
    order = [f"{c}_{s}" for c, names in stats.items() for s in names]
    joined = join_on_keys(parts, keys)
    return joined.select(*keys, *order, *[c for c in joined.columns if c not in {*keys, *order}])


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Frequency of each non-null value, optionally within groups."""
    keys = [*by, column]
    return non_null(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def value_shares(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Frequency and percentage of each value; the window runs over the counts, not over the rows."""
    counts = value_counts(df, column, by)
    total = F.sum("n").over(Window.partitionBy(*by)) if by else counts.select(F.sum("n")).scalar()
    return counts.withColumn("pct", share_of(F.col("n"), total))


def mode_with_share(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Commonest value (alphabetically first on a tie), its count and its share of all non-null values."""
    counts = value_counts(df, column, by)
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col(column).alias("value")))
    return (
        counts.groupBy(*by)
        .agg(best.alias("best"), F.sum("n").alias("total"))
        .select(
            *by,
            F.col("best.value").alias("top"),
            (-F.col("best.minus_n")).alias("top_n"),
            share_of(-F.col("best.minus_n"), F.col("total")).alias("top_pct"),
        )
    )


def churn_and_retention(
    df: DataFrame, status: str, churned: str = "Churned", stayed: str = "Stayed", joined: str = "Joined"
) -> DataFrame:
    """Churned and stayed as a percentage of all rows except the newly joined."""
    s = F.col(status)
    base = F.count(F.lit(1)) - F.count_if(s == joined)
    return df.agg(
        F.count_if(s == churned).alias("churned"),
        F.count_if(s == stayed).alias("stayed"),
        F.count_if(s == joined).alias("joined"),
        share_of(F.count_if(s == churned), base).alias("churn_rate"),
        share_of(F.count_if(s == stayed), base).alias("retention_rate"),
    )


def churn_among_settled(
    df: DataFrame, by: Sequence[str], status: str, churned: str = "Churned", stayed: str = "Stayed"
) -> DataFrame:
    """Churned / (churned + stayed) per group, as a fraction."""
    return non_null(df, by).groupBy(*by).agg(
        F.count_if(F.col(status) == churned).alias("churned"),
        F.count_if(F.col(status) == stayed).alias("stayed"),
        status_rate(status, churned, [churned, stayed]).alias("rate"),
    )


def churn_percent(df: DataFrame, by: Sequence[str], status: str, churned: str = "Churned") -> DataFrame:
    """Churned percentage of all rows per group."""
    return non_null(df, by).groupBy(*by).agg(percent_where(F.col(status) == churned).alias("churn_pct"))


def correlation_matrix(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), listwise: bool = False
) -> DataFrame:
    """Pearson matrix in long form (x, y, r). Each pair is computed once, in a single aggregation."""
    rows = df.na.drop(subset=list(columns)) if listwise else df
    pairs = list(combinations(columns, 2))
    with_itself = [F.when(F.stddev_pop(F.col(c).cast("double")) > 0, 1.0).alias(f"{c}|{c}") for c in columns]
    wide = non_null(rows, by).groupBy(*by).agg(
        *with_itself, *[guarded_corr(a, b).alias(f"{a}|{b}") for a, b in pairs]
    )
    cells = [
        F.struct(
            F.lit(a).alias("x"),
            F.lit(b).alias("y"),
            F.col(f"`{b}|{a}`" if (b, a) in pairs else f"`{a}|{b}`").alias("r"),
        )
        for a, b in product(columns, repeat=2)
    ]
    return wide.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")


def correlation_with(df: DataFrame, target: str, others: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Correlation of ``target`` with each other column, one row per group."""
    return non_null(df, by).groupBy(*by).agg(
        *[guarded_corr(target, c).alias(f"corr_{c}") for c in others]
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls), from one pass over the rows."""
    names = list(columns or df.columns)
    once = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return once.unpivot([], names, "column", "nulls")


def top_k(df: DataFrame, metric: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` largest rows by ``metric``; equal metrics are ordered by ``ties``."""
    return df.orderBy(F.desc_nulls_last(metric), *[F.asc(t) for t in ties]).limit(k)


def text_list(df: DataFrame, column: str, separator: str = ", ") -> DataFrame:
    """Distinct values of a small registry column as one sorted, delimited string."""
    values = df.select(column).distinct()
    return values.agg(F.array_join(F.array_sort(F.collect_list(column)), separator).alias("names"))
