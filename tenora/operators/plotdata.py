"""The numbers behind the plots: histograms, box statistics and scatter points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenora.operators.aggregate import non_null
from tenora.operators.lookup import join_groups, to_long
from tenora.operators.quantiles import percentiles_long


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(column, ordinal, low, high, n) of equal-width, left-closed bins; the last bin is closed.

    Each row is reduced to bin numbers before the shuffle. A column with one value gets half a unit of
    room on each side, as plotting libraries do.
    """
    long = to_long(df, columns)
    lo, hi = F.min("value"), F.max("value")
    ends = long.groupBy("column").agg(
        F.when(hi > lo, lo).otherwise(lo - 0.5).alias("lo"), F.when(hi > lo, hi).otherwise(hi + 0.5).alias("hi")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    ordinal = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    return (
        join_groups(long, ends, ["column"])
        .groupBy("column", ordinal.alias("ordinal"), "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "column", "ordinal",
            (F.col("lo") + F.col("ordinal") * width).alias("low"),
            (F.col("lo") + (F.col("ordinal") + 1) * width).alias("high"),
            "n",
        )
    )


def histogram_by_distinct(df: DataFrame, column: str) -> DataFrame:
    """Histogram of an integer column with as many bins as it has distinct values."""
    n = df.agg(F.count_distinct(column)).first()[0]
    return histograms(df, [column], bins=max(int(n), 1))


def box_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(column, n, q1, median, q3, whisker_low, whisker_high, outliers) per group.

    Whiskers stop at the outermost data points within 1.5 interquartile ranges of the box.
    """
    slot = [*by, "column"]
    long = to_long(non_null(df, by), columns, by)
    quartiles = percentiles_long(long, slot, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    x, reach = F.col("value"), (F.col("q3") - F.col("q1")) * 1.5
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    return join_groups(long, quartiles, slot).groupBy(*slot, "q1", "median", "q3").agg(
        F.count(x).alias("n"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def scatter_points(df: DataFrame, columns: Sequence[str], fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Points for a scatter or pair plot, thinned by a seeded fraction chosen by the caller."""
    points = df.select(*columns)
    return points if fraction >= 1.0 else points.sample(False, fraction, seed)
