"""Fixed-width bins over a frame, and counts per bin with empty bins listed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenora.functions.binning import bin_high, bin_label, bin_low, bin_ordinal
from tenora.functions.rates import share_of


class Bins(NamedTuple):
    column: str
    size: int
    low: int | None = None
    high: int | None = None


def bounds(df: DataFrame, specs: Mapping[str, Bins]) -> Column:
    """Struct of (lo, hi) per spec as one scalar subquery: one narrow scan, no join and no collect."""
    return df.select(F.struct(*[
        F.struct(
            (F.lit(b.low).cast("long") if b.low is not None else bin_low(F.min(b.column), b.size)).alias("lo"),
            (F.lit(b.high).cast("long") if b.high is not None else bin_high(F.max(b.column), b.size)).alias("hi"),
            F.count(b.column).alias("n"),
        ).alias(name)
        for name, b in specs.items()
    ])).scalar()


def with_bins(df: DataFrame, specs: Mapping[str, Bins]) -> DataFrame:
    """Add ``<name>_ordinal`` and ``<name>`` (label) for every spec."""
    ordinals, labels = {}, {}
    for name, b in specs.items():
        ends = F.col("_bounds")[name]
        ordinals[f"{name}_ordinal"] = bin_ordinal(F.col(b.column), b.size, ends["lo"], ends["hi"])
        labels[name] = bin_label(ends["lo"] + F.col(f"{name}_ordinal") * b.size, b.size)
    return (
        df.withColumn("_bounds", bounds(df, specs)).withColumns(ordinals).withColumns(labels).drop("_bounds")
    )


def bin_dimension(df: DataFrame, b: Bins) -> DataFrame:
    """Every bin between the bounds: (ordinal, label)."""
    lo, hi = F.col("ends.b.lo"), F.col("ends.b.hi")
    starts = F.when(hi > lo, F.sequence(lo, hi - b.size, F.lit(b.size).cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )
    return (
        df.sparkSession.range(1)
        .select(bounds(df, {"b": b}).alias("ends"))
        .select(F.posexplode(starts).alias("ordinal", "start"))
        .select("ordinal", bin_label(F.col("start"), b.size).alias("label"))
    )


def bins_by_status(df: DataFrame, b: Bins, status: str, statuses: Sequence[str]) -> DataFrame:
    """Wide counts of each status per bin; empty bins have zeros."""
    counts = (
        with_bins(df.select(b.column, status), {"b": b})
        .filter(F.col("b_ordinal").isNotNull())
        .groupBy("b_ordinal")
        .agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses])
    )
    return (
        bin_dimension(df, b)
        .join(counts, F.col("ordinal") == F.col("b_ordinal"), "left")
        .drop("b_ordinal")
        .na.fill(0, subset=list(statuses))
    )


def share_in_range(df: DataFrame, column: str, condition: Column, low: float, high: float) -> DataFrame:
    """Share of the rows meeting ``condition`` whose value lies in ``(low, high]``."""
    inside = condition & (F.col(column) > low) & (F.col(column) <= high)
    return df.agg(
        F.count_if(inside).alias("inside"),
        F.count_if(condition).alias("total"),
        share_of(F.count_if(inside), F.count_if(condition)).alias("share_pct"),
    )
