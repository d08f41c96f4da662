"""Right-closed binning. A bin has an ordinal (sortable) and a printable label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_low(minimum: Column, size: int) -> Column:
    """Lower bound: the minimum rounded down to a multiple of the bin size."""
    return (F.floor(minimum / size) * size).cast("long")


def bin_high(maximum: Column, size: int) -> Column:
    """Upper bound: the maximum rounded up to a multiple of the bin size."""
    return (F.ceil(maximum / size) * size).cast("long")


def bin_ordinal(value: Column, size: int, low: Column, high: Column) -> Column:
    """Number of the interval ``(a, a+size]``; ``low`` itself is in bin 0, values outside give null."""
    return (
        F.when(value == low, F.lit(0))
        .when((value > low) & (value <= high), F.ceil((value - low) / size) - 1)
        .cast("int")
    )


def bin_label(start: Column, size: int) -> Column:
    """``a-(a+size-1)``, although the interval is right-closed: 20 is in ``0-19``."""
    return F.concat(start.cast("string"), F.lit("-"), (start + (size - 1)).cast("string"))


def group_by_edges(
    value: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False
) -> Column:
    """Struct (ordinal, label) for explicit right-closed intervals; the lowest edge is outside by default."""
    if len(labels) != len(edges) - 1:
        raise ValueError("labels must be one fewer than edges")
    ordinal, label = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(""))
    for i, text in enumerate(labels):
        above = value >= edges[i] if include_lowest and i == 0 else value > edges[i]
        inside = above & (value <= edges[i + 1])
        ordinal, label = ordinal.when(inside, F.lit(i)), label.when(inside, F.lit(text))
    return F.struct(ordinal.cast("int").alias("ordinal"), label.alias("label"))
