"""Aggregate expressions for rates, shares and correlations. All are ANSI-safe and codegen-friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent_where(condition: Column) -> Column:
    """Percentage of all rows meeting ``condition``; a null condition counts as not met."""
    return F.count_if(condition) * F.lit(100.0) / F.count(F.lit(1))


def mean_of(c: str | Column) -> Column:
    """Mean of the non-null values as double."""
    return F.avg(_col(c).cast("double"))


def share_of(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """``part / whole * scale``; null when the whole is zero or null."""
    return F.try_divide(part * F.lit(scale), whole)


def status_rate(status: str | Column, hit: str, among: list[str]) -> Column:
    """Share of status ``hit`` among rows whose status is in ``among`` (0..1); null when there are none."""
    s = _col(status)
    return F.try_divide(
        F.count_if(s == hit).cast("double"), F.count_if(s.isin(*among)).cast("double")
    )


def guarded_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over complete pairs; null (never an error) when either side is constant."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    complete_x = F.when(y.isNotNull(), x)
    complete_y = F.when(x.isNotNull(), y)
    return F.try_divide(
        F.covar_pop(x, y), F.stddev_pop(complete_x) * F.stddev_pop(complete_y)
    )
