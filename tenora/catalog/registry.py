from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns, because the last bits of a floating sum depend on row order."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in names}) if names else df


def register(name: str, covers: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)``; ``covers`` lists the blueprint ids it exercises."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(name, tuple(covers.split()), lambda spark, sf: rounded(build(spark, sf)), sql)
        return build

    return wrap
