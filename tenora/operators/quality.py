"""Describe, null cross-check, duplicates and constraint checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenora.operators.aggregate import null_counts
from tenora.operators.lookup import to_long
from tenora.operators.quantiles import percentiles_long
from tenora.operators.select import columns_of, replace_sentinels


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, unique, top, freq); ties for the top value go to the alphabetically first."""
    names = list(columns or columns_of(df, "text"))
    per_value = (
        df.select(*names).unpivot([], names, "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("value").alias("v")))
    return per_value.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("b")
    ).select("column", "count", "unique", F.col("b.v").alias("top"), (-F.col("b.m")).alias("freq"))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max), quartiles exact and interpolated."""
    long = to_long(df, list(columns or columns_of(df, "numeric")))
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = percentiles_long(long, ["column"], {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quartiles, "column")


def dataset_shape(df: DataFrame) -> DataFrame:
    """One row: row count, column count, and the text and numeric column lists."""
    text, numeric = columns_of(df, "text"), columns_of(df, "numeric")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(", ".join(text)).alias("text_columns"),
        F.lit(", ".join(numeric)).alias("numeric_columns"),
    )


def null_crosscheck(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Null counts of two sources side by side, only columns with nulls in both; sentinels count as null on the left."""
    a = null_counts(replace_sentinels(left)).withColumnRenamed("nulls", names[0])
    b = null_counts(right).withColumnRenamed("nulls", names[1])
    both = a.join(b, "column", "full_outer")
    return both.filter((F.col(names[0]) > 0) & (F.col(names[1]) > 0))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Each row that occurs more than once, with its count."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Number of rows beyond the first of each kind."""
    return duplicate_rows(df).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))


def duplicate_column_count(df: DataFrame) -> int:
    return len(df.columns) - len(set(df.columns))


class Check(NamedTuple):
    rule: str
    condition: str


def failed_checks(df: DataFrame, key: str, checks: Sequence[Check]) -> DataFrame:
    """(rule, key) per row and broken rule; a rule over null counts as kept, as a CHECK constraint would."""
    marks = F.array_compact(F.array(*[F.when(~F.expr(c.condition), F.lit(c.rule)) for c in checks]))
    return df.select(F.explode(marks).alias("rule"), F.col(key).cast("string").alias("key"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter(
        F.col("copies") > 1
    )


def violations(
    tables: Mapping[str, DataFrame],
    checks: Mapping[str, Sequence[Check]],
    unique: Mapping[str, str],
    references: Sequence[tuple[str, str, str]],
) -> DataFrame:
    """(table, rule, key) over all tables."""
    from tenora.operators.merge import orphans

    found = []
    for name, rules in checks.items():
        found.append(failed_checks(tables[name], "CustomerID", rules).select(F.lit(name).alias("table"), "rule", "key"))
    for name, key in unique.items():
        found.append(repeated_keys(tables[name], key).select(
            F.lit(name).alias("table"), F.lit(f"unique {key}").alias("rule"), F.col(key).cast("string").alias("key")
        ))
        found.append(tables[name].filter(F.col(key).isNull()).select(
            F.lit(name).alias("table"), F.lit(f"missing {key}").alias("rule"), F.lit(None).cast("string").alias("key")
        ))
    for child, key, parent in references:
        found.append(orphans(tables[child], key, tables[parent], key).select(
            F.lit(child).alias("table"), F.lit(f"reference {key}").alias("rule"), F.col(key).cast("string").alias("key")
        ))
    return reduce(DataFrame.unionByName, found)
