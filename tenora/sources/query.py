"""Reading from tables, SQL text and external databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def fetch(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Run SQL text; keyword frames are visible in it as ``{name}``."""
    return spark.sql(query, **tables)


def fetch_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Read an external query, split over ``partition_column`` so that no single task reads it all."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if partition_column is None:
        return reader.option("query", query).load()
    return reader.options(
        dbtable=f"({query}) source", partitionColumn=partition_column, lowerBound=str(lower),
        upperBound=str(upper), numPartitions=str(partitions),
    ).load()
