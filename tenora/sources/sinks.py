"""Writers: transformed dataset, typed export, reports, models and versioned table sets."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_transformed(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Clean dataset with a header, for use outside this engine."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def export_typed(df: DataFrame, path: str) -> None:
    """Typed files plus their column layout as JSON text."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    layout = df.sparkSession.createDataFrame([(df.schema.json(),)], "layout string")
    layout.coalesce(1).write.mode("overwrite").text(f"{path}/layout")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Read an export back by its stored layout, without touching file footers first."""
    layout = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/layout").first()[0]))
    return spark.read.schema(layout).parquet(f"{path}/data")


def write_report(results: Mapping[str, DataFrame], root: str, fmt: str = "json") -> None:
    """Each result table under its name."""
    for name, df in results.items():
        df.write.mode("overwrite").format(fmt).save(f"{root}/{name}")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    try:
        spark.read.text(f"{path}/metadata").limit(1).collect()
    except AnalysisException as e:
        raise FileNotFoundError(f"no model at {path}") from e
    return PipelineModel.load(path)


def save_table(df: DataFrame, name: str, schema: T.StructType | None = None) -> None:
    """Create or replace a catalogue table, optionally with declared column types."""
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    df.write.mode("overwrite").saveAsTable(name)


def publish(
    tables: Mapping[str, DataFrame],
    root: str,
    version: str,
    validate: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Write a set of tables as one unit.

    All tables go to a new version folder; readers see them only after the version is appended to the
    version log, which happens last and only when ``validate`` finds nothing. A failed run leaves the
    previous version in place.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/versions/{version}/{name}")
    stored = {
        name: spark.read.schema(df.schema).parquet(f"{root}/versions/{version}/{name}") for name, df in tables.items()
    }
    if validate is not None and not (broken := validate(stored)).isEmpty():
        raise ValueError(f"version {version} breaks constraints, e.g. {broken.first()}")
    entry = spark.createDataFrame([(version,)], "version string").withColumn("published", F.current_timestamp())
    entry.coalesce(1).write.mode("append").parquet(f"{root}/version_log")
    return stored


def published(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of the newest published version."""
    log = spark.read.schema("version string, published timestamp").parquet(f"{root}/version_log")
    version = log.agg(F.max_by("version", "published")).first()[0]
    return {name: spark.read.parquet(f"{root}/versions/{version}/{name}") for name in names}


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Push to an external database in parallel batches."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
