"""Raw CSV folder to typed landing tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenora.functions.text import sanitize_header
from tenora.sources.audit import EXPORT_FAILED, FAILED, IMPORT_FAILED, STARTED, SUCCESS, AuditLog
from tenora.sources.sinks import export_typed, publish, published

# Files whose name contains one of these are outputs of earlier runs, not sources.
GENERATED_WORDS = ("transformed", "cleaned")
# The type ladder, narrowest first, as (type to declare, cast that must succeed, shape of the
# text). Text without the shape fails at once, without trying the cast.
TYPE_LADDER = (
    ("smallint", "smallint", r"^\s*[+-]?[0-9]+\s*$"),
    ("int", "int", r"^\s*[+-]?[0-9]+\s*$"),
    ("decimal(18,3)", "decimal(18,3)", r"^\s*[+-]?[0-9.]+([eE][+-]?[0-9]+)?\s*$"),
    ("date", "date", r"^\s*[0-9]+-"),
)


def discover(
    spark: SparkSession, folder: str, pattern: str = "*.csv", exclude: Sequence[str] = GENERATED_WORDS
) -> DataFrame:
    """(path, file_name) of the source files. Only the listing is used; file contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    named = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    return named.filter(~F.col("file_name").rlike("|".join(exclude))) if exclude else named


def registry_frame(spark: SparkSession, registry: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(list(registry.items()), "file_name string, table_name string")


def mapped_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files with a table; unmapped files are skipped."""
    return files.join(registry, "file_name")


def missing_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered files that are not in the folder."""
    return registry.join(files.select("file_name"), "file_name", "left_anti")


def has_sources(files: DataFrame, registry: DataFrame) -> bool:
    return not files.join(registry, "file_name", "left_semi").isEmpty()


def read_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All columns as text, header names sanitised."""
    raw = spark.read.option("header", True).csv(paths if isinstance(paths, str) else list(paths))
    return raw.toDF(*[sanitize_header(c) for c in raw.columns])


def read_positional(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """All-text staging with columns ``col1`` ... ``coln``; quoted fields stay whole. A wider header is an error."""
    width = len(spark.read.option("header", True).csv(path).columns)
    if width > n:
        raise ValueError(f"the file has {width} columns, more than {n}")
    schema = T.StructType([T.StructField(f"col{i + 1}", T.StringType()) for i in range(n)])
    return spark.read.schema(schema).option("header", True).csv(path)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """The reader's own inference, for cross-checking."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return raw.toDF(*[sanitize_header(c) for c in raw.columns])


def split_cells(lines: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """One row per delimited cell with its position; the separator is literal text, not a pattern."""
    others = [c for c in lines.columns if c != column]
    literal = "".join(c if c.isalnum() or c.isspace() else f"[{c}]" if c not in "\\^[]" else f"\\{c}" for c in separator)
    return lines.select(*others, F.posexplode(F.split(column, literal)).alias("pos", "cell"))


def _narrowest(value: Column) -> Column:
    """Place in the ladder of the narrowest type that a text fits, the ladder's length if none; null for null.

    The shape of whole numbers is tried first and once, so most cells cost one pattern and one cast.
    """
    casts = [value.try_cast(cast).isNotNull() for _, cast, _ in TYPE_LADDER]
    none = F.lit(len(TYPE_LADDER))
    shaped = F.when(value.isNull(), F.lit(None).cast("int"))
    for shape in dict.fromkeys(shape for *_, shape in TYPE_LADDER):
        first = next(i for i, step in enumerate(TYPE_LADDER) if step[2] == shape)
        found = F.when(casts[first], F.lit(first))
        for i in range(first + 1, len(TYPE_LADDER) - 1):  # numbers: the next wider ones
            found = found.when(casts[i], F.lit(i))
        shaped = shaped.when(value.rlike(shape), found.otherwise(none))
    return shaped.otherwise(none)


def infer_types(text: DataFrame, rows: str = "all") -> DataFrame:
    """(column, position, type, non_null, one failure count per ladder step).

    One aggregation over all rows: the declared type is the narrowest without a failed cast. ``rows='first'``
    looks at a single row, which is cheap but may declare a type that later rows do not fit.
    """
    if rows == "first":
        text = text.limit(1)
    elif rows != "all":
        raise ValueError("rows must be 'all' or 'first'")
    cells = text.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in text.columns])).alias("position", "value"))
    fits = _narrowest(F.col("value")).alias("fits")
    # A whole number that fits a type fits the wider ones; a date is no number.
    failures = [
        F.count_if(F.col("fits") != i if i == len(TYPE_LADDER) - 1 else F.col("fits") > i).alias(f"bad_{i}")
        for i in range(len(TYPE_LADDER))
    ]
    seen = cells.filter("position is not null").select("position", "value", fits).groupBy("position").agg(
        F.count("value").alias("non_null"), *failures
    ).withColumn("column", F.element_at(F.array(*[F.lit(c) for c in text.columns]), F.col("position") + 1))
    kind = F.when(F.col("non_null") == 0, F.lit("string"))
    for i, (name, _, _) in enumerate(TYPE_LADDER):
        kind = kind.when(F.col(f"bad_{i}") == 0, F.lit(name))
    return seen.withColumn("type", kind.otherwise(F.lit("string"))).select(
        "column", "position", "type", "non_null", *[f"bad_{i}" for i in range(len(TYPE_LADDER))]
    )


def schema_from(inferred: DataFrame) -> T.StructType:
    """The declared schema: one small row per column."""
    rows = inferred.orderBy("position").select("column", "type").collect()
    return T.StructType.fromDDL(", ".join(f"`{r['column']}` {r['type']}" for r in rows))


def load_typed(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Typed read; any row that does not fit fails the load."""
    reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
    return reader.csv(paths if isinstance(paths, str) else list(paths))


def load_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and the rows (still as text) in which some value does not fit its type."""
    text = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).option(
        "header", True).csv(path)
    broken = F.lit(False)
    for f in schema.fields:
        broken = broken | (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
    typed = text.filter(~broken).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return typed, text.filter(broken)


def imported(spark: SparkSession, target: str, table: str) -> DataFrame:
    """The current version of a table that ``import_folder`` wrote."""
    return published(spark, f"{target}/{table}", [table])[table]


def import_folder(
    spark: SparkSession,
    folder: str,
    registry: Mapping[str, str],
    target: str,
    log: AuditLog,
    infer_rows: str = "all",
) -> dict[str, str]:
    """Import every mapped file of ``folder`` as a new version under ``target/<table>`` and export it beside.

    Files of one table are read together. A table that fails is logged and its current version stays, as readers
    (``imported``) see a version only once it is whole; the others go on. Returns the tables written with their paths.
    """
    names = registry_frame(spark, registry)
    files = discover(spark, folder)
    if not has_sources(files, names):
        log.event(FAILED, "No source files found")
        return {}
    log.event(SUCCESS, "Found source files")
    for row in missing_files(files, names).collect():
        log.event(FAILED, f"File {row['file_name']} does not exist", row["file_name"], row["table_name"])
    per_table = mapped_files(files, names).groupBy("table_name").agg(F.collect_list("path").alias("paths"))
    written = {}
    for row in per_table.collect():  # one row per registered table
        table, paths = row["table_name"], row["paths"]
        shown = ", ".join(sorted(p.rsplit("/", 1)[-1] for p in paths))
        log.event(STARTED, None, shown, table)
        try:
            schema = schema_from(infer_types(read_text(spark, paths), infer_rows))
            version = uuid.uuid4().hex
            publish({table: load_typed(spark, paths, schema)}, f"{target}/{table}", version)
        except Exception as e:
            log.error(e, f"import {table}", "import_folder")
            log.event(IMPORT_FAILED, str(e), shown, table)
            continue
        log.event(SUCCESS, None, shown, table)
        written[table] = f"{target}/{table}/versions/{version}/{table}"
        try:
            export_typed(spark.read.parquet(written[table]), f"{target}/export/{table}")
        except Exception as e:
            log.event(EXPORT_FAILED, str(e), shown, table)
    return written
