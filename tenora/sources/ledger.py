"""Imports that remember what they read: a stored ledger of files, so that a rerun reads only what is new.

A source is an entry of the folder whose name ends in the pattern's suffix: one file, or a folder of part files as
parallel writers leave it. Its size, number of files and last change tell whether it was read before.

Each run writes the rows of its new sources as one more version folder of their table, and its ledger rows last, in one
append. Rows of a version that no ledger row names are never read, so a run that dies leaves nothing behind that counts,
and the next one imports the same sources again. One import at a time may run on a ledger.
"""

from __future__ import annotations

import re
import traceback
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenora.functions.text import sanitize_header
from tenora.operators.keys import numbered
from tenora.sources.audit import FAILED, IMPORT_FAILED, SUCCESS
from tenora.sources.landing import GENERATED_WORDS, TYPE_LADDER, infer_types, read_text, registry_frame

# What a run finds about a source. RETYPED: not changed, but read again, as its table's types became wider.
NEW, CHANGED, UNCHANGED, RETYPED, MISSING = "new", "changed", "unchanged", "retyped", "missing"
#: Severities: a message, an error in the data or the call (it has an SQL state), any other error.
NOTICE, CORRECTABLE, OTHER = 10, 16, 20

_SOURCE = "Path string, Size long, Files long, Modified timestamp"
_ERROR = "ErrorMessage string, ErrorNumber string, ErrorState string, ErrorSeverity int, ErrorProcedure string, ErrorLine int"
SCHEMA = (
    "LogID long, Run long, ImportDate timestamp, FileName string, TableName string, Action string, Status string, "
    f"{_ERROR}, {_SOURCE}, Rows long, Version string, Layout string"
)
_CONDITION = re.compile(r"\[([A-Z][A-Z0-9_.]+)\].*?SQLSTATE: ([0-9A-Z]{5})", re.DOTALL)
_NUMBERS = [name for name, _, _ in TYPE_LADDER[:3]]


def _source_name(path: Column, folder: str) -> Column:
    """The entry of ``folder`` that a file below it belongs to."""
    return F.regexp_extract(path, f"{re.escape(folder)}/([^/]+)", 1)


def _plain(spark: SparkSession, folder: str) -> str:
    """The folder without scheme and host."""
    return spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()


def sources(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """(FileName, Path, Size, Files, Modified) of the sources in a folder, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    named = files.select(_source_name(F.col("path"), _plain(spark, folder)).alias("FileName"), "length", "modificationTime")
    kept = named.filter(F.col("FileName").endswith(suffix) & ~F.col("FileName").rlike("|".join(GENERATED_WORDS)))
    return kept.groupBy("FileName").agg(
        F.concat(F.lit(f"{folder.rstrip('/')}/"), F.first("FileName")).alias("Path"), F.sum("length").alias("Size"),
        F.count("*").alias("Files"), F.max("modificationTime").alias("Modified"))


def wider(a: str, b: str) -> str:
    """The narrowest type of the ladder that holds values of both."""
    if a == b:
        return a
    return max(a, b, key=_NUMBERS.index) if a in _NUMBERS and b in _NUMBERS else "string"


def merged_layout(old: T.StructType | None, text: DataFrame) -> T.StructType:
    """One layout for a table's rows and new ones, still as text; the columns must be the same.

    A column without a new value keeps its type; one that never had a value is text.
    """
    if old is not None and old.names != text.columns:
        raise ValueError(f"columns {text.columns} differ from the table's {old.names}")
    seen = {r["column"]: r["type"] for r in infer_types(text).filter("non_null > 0").collect()}
    known = {f.name: f.dataType.simpleString() for f in old.fields} if old is not None else {}
    return _struct({
        c: wider(known.get(c, seen[c]), seen[c]) if c in seen else known.get(c, "string") for c in text.columns})


def _struct(columns: Mapping[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in columns.items()))


def _ddl(layout: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layout.fields)


def error_row(error: Exception) -> tuple:
    """(message, number, state, severity, procedure, line) of an error; the last two name the innermost call of this package."""
    number, state = type(error).__name__, None
    if isinstance(error, PySparkException):
        number, state = error.getCondition() or number, error.getSqlState()
    elif told := _CONDITION.search(str(error)):  # a failed write reaches Python as the bare error of the JVM
        number, state = told.groups()
    calls = traceback.extract_tb(error.__traceback__)
    own = [c for c in calls if "/tenora/" in c.filename] or calls
    severity = CORRECTABLE if state or isinstance(error, ValueError) else OTHER
    return str(error), number, state, severity, own[-1].name if own else None, own[-1].lineno if own else None


class ImportLedger:
    """Ledger under ``root/ledger``, tables under ``root/tables``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.path = spark, root, f"{root}/ledger"

    def entries(self) -> DataFrame:
        """All rows of all runs; none before the first."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def current(self) -> DataFrame:
        """The last import of every source that has one."""
        done = self.entries().filter(F.col("Version").isNotNull())
        last = F.max_by(F.struct(*done.columns), "LogID").alias("last")
        return done.groupBy("FileName", "TableName").agg(last).select("last.*")

    def plan(self, found: DataFrame, registry: DataFrame) -> DataFrame:
        """The registered sources with what is to be done about each; sources without a table are skipped."""
        state = ["Size", "Files", "Modified"]
        known = self.current().select("FileName", "TableName", *[F.col(c).alias(f"_{c}") for c in state])
        same = F.lit(True)
        for c in state:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        action = (
            F.when(F.col("Path").isNull(), MISSING).when(F.col("_Size").isNull(), NEW).when(same, UNCHANGED).otherwise(CHANGED))
        wanted = registry.select(F.col("file_name").alias("FileName"), F.col("table_name").alias("TableName"))
        return wanted.join(found, "FileName", "left").join(known, ["FileName", "TableName"], "left").select(
            "FileName", "TableName", action.alias("Action"), "Path", *state)

    def table(self, name: str) -> DataFrame:
        """The rows of the last import of every source of a table, in its newest layout, with their ``source_file``."""
        live = self.current().filter(F.col("TableName") == name)
        layouts = live.groupBy("Layout").agg(
            F.max("LogID").alias("at"), F.collect_set("Version").alias("versions")).orderBy(F.desc("at")).collect()
        if not layouts:
            raise FileNotFoundError(f"no import of {name}")
        newest, base, rows = T.StructType.fromDDL(layouts[0]["Layout"]), f"{self.root}/tables/{name}", None
        for part in layouts:  # a type only ever widens, so there are few layouts
            stored = T.StructType.fromDDL(f"{part['Layout']}, source_file string, version string")
            read = self.spark.read.schema(stored).option("basePath", base).parquet(
                *[f"{base}/version={v}" for v in part["versions"]])
            cast = read.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in newest.fields], "source_file", "version")
            rows = cast if rows is None else rows.union(cast)
        keys = live.select(F.col("FileName").alias("source_file"), F.col("Version").alias("version"))
        return rows.join(keys, ["source_file", "version"], "left_semi").select(*newest.names, "source_file")

    def layout(self, name: str) -> T.StructType | None:
        last = self.current().filter(F.col("TableName") == name).agg(F.max_by("Layout", "LogID")).first()[0]
        return T.StructType.fromDDL(last) if last else None

    def _append(self, rows: DataFrame, run: int) -> None:
        last = self.entries().agg(F.coalesce(F.max("LogID"), F.lit(0))).first()[0]
        stamped = rows.withColumns({"Run": F.lit(run).cast("long"), "ImportDate": F.current_timestamp()})
        ids = numbered(self.spark, stamped, ["TableName", "FileName"], "LogID", start=last + 1)
        ids.select(*T.StructType.fromDDL(SCHEMA).names).write.mode("append").parquet(self.path)


def _load(ledger: ImportLedger, folder: str, table: str, paths: list[str], layout: T.StructType, version: str) -> DataFrame:
    """Write the typed rows of some sources as a version of their table; (FileName, Rows) of what was written.

    A row that does not fit, or a file whose header is not that of the first, fails the whole load.
    """
    spark = ledger.spark
    header = spark.read.option("header", True).csv(paths[0]).columns
    typed = T.StructType([T.StructField(raw, f.dataType) for raw, f in zip(header, layout.fields)])
    read = spark.read.schema(typed).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(paths)
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    named = read.select("*", _source_name(F.url_decode(encoded), _plain(spark, folder))).toDF(*layout.names, "source_file")
    path = f"{ledger.root}/tables/{table}/version={version}"
    named.write.parquet(path)
    stored = spark.read.schema("source_file string").parquet(path)
    return stored.groupBy(F.col("source_file").alias("FileName")).agg(F.count("*").alias("Rows"))


def import_new(
    ledger: ImportLedger, folder: str, registry: Mapping[str, str], declared: Mapping[str, str] | None = None
) -> dict[str, int]:
    """Import the registered sources of ``folder`` that are new or changed; the number of sources read per table.

    A table that fails is logged with its error and keeps its rows, the others go on, and the next run tries it again.
    Types come from all values and the table's earlier types; where they become wider, all sources of the table that are
    still there are read again, so nothing is kept in a narrower form. ``declared`` fixes the layout of a table instead.
    """
    spark, run = ledger.spark, ledger.entries().agg(F.coalesce(F.max("Run"), F.lit(0))).first()[0] + 1
    planned = ledger.plan(sources(spark, folder), registry_frame(spark, registry)).collect()  # one row per registered source
    outcome, counts, read = [], None, {}
    present = [p for p in planned if p["Action"] != MISSING]
    note = (SUCCESS, "Found source files") if present else (FAILED, "No source files found")
    outcome.append((None, None, None, *note, None, None, NOTICE, None, None, None, None, None, None, None, None))
    for table in sorted({p["TableName"] for p in planned}):
        mine = [p for p in planned if p["TableName"] == table]
        due = [p for p in mine if p["Action"] in (NEW, CHANGED)]
        retyped, version, layout, failure = set(), uuid.uuid4().hex, None, None
        try:
            if due:
                before = ledger.layout(table)
                if declared and table in declared:
                    layout = T.StructType.fromDDL(declared[table])
                    seen = [sanitize_header(c) for c in spark.read.option("header", True).csv(due[0]["Path"]).columns]
                    if seen != layout.names:
                        raise ValueError(f"columns {seen} differ from the declared {layout.names}")
                else:
                    layout = merged_layout(before, read_text(spark, [p["Path"] for p in due]))
                if before is not None and layout != before:
                    retyped = {p["FileName"] for p in mine if p["Action"] == UNCHANGED}
                    due += [p for p in mine if p["FileName"] in retyped]
                written = _load(ledger, folder, table, [p["Path"] for p in due], layout, version)
                written = written.withColumn("TableName", F.lit(table))
                counts = written if counts is None else counts.union(written)
                read[table] = len(due)
        except Exception as e:  # logged with the sources of the table, which keeps its earlier rows
            failure = error_row(e)
        for p in mine:
            action = RETYPED if p["FileName"] in retyped else p["Action"]
            state = (p["Path"], p["Size"], p["Files"], p["Modified"])
            if action == MISSING:
                end = (FAILED, f"File {p['FileName']} does not exist", None, None, CORRECTABLE, None, None, *state, None, None)
            elif action == UNCHANGED:
                end = (SUCCESS, None, None, None, NOTICE, None, None, *state, None, None)
            elif failure:
                end = (IMPORT_FAILED, *failure, *state, None, None)
            else:
                end = (SUCCESS, None, None, None, NOTICE, None, None, *state, version, _ddl(layout))
            outcome.append((p["FileName"], table, action, *end))
    columns = f"FileName string, TableName string, Action string, Status string, {_ERROR}, {_SOURCE}, Version string, Layout string"
    rows = spark.createDataFrame(outcome, columns)
    rows = rows.join(counts, ["FileName", "TableName"], "left") if counts is not None else rows.withColumn("Rows", F.lit(None))
    empty = F.when(F.col("Version").isNotNull(), F.coalesce("Rows", F.lit(0))).cast("long")  # a source with a header alone
    ledger._append(rows.withColumn("Rows", empty), run)
    return read
