"""Append-only logs of imports and errors."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMPORT_SCHEMA = "FileName string, TableName string, Status string, ErrorMessage string"
ERROR_SCHEMA = (
    "ErrorNumber string, ErrorState string, ErrorProcedure string, ErrorMessage string, Operation string"
)
# Statuses an import passes through.
STARTED, SUCCESS, FAILED = "Started", "Success", "Failed"
IMPORT_FAILED, EXPORT_FAILED = "Data Import Failed", "Export Failed"


class AuditLog:
    """One small file per event; nothing is ever rewritten, so concurrent jobs can share a log."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.imports_path, self.errors_path = spark, f"{root}/import_log", f"{root}/error_log"

    def _append(self, row: tuple, schema: str, stamp: str, path: str) -> None:
        event = self.spark.createDataFrame([row], schema).withColumn(stamp, F.current_timestamp())
        event.coalesce(1).write.mode("append").parquet(path)

    def event(
        self, status: str, message: str | None = None, file: str | None = None, table: str | None = None
    ) -> None:
        self._append((file, table, status, message), IMPORT_SCHEMA, "ImportDate", self.imports_path)

    def error(self, error: Exception, operation: str, procedure: str | None = None) -> None:
        number = state = None
        if isinstance(error, PySparkException):
            number, state = error.getCondition(), error.getSqlState()
        row = (number or type(error).__name__, state, procedure, str(error), operation)
        self._append(row, ERROR_SCHEMA, "ErrorTime", self.errors_path)

    def imports(self) -> DataFrame:
        return self.spark.read.schema(f"{IMPORT_SCHEMA}, ImportDate timestamp").parquet(self.imports_path)

    def errors(self) -> DataFrame:
        return self.spark.read.schema(f"{ERROR_SCHEMA}, ErrorTime timestamp").parquet(self.errors_path)

    def latest(self) -> DataFrame:
        return latest_status(self.imports(), ["FileName", "TableName"], "Status", "ImportDate")


def latest_status(events: DataFrame, keys: list[str], status: str, stamp: str) -> DataFrame:
    """Last status per key."""
    return events.groupBy(*keys).agg(
        F.max_by(status, stamp).alias(status), F.max(stamp).alias(stamp), F.count(F.lit(1)).alias("events")
    )
