"""Session defaults and the shared scratch area for tables that several jobs reuse."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Runtime re-planning does the sizing: shuffle partitions are merged up to the advisory size, skewed
# join partitions are split, and a side is broadcast only when its measured size is under the limit.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "tenora", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the defaults above; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCK = threading.RLock()  # a build may itself read another shared table
_SHARED: dict[tuple[str, str, str], tuple[str, StructType | None]] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: under the session's checkpoint folder, else under its warehouse folder.

    Both are shared by all executors. One folder per application, so it can be deleted when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/scratch-{spark.conf.get('spark.app.id')}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path at each call, so nothing an earlier frame still reads is ever overwritten."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:16]}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a new scratch table and read it back.

    Later readers get column pruning and pushed filters instead of replaying the plan, and losing an executor costs
    one file read instead of the whole lineage.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_files(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """Folder that ``write(path)`` filled, once per application and source."""
    key = (spark.conf.get("spark.app.id"), name, source)
    with _LOCK:
        if key not in _SHARED:
            path = scratch_path(spark, name)
            write(path)
            _SHARED[key] = (path, None)
        return _SHARED[key][0]


def shared_table(
    spark: SparkSession,
    name: str,
    source: str,
    build: Callable[[], DataFrame],
    partition_by: str | None = None,
    refresh: bool = False,
) -> DataFrame:
    """Store ``build()`` once per application and source, and read it back; ``refresh`` rebuilds it.

    A refresh writes to a new path, so frames from before it stay readable. The same in every mode of deployment.
    """
    key = (spark.conf.get("spark.app.id"), name, source)
    with _LOCK:
        if refresh or key not in _SHARED:
            path = scratch_path(spark, name)
            frame = build()
            (frame.write.partitionBy(partition_by) if partition_by else frame.write).parquet(path)
            _SHARED[key] = (path, spark.read.parquet(path).schema)
        path, schema = _SHARED[key]
    return spark.read.schema(schema).parquet(path)
