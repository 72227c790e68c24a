"""Session helpers: time zone, shared scratch space, frozen results, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def use_utc(spark: SparkSession) -> SparkSession:
    """All timestamps of the data model are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``, which all executors must share.

    A local master without the setting gets a folder of its own, as there the driver is the only
    executor; any other master must have it set.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, for tables written between steps."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; survives lost executors and fixes the partitioning."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _width(frozen: DataFrame):
    """Bytes of a row: 16 per column, and the length of texts and binaries."""
    width = F.lit(16 * len(frozen.columns))
    for field in frozen.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
    return width


def is_small(frozen: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a frozen table has few enough rows and bytes to be broadcast."""
    size = frozen.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(_width(frozen)), F.lit(0))).first()
    return size[0] <= max_rows and size[1] <= max_bytes


def broadcast_if_small(frozen: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a frozen table of few rows and bytes; a shuffle join otherwise."""
    return F.broadcast(frozen) if is_small(frozen, max_rows, max_bytes) else frozen


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system its scheme names."""
    file_system, jvm_path = _file_system(spark, path)
    return file_system.exists(jvm_path)


def make_path(spark: SparkSession, path: str) -> None:
    """Make a folder, if it does not exist."""
    file_system, jvm_path = _file_system(spark, path)
    file_system.mkdirs(jvm_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it exists."""
    file_system, jvm_path = _file_system(spark, path)
    file_system.delete(jvm_path, True)
