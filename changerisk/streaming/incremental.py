"""Resumable jobs: each run processes what is new, once, and picks up where the last one ended."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.operators.clean import dedupe_by_key
from changerisk.operators.embedding import TextEncoder, embed_text
from changerisk.operators.pca import pca_transform
from changerisk.runtime import freeze, make_path, path_exists, remove_path

_STORE = "spark.sql.streaming.stateStore"
#: Keys are kept in RocksDB. It does not count its rows, which costs a look-up for each key that is
#: written, and a batch writes its changes instead of a snapshot.
_KEYED = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}

# Kinds of the rows of a batch: a key of the output, a key that the state did not hold, a row that came.
_KNOWN, _NEW, _ROW = 0, 1, 2


def file_stream(spark: SparkSession, path: str, schema, pattern: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; ``pattern`` picks files by name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def table_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table as a stream, whether its path is one file or a folder of files.

    Spark takes a plain path for a folder; in braces it is a pattern, which may match either.
    """
    head, name = path.rstrip("/").rpartition("/")[::2]
    return file_stream(spark, (f"{head}/" if "/" in path else "") + f"{{{name}}}", schema, files_per_batch=files_per_batch)


def _prepare(spark: SparkSession, output: str, checkpoint: str, overwrite: bool) -> None:
    """Progress counts only with its output: without one, or to overwrite it, both start afresh."""
    if overwrite:
        remove_path(spark, output)
    if not path_exists(spark, output):
        remove_path(spark, checkpoint)


def run_available(stream: DataFrame, output: str, checkpoint: str, overwrite: bool = False) -> None:
    """Append everything that is available to a Parquet table, exactly once, and stop."""
    _prepare(stream.sparkSession, output, checkpoint, overwrite)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def incremental_pca_transform(
    stream: DataFrame, model: PipelineModel, output: str, checkpoint: str, vector: str = "embedding", overwrite: bool = False
) -> None:
    """Reduce vectors as their files arrive; ``overwrite`` starts over."""
    run_available(pca_transform(stream, model, vector), output, checkpoint, overwrite)


def _written_keys(spark: SparkSession, output: str, key: T.StructField) -> DataFrame:
    """The keys of the output as a stream: what is there when a job starts and it has not read before.

    Files that a repeated batch has replaced meanwhile are skipped: their keys are its own.
    """
    make_path(spark, output)
    schema = T.StructType([T.StructField(key.name, key.dataType)])
    return spark.readStream.schema(schema).option("ignoreMissingFiles", "true").parquet(output)


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, where a batch touches its own keys only."""
    old = {name: spark.conf.get(name, None) for name in _KEYED}
    for name, value in _KEYED.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def incremental_append(
    stream: DataFrame,
    output: str,
    checkpoint: str,
    key: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    order_by: Sequence[str] = (),
    overwrite: bool = False,
) -> list[int]:
    """Append rows whose key is not in the output yet; returns the rows each micro-batch read.

    Each micro-batch keeps the first row of each key by ``order_by`` and then the other columns,
    leaves out keys written before, and writes a folder of its own. Folders are named by the
    streaming query, which a checkpoint stands for, and the number of the batch: a batch that is
    retried replaces its own folder and no other, and a new checkpoint starts new folders. Where
    the output is gone, old progress is ignored; ``overwrite`` removes both first.

    Which keys are known is keyed state of the stream: its keys run through a ``dropDuplicates``
    with a RocksDB store, so a batch looks up its own keys. Of the output, a job reads the keys that
    were written since its last start, each once; a new checkpoint so reads all of them with its
    first batch. Two jobs that append to one output at the same time do not see each other's keys.
    Rows with a null key are one key.
    """
    spark = stream.sparkSession
    _prepare(spark, output, checkpoint, overwrite)
    before = _written_keys(spark, output, stream.schema[key])
    columns = [F.col(f"`{c}`") for c in stream.columns]
    row = F.struct(*columns)
    nothing = F.lit(None).cast(T.StructType(stream.schema.fields))
    name = F.col(f"`{key}`")
    seen = before.select(name.alias("key"), F.lit(_KNOWN).alias("kind"), nothing.alias("row"))
    fresh = before.select(name.alias("key")).union(stream.select(name.alias("key"))).dropDuplicates(["key"])
    fresh = fresh.select("key", F.lit(_NEW).alias("kind"), nothing.alias("row"))
    rows = stream.select(name.alias("key"), F.lit(_ROW).alias("kind"), row.alias("row"))
    started, names = threading.Event(), []

    def write(batch: DataFrame, number: int) -> None:
        started.wait()
        batch = freeze(batch)  # the state is asked once, whatever is computed from the batch
        keys, old = (batch.filter(F.col("kind") == kind).select("key") for kind in (_NEW, _KNOWN))
        keys = keys.join(old, keys["key"].eqNullSafe(old["key"]), "left_anti")
        came = batch.filter(F.col("kind") == _ROW)
        came = came.join(keys, came["key"].eqNullSafe(keys["key"]), "left_semi").select("row.*")
        picked = dedupe_by_key(came, key, order_by)
        result = transform(picked) if transform else picked
        result.write.mode("overwrite").parquet(f"{output}/run={names[0]}/batch={number}")

    with _keyed_state(spark):
        query = (
            seen.union(fresh).union(rows).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        names.append(str(query.id))
        started.set()
        query.awaitTermination()
    return [progress.numInputRows for progress in query.recentProgress]


def incremental_extract(
    stream: DataFrame, output: str, checkpoint: str, key: str = "commit_id", order_by: Sequence[str] = (), overwrite: bool = False
) -> list[int]:
    """Append only commits that have not been extracted; returns the rows each micro-batch read."""
    return incremental_append(stream, output, checkpoint, key, None, order_by, overwrite)


def incremental_embed(
    stream: DataFrame,
    output: str,
    checkpoint: str,
    key: str = "commit_id",
    text: str = "input_text",
    size: int = 768,
    encoder: TextEncoder | None = None,
    overwrite: bool = False,
) -> list[int]:
    """Embed and append only rows that have no vector yet; returns the rows each micro-batch read."""
    embed = lambda rows: embed_text(rows, text, size=size, encoder=encoder)
    return incremental_append(stream, output, checkpoint, key, embed, overwrite=overwrite)
