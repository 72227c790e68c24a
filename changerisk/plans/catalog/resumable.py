"""Incremental jobs; each must end with the same rows as one batch run."""

from pyspark.sql import functions as F

from changerisk.functions.vectors import vector_norm
from changerisk.plans.catalog.reduction import _LENGTHS, _TOKENS, PLACES, counted, full_model
from changerisk.plans.catalog.registry import query
from changerisk.runtime import scratch_path
from changerisk.streaming import incremental


def stream(t, name):
    return incremental.table_stream(t.spark, t.path(name), getattr(t, name).schema)


@query("incremental_pca_transform", _LENGTHS)
def incremental_pca_transform(t):
    output, progress = scratch_path(t.spark, "reduced"), scratch_path(t.spark, "progress")
    model = full_model(t)
    for _ in range(2):  # the second run finds nothing new
        incremental.incremental_pca_transform(stream(t, "embeddings"), model, output, progress)
    return t.spark.read.parquet(output).select("vec_id", F.round(vector_norm(F.col("embedding")), 4).alias("length"))


def shares(t, table, column):
    """Streams over a table in two folders, rows by parity of a column."""
    paths = []
    for part in (0, 1):
        path = scratch_path(t.spark, f"share-{part}")
        table.filter(F.col(column) % 2 == part).write.parquet(path)
        paths.append(incremental.file_stream(t.spark, path, table.schema))
    return paths


@query("incremental_extract", """
    SELECT DISTINCT ON (l_orderkey) l_orderkey AS commit_id, l_partkey, l_suppkey, l_linenumber, l_quantity
    FROM lineitem ORDER BY l_orderkey, l_suppkey % 2, l_linenumber, l_partkey, l_suppkey, l_quantity""")
def incremental_extract(t):
    output, progress = scratch_path(t.spark, "extracted"), scratch_path(t.spark, "progress")
    columns = [F.col("l_orderkey").alias("commit_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    first, second = (part.select(*columns) for part in shares(t, t.lineitem, "l_suppkey"))
    incremental.incremental_extract(first, output, progress, order_by=["l_linenumber"])
    # A second job, with progress of its own, brings new commits and others that are known.
    incremental.incremental_extract(second, output, scratch_path(t.spark, "progress"), order_by=["l_linenumber"])
    return t.spark.read.parquet(output).drop("run", "batch")


@query("incremental_embed", _TOKENS)
def incremental_embed(t):
    output = scratch_path(t.spark, "embedded")
    for part in shares(t, t.documents.select("doc_id", "text"), "doc_id"):
        incremental.incremental_embed(part, output, scratch_path(t.spark, "progress"), "doc_id", "text", size=PLACES)
    return counted(t.spark.read.parquet(output))
