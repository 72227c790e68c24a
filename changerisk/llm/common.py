"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changerisk.errors import require_columns

#: The six characters that count as white space where a contract names them (fixed value).
ASCII_SPACE = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from wherever the folder is."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def table_or_empty(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table with the columns of ``schema`` only, cast to its types."""
    table = read_table(spark, folder, name)
    return only(table, schema)


def only(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a DDL ``schema``, cast to its types; all other columns go, whatever their names."""
    wanted = [part.strip().split(" ", 1) for part in schema.split(",")]
    require_columns(df, [name for name, _ in wanted])
    return df.select(*[F.col(f"`{name}`").cast(kind.strip()).alias(name) for name, kind in wanted])


def text_or_empty(name: str = "text") -> Column:
    """A text column with nulls as empty texts."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def share_file(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a small local file (a vocabulary, 1 to 2 MB) as a broadcast, so that executors need not have it."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def texts_of(column: Iterable) -> list[str]:
    """Python texts of an Arrow column, nulls as empty texts."""
    return [text or "" for text in column.to_pylist()]
