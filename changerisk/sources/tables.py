"""Reading commit tables and embeddings, with declared schemas and tolerant date parsing."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.errors import SchemaMismatchError, require_columns
from changerisk.fixed_values import COMMIT_COLUMNS, REQUIRED_COLUMNS
from changerisk.functions.vectors import parse_vector
from changerisk.runtime import path_exists
from changerisk.sources.quoted_csv import read_quoted_csv

# Magnitudes above which an epoch value is read as nanoseconds or milliseconds.
_NANOS_ABOVE, _MILLIS_ABOVE = 10**15, 10**12


def epoch_timestamp(value: Column, unit: str) -> Column:
    """Epoch number in seconds, milliseconds or nanoseconds to a timestamp (microsecond grain)."""
    micros = {"s": Decimal("1000000"), "ms": Decimal("1000"), "ns": Decimal("0.001")}[unit]
    return F.timestamp_micros(F.floor(value.cast("decimal(27,6)") * F.lit(micros)).cast("bigint"))


def parse_dates(df: DataFrame, columns: Sequence[str] = ("author_date",)) -> DataFrame:
    """Turn text or number columns into timestamps; one pass decides for all of them.

    A column of which at least a tenth (and one value) is numeric holds epoch values, the unit
    following from the largest magnitude; anything else is read as date text. Values that fit
    neither become null.
    """
    pending = [
        name
        for name in columns
        if name in df.columns and not isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType))
    ]
    if pending:
        casts = {name: F.expr(f"try_cast(`{name}` AS double)") for name in pending}
        numbers = {name: F.when(F.abs(x) < float("inf"), x) for name, x in casts.items()}  # no NaN, no infinity
        facts = df.agg(
            F.count("*").alias("rows"),
            *[F.count(number).alias(f"n_{name}") for name, number in numbers.items()],
            *[F.max(F.abs(number)).alias(f"max_{name}") for name, number in numbers.items()],
        ).first()
        for name in pending:
            if facts[f"n_{name}"] >= max(1, int(facts["rows"] * 0.1)):
                largest = int(facts[f"max_{name}"])
                unit = "ns" if largest > _NANOS_ABOVE else "ms" if largest > _MILLIS_ABOVE else "s"
                exact = F.expr(f"try_cast(`{name}` AS decimal(27,6))")
                df = df.withColumn(name, epoch_timestamp(exact, unit))
            else:
                df = df.withColumn(name, F.try_to_timestamp(F.col(name).cast("string")))
    for name in columns:
        if name in df.columns and isinstance(df.schema[name].dataType, T.TimestampNTZType):
            df = df.withColumn(name, F.col(name).cast("timestamp"))
    return df


def load_commits(
    spark: SparkSession,
    path: str,
    *,
    source_format: str = "csv",
    schema: T.StructType | str | None = None,
    required: Sequence[str] = REQUIRED_COLUMNS,
    date_columns: Sequence[str] = ("author_date",),
    rows: int | None = None,
    rename: dict[str, Column] | None = None,
    empty_texts: bool = False,
) -> DataFrame:
    """Read a commit table, check its columns and parse its dates.

    Parquet is the format to keep tables in. CSV cells hold line breaks; such files are read by as
    many tasks as they have splits (``quoted_csv``). Text formats need a ``schema`` (or are read as
    strings by header name). ``rename`` derives columns from others before the check; ``rows`` keeps only that many
    rows, whichever are read first, for a look at a table. ``empty_texts`` tells quoted empty cells of a CSV, as
    ``write_dataset`` writes empty texts, from missing ones.
    """
    if source_format == "csv":
        df = read_quoted_csv(spark, path, schema, empty_texts)
    else:
        reader = spark.read.format(source_format)
        df = (reader if schema is None else reader.schema(schema)).load(path)
    if rename:
        df = df.withColumns(rename)
    require_columns(df, required)
    if rows is not None:
        df = df.limit(rows)
    return parse_dates(df, date_columns)


def load_optional(spark: SparkSession, path: str, **options) -> DataFrame | None:
    """``load_commits`` if the path exists, else None."""
    return load_commits(spark, path, **options) if path_exists(spark, path) else None


def validate_schema(df: DataFrame, expected: Sequence[str] = COMMIT_COLUMNS) -> DataFrame:
    """Pass the table through if its ordered column list equals the expected one."""
    if tuple(df.columns) != tuple(expected):
        raise SchemaMismatchError(f"expected {list(expected)}, got {df.columns}")
    return df


def read_embeddings(
    spark: SparkSession, path: str, *, schema: str, column: str = "embedding", rows: int | None = None
) -> DataFrame:
    """Read a CSV table whose ``column`` holds JSON arrays, as arrays of floats."""
    df = read_quoted_csv(spark, path, schema)
    if rows is not None:
        df = df.limit(rows)
    return df.withColumn(column, parse_vector(F.col(column)))
