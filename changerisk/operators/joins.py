"""Joins and set operations on keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.errors import SchemaMismatchError


def merge_on_key(left: DataFrame, right: DataFrame, key: str = "commit_id") -> DataFrame:
    """Inner equi-join."""
    return left.join(right, key, "inner")


def semi_commits(traversed: DataFrame, listed: DataFrame, keys: Sequence[str] = ("project", "commit_id")) -> DataFrame:
    """Traversed rows whose keys are listed; repeated listings collapse before the shuffle."""
    return traversed.join(listed.select(*keys).distinct(), list(keys), "left_semi")


def pending_rows(listed: DataFrame, done: DataFrame, key: str = "commit_id") -> DataFrame:
    """Listed rows that are not done yet."""
    return listed.join(done.select(key).distinct(), key, "left_anti")


def union_datasets(*tables: DataFrame) -> DataFrame:
    """Rows of same-schema tables one after the other; copies stay."""
    first = tables[0]
    for table in tables[1:]:
        if table.columns != first.columns:
            raise SchemaMismatchError(f"expected {first.columns}, got {table.columns}")
        first = first.unionByName(table)
    return first


def distinct_projects(df: DataFrame, column: str = "project") -> DataFrame:
    """Distinct values, sorted."""
    return df.select(column).distinct().orderBy(column)


_EXACT = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS XXX", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def row_digest(columns: Sequence[str]):
    """Fixed-length stand-in for a whole row, so that grouping by it shuffles no long text.

    Times are written to the microsecond, and nulls as such.
    """
    return F.sha2(F.to_json(F.struct(*columns), {**_EXACT, "ignoreNullFields": "false"}), 256)


def duplicate_rows(df: DataFrame, ignore: Sequence[str] = ("embedding",)) -> DataFrame:
    """Number of rows that repeat another row in all columns but the ignored ones."""
    columns = [c for c in df.columns if c not in ignore]
    copies = df.groupBy(row_digest(columns).alias("row")).agg((F.count("*") - 1).alias("extra"))
    return copies.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"))
