"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_LONGS = {"la", "ld", "nf", "nd", "ns", "aexp"}
_DOUBLES = {"ent", "ndev", "age", "nuc", "arexp", "asexp"}


def commit_schema(raw_dates: bool = False) -> T.StructType:
    """Commit table; ``raw_dates`` leaves ``author_date`` as text for the date parser."""
    from changerisk.fixed_values import COMMIT_COLUMNS

    def kind(name: str) -> T.DataType:
        if name in _LONGS:
            return T.LongType()
        if name in _DOUBLES:
            return T.DoubleType()
        if name in ("buggy", "fix", "year"):
            return T.IntegerType()
        if name == "author_date":
            return T.StringType() if raw_dates else T.TimestampType()
        return T.StringType()

    return T.StructType([T.StructField(name, kind(name)) for name in COMMIT_COLUMNS])


FILE_CHANGES = (
    "project string, commit_id string, ordinal int, old_path string, new_path string, "
    "added_lines bigint, deleted_lines bigint, patch string, source_code string"
)
