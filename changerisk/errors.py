"""Errors raised before a job starts, so that a bad call never costs a cluster run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


class ChangeRiskError(Exception):
    """Base of all errors of this package."""


class MissingColumnsError(ChangeRiskError):
    """Columns a function needs are absent; ``missing`` lists them."""

    def __init__(self, missing: Iterable[str]) -> None:
        self.missing = list(missing)
        super().__init__("missing columns: " + ", ".join(self.missing))


class SchemaMismatchError(ChangeRiskError):
    """The ordered column list differs from the one expected."""


class EmptyInputError(ChangeRiskError):
    """An operation that needs rows got none."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise ``MissingColumnsError`` unless every column is present."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise MissingColumnsError(missing)
