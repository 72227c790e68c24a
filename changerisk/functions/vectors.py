"""Column expressions on embeddings held as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.errors import ChangeRiskError


def parse_vector(cell: Column) -> Column:
    """JSON text of numbers to an array of floats; text that does not parse gives null."""
    return F.from_json(cell, "array<float>")


def vector_text(vector: Column) -> Column:
    """Array to JSON text."""
    return F.to_json(vector.cast("array<double>"))


def fold(vector: Column, term) -> Column:
    """Sum of ``term(x)`` over the elements, in double."""
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + term(x.cast("double")))


def vector_norm(vector: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(fold(vector, lambda x: x * x))


def pca_columns(first: int, last: int) -> list[str]:
    """Names of the wide form: pca_1, pca_2, ..."""
    return [f"pca_{i}" for i in range(first, last + 1)]


def expand_embedding(df: DataFrame, vector: str, size: int, names: Sequence[str] | None = None) -> DataFrame:
    """Replace the array by one double column per element; null gives zeros.

    A vector of another length fails the job at the row concerned, so no extra pass is needed.
    """
    if size < 1:
        raise ChangeRiskError("size must be positive")
    names = list(names or pca_columns(1, size))
    filled = F.coalesce(F.col(vector).cast("array<double>"), F.array_repeat(F.lit(0.0), size))
    message = F.concat(F.lit(f"expected {size} elements, got "), F.size(filled).cast("string"))
    checked = F.when(F.size(filled) == size, filled).otherwise(F.raise_error(message).cast("array<double>"))
    rest = [c for c in df.columns if c != vector]
    held = df.select(*rest, checked.alias("_vector"))
    return held.select(*rest, *[F.col("_vector")[i].alias(name) for i, name in enumerate(names)])
