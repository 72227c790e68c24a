"""Writing tables, embeddings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.functions.vectors import vector_text

_AS_IT_IS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Plain CSV with a header; quotes inside a field are doubled.

    Texts are written as they are, with the white space at their ends. An empty text is ``""``, a missing
    value nothing at all. Lines end with "\\n"; a lone "\\r" in a text is not quoted for itself.
    """
    df.write.mode(mode).options(**_AS_IT_IS).csv(path)


def write_csv_quoted(df: DataFrame, path: str) -> None:
    """Append CSV with every field quoted and backslash as escape."""
    df.write.mode("append").options(header=True, quoteAll=True, escape="\\").csv(path)


def write_embeddings(df: DataFrame, path: str, column: str = "embedding", mode: str = "errorifexists") -> None:
    """CSV in which the vector is one JSON cell."""
    write_dataset(df.withColumn(column, vector_text(F.col(column))), path, mode)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report as JSON lines; reports have a few rows, so one file."""
    report.coalesce(1).write.mode(mode).json(path)
