"""Profiles of a table: sizes, types, nulls, text lengths, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.fixed_values import HISTOGRAM_BINS
from changerisk.operators.clean import is_missing, missing_counts
from changerisk.operators.joins import duplicate_rows


def label_distribution(df: DataFrame, label: str = "buggy") -> DataFrame:
    """Rows per label value, nulls included."""
    return df.groupBy(label).agg(F.count("*").alias("count"))


def _facts(df: DataFrame, rows: list[tuple[str, str, Column]]) -> DataFrame:
    """One aggregate pass, laid out as (section, name, value) rows."""
    wide = df.agg(*[value.cast("double").alias(f"v{i}") for i, (_, _, value) in enumerate(rows)])
    long = [
        F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), F.col(f"v{i}").alias("value"))
        for i, (section, name, _) in enumerate(rows)
    ]
    return wide.select(F.inline(F.array(*long)))


def dataset_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, columns per type, and nulls of the columns that have any."""
    rows: list[tuple[str, str, Column]] = [
        ("size", "rows", F.count("*")),
        ("size", "columns", F.lit(len(df.columns))),
    ]
    kinds = [kind for _, kind in df.dtypes]
    rows += [("type", kind, F.lit(kinds.count(kind))) for kind in dict.fromkeys(kinds)]
    rows += [("missing", name, F.count_if(is_missing(df, name))) for name in df.columns]
    return _facts(df, rows).filter("section != 'missing' or value > 0")


def text_columns(df: DataFrame) -> list[str]:
    """String columns, without embeddings kept as text."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != "embedding"]


def _length(name: str) -> Column:
    return F.length(F.coalesce(F.col(name), F.lit("")))


def text_length_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, longest and shortest text per string column, null counting as empty."""
    names = list(columns or text_columns(df))
    wide = df.agg(
        *[
            measure(_length(name)).alias(f"{label}_{i}")
            for i, name in enumerate(names)
            for label, measure in (("mean", F.avg), ("max", F.max), ("min", F.min))
        ]
    )
    long = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.col(f"mean_{i}").alias("mean_length"),
            F.col(f"max_{i}").alias("max_length"),
            F.col(f"min_{i}").alias("min_length"),
        )
        for i, name in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*long)))


def histogram(df: DataFrame, value: Column, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between min and max, the last one closed; empty bins included."""
    values = df.select(value.cast("double").alias("v")).filter("v is not null")
    edge = values.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    if edge["low"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count bigint")
    low, high = edge["low"], edge["high"]
    if low == high:
        low, high = low - 0.5, high + 0.5
    number = F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(number.alias("bin")).agg(F.count("*").alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return (
        grid.join(counts, "bin", "left")
        .select(
            "bin",
            (F.lit(low) + F.col("bin") * width).alias("low"),
            (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def text_length_histograms(df: DataFrame, columns: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Length histograms of all string columns, or of those named."""
    names = list(columns or text_columns(df))
    parts = [histogram(df, _length(name), bins).withColumn("column_name", F.lit(name)) for name in names]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def summary_report(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Shape, embedding summary, nulls, duplicates and text lengths as (section, name, value)."""
    from changerisk.operators.vectors import embedding_summary

    def long(one_row: DataFrame, section: str) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in one_row.columns]
        return one_row.select(F.lit(section).alias("section"), F.inline(F.array(*pairs)))

    size = df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))
    quality = missing_counts(df, df.columns).agg(F.sum("missing").alias("missing_values"))
    parts = [long(size, "shape"), long(quality, "quality"), long(duplicate_rows(df, [vector]), "quality")]
    if vector in df.columns:
        parts.append(long(embedding_summary(df, vector), "embedding"))
    lengths = text_length_stats(df) if text_columns(df) else None
    if lengths is not None:
        triple = F.array(
            *[
                F.struct(F.concat("column_name", F.lit("." + c)).alias("name"), F.col(c).cast("double").alias("value"))
                for c in ("mean_length", "max_length", "min_length")
            ]
        )
        parts.append(lengths.select(F.lit("text").alias("section"), F.inline(triple)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
