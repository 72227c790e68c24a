"""Chronological and random train/test splits, found by counting instead of sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.errors import ChangeRiskError, EmptyInputError, require_columns
from changerisk.fixed_values import SEED, TRAIN_FRACTION
from changerisk.operators.selection import first_rows, md5_number


def _train_rows(df: DataFrame, fraction: float) -> tuple[int, int]:
    if not 0.0 < fraction < 1.0:
        raise ChangeRiskError("the train fraction must lie between 0 and 1")
    rows = df.count()
    if rows == 0:
        raise EmptyInputError("cannot split an empty table")
    return rows, int(rows * fraction)


def chronological_train(df: DataFrame, timestamp: str, key: str, fraction: float = TRAIN_FRACTION) -> Column:
    """Predicate for the train side: the first ``int(n * fraction)`` rows by time, then key.

    Rows without a time come last. The predicate compares with constants, so both sides are
    plain scans that can prune by time.
    """
    require_columns(df, [timestamp, key])
    _, train = _train_rows(df, fraction)
    kind = df.schema[timestamp].dataType.simpleString()
    return first_rows(
        df,
        F.unix_micros(F.col(timestamp).cast("timestamp")),
        [key],
        train,
        column=F.col(timestamp),
        as_value=lambda micros: F.timestamp_micros(micros).cast(kind),
    )


def temporal_split(
    df: DataFrame,
    timestamp: str = "author_date",
    target: str = "buggy",
    key: str = "commit_id",
    fraction: float = TRAIN_FRACTION,
    features: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows in time order; keys and times stay, so results keep their identity."""
    require_columns(df, [timestamp, target, *(features or ())])
    is_train = chronological_train(df, timestamp, key, fraction)
    if features is not None:
        df = df.select(*dict.fromkeys([key, timestamp, target, *features]))
    return df.filter(is_train), df.filter(~is_train)


def with_side(df: DataFrame, is_train: Column) -> DataFrame:
    """Add ``side``: train or test."""
    return df.withColumn("side", F.when(is_train, "train").otherwise("test"))


def split_report(sides: DataFrame, target: str = "buggy", fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Rows per side and label, with the size and share of the side."""
    counts = sides.groupBy("side", target).agg(F.count("*").alias("rows"))
    totals = counts.groupBy("side").agg(F.sum("rows").alias("side_rows"))
    share = F.when(F.col("side") == "train", F.lit(fraction)).otherwise(F.lit(round(1 - fraction, 10)))
    return counts.join(totals, "side").withColumn("ratio", share)


def random_draw(key: str, seed: int = SEED) -> Column:
    """The number by which a random split orders its rows."""
    return md5_number([key], seed)


def random_train(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = SEED, draw: Column | None = None) -> Column:
    """Predicate for the train side of a reproducible random split; test must not be empty.

    ``draw`` is a column that holds ``random_draw`` already, where both sides are read many times.
    """
    rows = df.count()
    train = max(1, int(rows * (1.0 - test_fraction)))
    if train >= rows:
        raise EmptyInputError("the test side is empty; use more rows or a larger test fraction")
    return first_rows(df, random_draw(key, seed) if draw is None else draw, [key], train)


def random_holdout(
    df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = SEED, draw: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of a random split."""
    is_train = random_train(df, key, test_fraction, seed, draw)
    return df.filter(is_train), df.filter(~is_train)
