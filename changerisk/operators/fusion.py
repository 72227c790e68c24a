"""Feature sources side by side: encoding of reasoning attributes and fusion by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.errors import require_columns
from changerisk.fixed_values import REASONING_VOCABULARY, RISK_LEVELS


def ordinal(column: Column, levels: Sequence[str]) -> Column:
    """0-based rank of a level; null for anything else."""
    value = F.lower(F.trim(column))
    return reduce(lambda chain, i: chain.when(value == levels[i], F.lit(i)), range(1, len(levels)), F.when(value == levels[0], F.lit(0)))


def one_hot(df: DataFrame, name: str, vocabulary: Sequence[str]) -> dict[str, Column]:
    """0/1 columns ``name_value`` over a fixed vocabulary; unknown values give zeros."""
    value = F.lower(F.trim(F.col(name)))
    return {f"{name}_{word}": F.coalesce((value == word.lower()).cast("int"), F.lit(0)) for word in vocabulary}


def encode_reasoning(
    df: DataFrame,
    key: str = "commit_id",
    vocabulary: Mapping[str, Sequence[str]] = REASONING_VOCABULARY,
    risk: str = "risk_level",
    risk_levels: Sequence[str] = RISK_LEVELS,
    confidence: str = "confidence_score",
) -> DataFrame:
    """Ordinal risk, one-hot columns for the other attributes, confidence clipped to [0, 1].

    The vocabulary is fixed, so encoding needs no pass over the data and never changes width.
    """
    require_columns(df, [key, risk, confidence, *vocabulary])
    columns = {risk: ordinal(F.col(risk), risk_levels)}
    for name, words in vocabulary.items():
        columns |= one_hot(df, name, words)
    score = F.col(confidence).cast("double")
    columns[confidence] = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return df.select(key, *[column.alias(name) for name, column in columns.items()])


def fuse_features(sources: Sequence[DataFrame], key: str = "commit_id") -> DataFrame:
    """Rows present in every source, with the columns of all; Spark picks the joins by measured sizes."""
    return reduce(lambda left, right: left.join(right, key), sources)
