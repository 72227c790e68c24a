"""Cleaning: unique keys, known targets, imputed features."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.errors import require_columns
from changerisk.operators.selection import quantiles
from changerisk.runtime import broadcast_if_small, freeze, is_small


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for floating-point columns."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _present(df: DataFrame, name: str) -> Column:
    return F.when(~is_missing(df, name), F.col(name))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (column_name, missing) per column, from one pass."""
    counts = df.agg(*[F.count_if(is_missing(df, name)).alias(name) for name in columns])
    pairs = F.array(*[F.struct(F.lit(name).alias("column_name"), F.col(name).alias("missing")) for name in columns])
    return counts.select(F.inline(pairs))


def dedupe_by_key(
    df: DataFrame,
    key: str = "commit_id",
    order_by: Sequence[str] = (),
    keep: str | bool = "first",
    prefer: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the first or last by ``order_by``, or, with ``keep=False``, only rows whose
    key is unique.

    Rows equal in ``order_by`` are told apart by known values in ``prefer``, then in the other
    columns, then by the values: a missing value never wins over a known one. Give an order column
    to have the first row of the input kept, as a table has no order of its own.

    Keys that occur once, and winners by ``order_by`` and known values, are found on narrow rows.
    If there are few enough keys with several rows, these are broadcast: other rows stay where
    they are, and only the rows that tie for a key are compared by their values. Else one
    aggregate over whole rows does all, so that rows are shuffled once; copies collapse before the
    shuffle, however many a key has. Both give the same rows.
    """
    require_columns(df, [key, *order_by, *prefer])
    rest = [c for c in df.columns if c != key and c not in order_by]

    def known_first(name: str) -> Column:
        return ~is_missing(df, name) if keep == "last" else is_missing(df, name)

    marks = [known_first(name).alias(f"_m{i}") for i, name in enumerate([*order_by, *prefer, *rest])]
    ordered, others = marks[: len(order_by)], marks[len(order_by) :]
    place = F.struct(*[c for pair in zip(ordered, order_by) for c in pair], *others)
    best = F.max if keep == "last" else F.min

    counted = df.groupBy(F.col(key).alias("_key")).agg(best(place).alias("_best"), F.count("*").alias("_n"))
    shared = freeze(counted.filter("_n > 1").drop("_n"))
    if not keep:
        return df.join(broadcast_if_small(shared.select("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    if not is_small(shared.select("_key", "_best.*")):
        return _winners(df, key, best, place, rest)
    known = F.broadcast(shared)
    alone = df.join(known, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    tied = df.join(known, F.col(key).eqNullSafe(F.col("_key")) & place.eqNullSafe(F.col("_best"))).select(*df.columns)
    return alone.unionByName(_winners(tied, key, best, place, rest))


def _winners(df: DataFrame, key: str, best: Callable[[Column], Column], place: Column, rest: Sequence[str]) -> DataFrame:
    """One row per key: the best by place, then by the values of ``rest``."""
    kept = df.groupBy(key).agg(best(F.struct(place.alias("_place"), *rest)).alias("_row"))

    def value(name: str) -> Column:
        return F.col(f"_row.`{name}`") if name in rest else F.col(f"_row._place.`{name}`")

    return kept.select(*[F.col(c) if c == key else value(c).alias(c) for c in df.columns])


def select_features(df: DataFrame, features: Sequence[str], target: str = "buggy", keep: Sequence[str] = ()) -> DataFrame:
    """The features, the target and columns to ``keep``, in the order given; missing ones raise."""
    wanted = list(dict.fromkeys([*keep, *features, target]))
    require_columns(df, wanted)
    return df.select(*wanted)


def drop_missing_target(df: DataFrame, target: str = "buggy") -> DataFrame:
    """Rows with a known target."""
    return df.filter(~is_missing(df, target))


def fill_values(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str = "median",
    explicit: Mapping[str, Any] | None = None,
) -> tuple[dict[str, Any], dict[str, int]]:
    """Fill value of each column that has nulls, and the null count of every column.

    Explicit values win; else median, mean, mode (smallest of the most frequent) or zero, and
    median for any other strategy. A column without values gets 0.
    """
    counts = {r["column_name"]: r["missing"] for r in missing_counts(df, columns).collect()} if columns else {}
    explicit = dict(explicit or {})
    values = {name: explicit[name] for name in columns if counts[name] and name in explicit}
    open_columns = [name for name in columns if counts[name] and name not in explicit]
    if strategy == "zero":
        found: dict[str, Any] = dict.fromkeys(open_columns, 0)
    elif strategy == "mean" and open_columns:
        found = df.agg(*[F.avg(_present(df, name)).alias(name) for name in open_columns]).first().asDict()
    elif strategy == "mode":
        found = {name: _mode(df, name) for name in open_columns}
    else:
        found = quantiles(df, {name: _present(df, name) for name in open_columns}, 0.5)
    values.update({name: 0 if value is None else value for name, value in found.items()})
    return {name: values[name] for name in columns if name in values}, counts


def _mode(df: DataFrame, name: str) -> Any:
    counted = df.select(_present(df, name).alias("value")).filter("value is not null").groupBy("value").count()
    top = counted.orderBy(F.desc("count"), "value").first()
    return top["value"] if top else None


def impute(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str = "median",
    explicit: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Fill the nulls of the columns; columns without nulls keep their type and values."""
    values, _ = fill_values(df, columns, strategy, explicit)
    return apply_fill(df, values)


def apply_fill(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Replace nulls and NaNs; a whole-number column turns double if its value has a fraction."""
    filled = {}
    for name, value in values.items():
        kind = df.schema[name].dataType
        if isinstance(kind, T.IntegralType) and float(value).is_integer():
            literal = F.lit(int(value)).cast(kind)
        elif isinstance(kind, T.IntegralType):
            literal = F.lit(float(value))
        else:
            literal = F.lit(value).cast(kind)
        filled[name] = F.coalesce(_present(df, name), literal)
    return df.withColumns(filled) if filled else df


def clean_commits(
    df: DataFrame,
    features: Sequence[str] = (),
    *,
    target: str = "buggy",
    key: str = "commit_id",
    order_by: Sequence[str] = (),
    keep: str | bool = "first",
    strategy: str = "median",
    explicit: Mapping[str, Any] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Check columns, keep one row per key, drop unknown targets, impute features.

    Returns the clean table and its report: one row with counts and, per feature, the nulls
    before and after and the value filled in.
    """
    require_columns(df, [key, target, *features])
    spark = df.sparkSession
    unique = dedupe_by_key(df, key, order_by, keep, prefer=[target])
    # The statistics take several passes: over the narrow columns, computed once.
    narrow = freeze(unique.select(target, *[name for name in features if name != target]))
    values, before = fill_values(drop_missing_target(narrow, target), features, strategy, explicit)
    cleaned = apply_fill(drop_missing_target(unique, target), values)

    filled = apply_fill(drop_missing_target(narrow, target), values)
    after = {r["column_name"]: r["missing"] for r in missing_counts(filled, features).collect()} if features else {}
    initial = df.count()
    sizes = narrow.agg(F.count("*").alias("rows"), F.count_if(is_missing(narrow, target)).alias("unknown")).first()
    report = [
        (
            initial,
            initial - sizes["rows"],
            sizes["unknown"],
            before,
            after,
            {name: float(value) for name, value in values.items()},
            sizes["rows"] - sizes["unknown"],
        )
    ]
    schema = (
        "initial_rows bigint, duplicates_removed bigint, rows_removed_missing_target bigint, "
        "missing_before map<string,bigint>, missing_after map<string,bigint>, "
        "imputed_values map<string,double>, final_rows bigint"
    )
    return cleaned, spark.createDataFrame(report, schema)
