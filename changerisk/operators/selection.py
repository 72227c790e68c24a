"""Exact order statistics without sorting the table: histograms that zoom in on the wanted rank."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changerisk.operators.ordering import with_position

# Histogram resolution of one zoom step, and rows of a bin that are read instead of zoomed in on.
_BINS = 65_536
_READ_ROWS = 65_536


@dataclass
class RankedValue:
    """Value at a rank, with the number of rows below it and equal to it."""

    value: float
    below: int
    equal: int


def _bin(value: Column, low: float, high: float, exact: bool, near: bool = False) -> Column:
    if high <= low:
        return F.lit(0).cast("bigint")
    if exact and near:  # no difference of two values overflows
        return F.call_function("div", value - F.lit(low).cast("bigint"), F.lit((high - low) // _BINS + 1).cast("bigint"))
    if exact:  # whole numbers, also where a double would round them and a difference would overflow
        step = (high - low) // _BINS + 1
        wide = value.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
        return F.floor(wide / F.lit(step).cast("decimal(20,0)")).cast("bigint")
    share = (value - F.lit(low)) / F.lit(high - low)
    return F.least(F.floor(share * _BINS), F.lit(_BINS - 1))


def ranked_values(
    df: DataFrame,
    wanted: Mapping[str, tuple[Column, int]],
    ranges: Mapping[str, tuple[float, float]],
    exact: bool = False,
) -> dict[str, RankedValue]:
    """The values at 0-based ranks of numeric columns, nulls ignored; ``exact`` for whole numbers.

    ``wanted`` maps a name to (column, rank) and ``ranges`` to that column's min and max. Each
    pass scans the columns once, counts rows per bin inside the current ranges, and narrows
    every range to the bin holding the rank. A pass divides a range by 65,536 and ends for a
    name when its bin holds one value, or few rows, whose values are counted one by one; ties
    cost nothing and the shuffle stays small.
    """
    kind = "bigint" if exact else "double"
    number = int if exact else float
    state = {name: [*map(number, ranges[name]), rank, 0, False] for name, (_, rank) in wanted.items()}
    near = {name: float(high) - float(low) < 2**62 for name, (low, high) in ranges.items()}
    found: dict[str, RankedValue] = {}
    while state:
        names = list(state)
        entries = []
        for index, name in enumerate(names):
            value = wanted[name][0].cast(kind)
            low, high, _, _, few = state[name]
            place = value if few else _bin(value, low, high, exact, near[name])
            entry = F.struct(F.lit(index).alias("name"), place.cast(kind).alias("bin"), value.alias("value"))
            low, high = F.lit(low).cast(kind), F.lit(high).cast(kind)
            entries.append(F.when(value.between(low, high), entry))
        rows = df.select(F.explode(F.array(*entries)).alias("e")).filter("e is not null").select("e.*")
        bins = rows.groupBy("name", "bin").agg(
            F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        upto = F.sum("n").over(Window.partitionBy("name").orderBy("bin"))
        rank = F.from_json(F.lit(json.dumps([state[name][2] for name in names])), "array<bigint>")[F.col("name")]
        hit = bins.withColumn("upto", upto).filter((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
        for row in hit.collect():  # one row per name
            name = names[row["name"]]
            _, _, rank_left, below, _ = state.pop(name)
            skipped = row["upto"] - row["n"]
            if row["low"] == row["high"]:
                found[name] = RankedValue(row["low"], below + skipped, row["n"])
            else:
                state[name] = [row["low"], row["high"], rank_left - skipped, below + skipped, row["n"] <= _READ_ROWS]
    return found


def quantiles(df: DataFrame, columns: Mapping[str, Column], probability: float) -> dict[str, float | None]:
    """Exact quantile per column, interpolated between neighbours; None for all-null columns."""
    if not columns:
        return {}
    facts = df.agg(
        *[
            measure(column).alias(f"{label}_{name}")
            for name, column in columns.items()
            for label, measure in (("n", F.count), ("low", F.min), ("high", F.max))
        ]
    ).first()
    wanted, ranges, weight = {}, {}, {}
    for name, column in columns.items():
        n = facts[f"n_{name}"]
        if n:
            exact = probability * (n - 1)
            floor = int(exact)
            weight[name] = exact - floor
            for side, rank in (("a", floor), ("b", min(floor + 1, n - 1))):
                wanted[f"{side}:{name}"] = (column, rank)
                ranges[f"{side}:{name}"] = (facts[f"low_{name}"], facts[f"high_{name}"])
    values = ranked_values(df, wanted, ranges)
    return {
        name: values[f"a:{name}"].value * (1 - weight[name]) + values[f"b:{name}"].value * weight[name]
        if name in weight
        else None
        for name in columns
    }


def text_at(df: DataFrame, name: str, rank: int) -> str | None:
    """The text at a 0-based rank of a string column in byte order, nulls ignored; None past the end.

    Passes count rows per prefix, one character longer each time, and go on with the prefix that
    holds the rank; only when few rows are left are they sorted.
    """
    rows = df.select(F.col(name).alias("text")).filter("text is not null")
    length, left = 0, rank
    while True:
        length += 1
        found = rows.groupBy(F.substring("text", 1, length).alias("prefix")).agg(F.count("*").alias("n"), F.max("text").alias("high"))
        upto = F.sum("n").over(Window.orderBy("prefix"))  # one row for each next character
        hit = found.withColumn("upto", upto).filter(F.col("upto") > left).orderBy("upto").first()
        if hit is None:
            return None
        left -= hit["upto"] - hit["n"]
        rows = rows.filter(F.substring("text", 1, length) == hit["prefix"])
        if hit["high"] == hit["prefix"]:  # all of them are this one text
            return hit["prefix"]
        if hit["n"] <= _READ_ROWS:
            return rows.orderBy("text").offset(left).first()["text"]


def _at_most(columns: Sequence[Column], values: Sequence[object]) -> Column:
    """Lexicographic ``columns <= values``."""
    result = F.lit(True)
    for column, value in reversed(list(zip(columns, values))):
        result = (column < F.lit(value)) | ((column == F.lit(value)) & result)
    return result


def first_rows(
    df: DataFrame,
    number: Column,
    ties: Sequence[str],
    k: int,
    column: Column | None = None,
    as_value: Callable[[Column], Column] = lambda number: number,
) -> Column:
    """Predicate that holds for the first ``k`` rows by ``number`` (nulls last), then ``ties``.

    Finding the boundary costs counting passes over these columns only; the predicate itself is
    a comparison with constants, so the caller needs no sort and no shuffle. ``number`` must be
    a whole number below 2**53; ``ties`` must tell the rows apart (copies stay together). If
    ``number`` is derived from a ``column``, ``as_value`` maps it back, so that the predicate is
    on the column itself and reaches the scan.
    """
    if k <= 0:
        return F.lit(False)
    column = number if column is None else column
    facts = df.agg(F.count(number).alias("n"), F.min(number).alias("low"), F.max(number).alias("high")).first()
    if k > facts["n"]:
        at, tied, below = facts["n"], column.isNull(), column.isNotNull()
    else:
        hit = ranked_values(df, {"k": (number, k - 1)}, {"k": (facts["low"], facts["high"])}, exact=True)["k"]
        at, edge = hit.below, as_value(F.lit(int(hit.value)))
        if hit.below + hit.equal == k:
            return F.coalesce(column <= edge, F.lit(False))
        tied, below = column == edge, column < edge
    rest = df.filter(tied).select(*ties)
    columns = [F.col(name) for name in ties]
    last = with_position(rest, columns)[0].filter(F.col("pos") == k - at - 1).first()
    if last is None:
        return F.coalesce(below, F.lit(False))
    return F.coalesce(below | (tied & _at_most(columns, [last[name] for name in ties])), F.lit(False))


def md5_key(columns: Sequence[str], seed: int) -> Column:
    """Reproducible pseudo-random text per row, equal on every engine that has md5."""
    return F.md5(F.concat_ws(":", *[F.col(name).cast("string") for name in columns], F.lit(str(seed))))


def md5_number(columns: Sequence[str], seed: int, digits: int = 13) -> Column:
    """The leading hex digits of ``md5_key`` as a number; 13 digits stay below 2**53."""
    return F.conv(F.substring(md5_key(columns, seed), 1, digits), 16, 10).cast("bigint")
