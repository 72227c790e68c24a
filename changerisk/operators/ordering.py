"""Order-dependent building blocks that never put one hot key, or the whole table, in one task.

``with_position``   exact 0-based position of each row in a global order
``running_sums``    inclusive running sums along a global order
``prior_in_key``    as-of totals per key, computed block by block and carried over
``newest_per_group``top n of each group through salted partial tops
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changerisk.runtime import freeze

# Rows one task sorts in a blocked window.
BLOCK_ROWS = 2_000_000

# Hash buckets in which rows are counted to find the keys that may have more rows than a block.
_BUCKETS = 1 << 16

# monotonically_increasing_id keeps the row number of a partition in its low 33 bits.
_ROW_BITS = 33


def _slots(df: DataFrame, order_by: Sequence[Column]) -> DataFrame:
    """Sort by range partitions, freeze, and number the rows inside each partition."""
    ordered = freeze(df.orderBy(*order_by))
    row = F.monotonically_increasing_id()
    return ordered.withColumn("_row", row).withColumn("_slot", F.shiftright("_row", _ROW_BITS).cast("int"))


def _lookup(values: Mapping[int, float], kind: str) -> Column:
    """Per-partition offsets as one constant array, indexed by partition number."""
    dense = [values.get(slot, 0) for slot in range(max(values, default=0) + 1)]
    return F.from_json(F.lit(json.dumps(dense)), f"array<{kind}>")[F.col("_slot")]


def _offsets(per_slot: Mapping[int, float]) -> tuple[dict[int, float], float]:
    offsets, total = {}, 0
    for slot in sorted(per_slot):
        offsets[slot] = total
        total += per_slot[slot]
    return offsets, total


def with_position(df: DataFrame, order_by: Sequence[Column], name: str = "pos") -> tuple[DataFrame, int]:
    """Add the position of each row in the order given; also return the row count.

    The driver sees one number per shuffle partition. ``order_by`` should end in a unique
    column, so that range partitions stay even and the positions are reproducible.
    """
    slots = _slots(df, order_by)
    sizes = {r["_slot"]: r["n"] for r in slots.groupBy("_slot").agg(F.count("*").alias("n")).collect()}
    offsets, total = _offsets(sizes)
    local = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return slots.withColumn(name, _lookup(offsets, "bigint") + local).drop("_row", "_slot"), total


def running_sums(df: DataFrame, order_by: Sequence[Column], sums: Mapping[str, str]) -> DataFrame:
    """Add ``{new column: summed bigint column}`` running sums, own row included."""
    slots = _slots(df, order_by)
    totals = slots.groupBy("_slot").agg(*[F.sum(source).alias(name) for name, source in sums.items()]).collect()
    inside = Window.partitionBy("_slot").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    for name, source in sums.items():
        offsets, _ = _offsets({r["_slot"]: r[name] for r in totals})
        slots = slots.withColumn(name, F.sum(source).over(inside) + _lookup(offsets, "bigint"))
    return slots.drop("_row", "_slot")


def crowded_buckets(rows: DataFrame, keys: Sequence[str], span: int, block_rows: int = BLOCK_ROWS) -> list[int]:
    """Hash buckets of keys with more than ``block_rows`` rows; a key outside of them has no more.

    ``rows`` are read once and should be frozen.
    """
    if span <= block_rows:
        return []
    counts = rows.groupBy(_bucket(keys).alias("bucket")).count()
    return [r["bucket"] for r in counts.filter(F.col("count") > block_rows).collect()]


def parted(rows: DataFrame, keys: Sequence[str], crowded: Sequence[int]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keys outside of the crowded buckets, and those inside, if there are such buckets."""
    if not crowded:
        return rows, None
    inside = _bucket(keys).isin(list(crowded))
    return rows.filter(~inside), rows.filter(inside)


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS)).cast("int")


def prior_in_key(
    rows: DataFrame,
    keys: Sequence[str],
    count: str,
    last: str | None = None,
    *,
    span: int,
    position: str = "pos",
    block_rows: int = BLOCK_ROWS,
    crowded: Sequence[int] | None = None,
) -> DataFrame:
    """Per row: sum of ``count`` and latest non-null ``last`` over earlier rows of the same key.

    Adds ``prior_count`` and, with ``last``, ``prior_last``. Positions lie in ``[0, span)``; rows
    of one position do not see each other. A key is cut at fixed positions, so no task gets more
    than ``block_rows`` of its positions; each block's totals are carried to the later blocks.
    With ``crowded_buckets`` given, only the keys in them are cut.
    """
    keys = list(keys)
    if crowded is not None:
        whole, cut = parted(rows, keys, crowded)
        whole = prior_in_key(whole, keys, count, last, span=0, position=position, block_rows=block_rows)
        if cut is None:
            return whole
        return whole.unionByName(prior_in_key(cut, keys, count, last, span=span, position=position, block_rows=block_rows))
    measures = {"prior_count": F.sum(count)}
    if last:
        measures["prior_last"] = F.last(last, ignorenulls=True)
    before = (Window.unboundedPreceding, -1)
    if span <= block_rows:
        window = Window.partitionBy(*keys).orderBy(position).rangeBetween(*before)
        for name, measure in measures.items():
            rows = rows.withColumn(name, measure.over(window))
        return rows.withColumn("prior_count", F.coalesce("prior_count", F.lit(0)))

    rows = rows.withColumn("_block", F.floor(F.col(position) / block_rows))
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rangeBetween(*before)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*before)
    block_totals = [F.sum(count).alias("_count")]
    if last:
        block_totals.append(F.max_by(last, F.when(F.col(last).isNotNull(), F.col(position))).alias("_last"))
    carried = rows.groupBy(*keys, "_block").agg(*block_totals)
    carried = carried.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_count").over(across), F.lit(0)).alias("_carried_count"),
        *([F.last("_last", ignorenulls=True).over(across).alias("_carried_last")] if last else []),
    )
    for name, measure in measures.items():
        rows = rows.withColumn(name, measure.over(inside))
    rows = rows.join(carried, [*keys, "_block"])
    rows = rows.withColumn("prior_count", F.coalesce("prior_count", F.lit(0)) + F.col("_carried_count"))
    if last:
        rows = rows.withColumn("prior_last", F.coalesce("prior_last", "_carried_last"))
    return rows.drop("_block", "_carried_count", "_carried_last")


def newest_per_group(
    df: DataFrame, groups: Sequence[str], order_by: Sequence[Column], n: int, spread_by: Sequence[str]
) -> DataFrame:
    """First ``n`` rows of each group in the order given.

    A group is first split by a hash of ``spread_by`` over all shuffle partitions; the first
    ``n`` of the parts contain the first ``n`` of the whole, so the second step sees at most
    ``n`` rows per part.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*spread_by), F.lit(parts)))
    for keys in ([*groups, "_part"], list(groups)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
        salted = salted.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return salted.drop("_part")
