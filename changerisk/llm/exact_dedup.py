"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after white space is deleted. Three keys are compared, each
only for rows that an earlier one left in doubt:

1. the length of the squeezed text; a length that occurs once settles its row
2. a hash of its first ``PREFIX`` characters, among rows of one length
3. the SHA-256 of all of it, in a second scan, for rows whose (length, prefix) occurs more than once

The first scan leaves three numbers per row. The second must know which rows are in doubt without
moving their texts: the repeated (length, prefix) keys are marked in a bitmap of fixed size
(``MARKS`` bits, 4 MB), which is broadcast. A row that meets a mark of another key is hashed
needlessly and still ends up in a group of one, so the result is exact for any load of the bitmap.

Groups are found by aggregates, so copies collapse before the shuffle; only the join of rows to
their group is skewed by large groups, and adaptive execution splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.llm.common import ASCII_SPACE, text_or_empty
from changerisk.runtime import freeze

#: Characters of the second key.
PREFIX = 128

#: Bits of the bitmap of keys in doubt, in rows of one 4 KB bitmap each.
MARKS = 1 << 25
_ROW = 1 << 15


def squeezed(text: Column) -> Column:
    """A text without its ASCII white space."""
    return F.regexp_replace(text, ASCII_SPACE, "")


def _mark() -> Column:
    return F.pmod(F.xxhash64("size", "prefix"), F.lit(MARKS))


def _is_marked() -> Column:
    """Whether the row's bit is set in the joined ``bitmap``; no bitmap has no bits."""
    place = F.pmod(_mark(), F.lit(_ROW))
    byte = F.expr(f"substring(bitmap, cast(pmod(pmod(xxhash64(size, prefix), {MARKS}), {_ROW}) div 8 as int) + 1, 1)")
    bits = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.coalesce(F.getbit(bits, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """``key, keep_id, group_size, kept`` for every row; with ``digests`` also ``text_sha256``.

    Of equal texts the row with the most code points in the original text stays, then the one with
    the smallest id; null ids come last. A null text is an empty text, and all empty texts are
    equal. Rows that repeat an id and a text share their fate. An empty table gives no rows.
    ``digests`` has the full hash of all rows taken for the caller; rows that the first two keys
    settled take no part in the grouping all the same.
    """
    raw = text_or_empty(text)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), raw.alias("raw")).withColumn("bare", squeezed(F.col("raw")))
    rows = rows.select(
        "id",
        "bare",
        F.length("raw").cast("bigint").alias("points"),
        F.length("bare").cast("bigint").alias("size"),
        F.xxhash64(F.substring("bare", 1, PREFIX)).alias("prefix"),
    )

    facts = freeze(rows.select("size", "prefix"))
    sizes = facts.groupBy("size").agg(F.count("*").alias("n")).filter("n > 1").select("size")
    keys = facts.join(sizes, "size", "left_semi").groupBy("size", "prefix").agg(F.count("*").alias("n")).filter("n > 1")
    marks = keys.select(_mark().alias("mark")).select(
        F.expr(f"mark div {_ROW}").alias("slice"), F.pmod("mark", F.lit(_ROW)).alias("place")
    )
    bitmaps = freeze(marks.groupBy("slice").agg(F.bitmap_construct_agg("place").alias("bitmap")))

    rows = rows.withColumn("slice", F.expr(f"pmod(xxhash64(size, prefix), {MARKS}) div {_ROW}"))
    rows = rows.join(F.broadcast(bitmaps), "slice", "left").withColumn("doubt", _is_marked())
    full = F.sha2(F.col("bare").cast("binary"), 256)
    hashed = rows.select("id", "points", "doubt", (full if digests else F.when(F.col("doubt"), full)).alias("hash"))
    hashed = freeze(hashed)

    doubted = hashed.filter("doubt")
    best = F.min_by("id", F.struct(-F.col("points"), F.col("id").isNull(), F.col("id")))
    groups = doubted.groupBy("hash").agg(F.count("*").alias("group_size"), best.alias("keep_id")).filter("group_size > 1")
    grouped = doubted.join(groups, "hash", "left").select(
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        "hash",
    )
    single = hashed.filter("not doubt").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "hash")
    return grouped.unionAll(single).select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *([F.col("hash").alias("text_sha256")] if digests else []),
    )
