"""Year filter, exact stratified samples and frozen subsets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.errors import EmptyInputError, require_columns
from changerisk.fixed_values import FIRST_YEAR, LAST_YEAR, SAMPLE_ROWS, SEED
from changerisk.operators.ordering import with_position
from changerisk.operators.selection import first_rows, md5_key, md5_number, text_at
from changerisk.runtime import broadcast_if_small, freeze

# A stratum is cut into this many hash buckets, given by four hex digits.
_BUCKET_DIGITS = 4


def filter_years(df: DataFrame, timestamp: str = "author_date", first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """Rows of the years ``first`` to ``last`` in UTC; written as a range, so that scans can prune."""
    require_columns(df, [timestamp])
    kind = df.schema[timestamp].dataType

    def start(year: int) -> Column:
        moment = dt.datetime(year, 1, 1)
        if isinstance(kind, T.TimestampType):  # an instant, whatever the session's time zone
            return F.timestamp_seconds(F.lit(int(moment.replace(tzinfo=dt.timezone.utc).timestamp())))
        return F.lit(moment.isoformat(" ")).cast(kind)

    return df.filter((F.col(timestamp) >= start(first)) & (F.col(timestamp) < start(last + 1)))


def stratum_counts(df: DataFrame, groups: Sequence[str] = ("project", "buggy")) -> DataFrame:
    """Rows per stratum, sorted; rows with a null group value belong to none."""
    require_columns(df, groups)
    return df.dropna(subset=list(groups)).groupBy(*groups).agg(F.count("*").alias("count")).orderBy(*groups)


def _quota(count: Column, total: int, target_rows: int) -> Column:
    return F.greatest(F.rint(count / F.lit(float(total)) * target_rows), F.lit(1.0)).cast("bigint")


def stratum_targets(df: DataFrame, groups: Sequence[str] = ("project", "buggy"), target_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows to draw per stratum: its share of the target, rounded half to even, at least one.

    Rows with a null group value count in the total.
    """
    total = df.count()
    if total == 0:
        raise EmptyInputError("cannot sample from an empty table")
    return stratum_counts(df, groups).withColumn("target_count", _quota(F.col("count"), total, target_rows))


def stratified_sample(
    df: DataFrame,
    key: str = "commit_id",
    groups: Sequence[str] = ("project", "buggy"),
    target_rows: int = SAMPLE_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """Exactly min(target, available) rows of each stratum, those with the lowest seeded hash.

    Rows are counted per stratum and hash bucket; that gives each stratum the bucket its sample
    ends in. All rows of the buckets before are taken, and only inside the last bucket, a
    65,536th of the stratum, are rows ranked. The table itself is filtered, never sorted.
    ``key`` must be unique.
    """
    require_columns(df, [key, *groups])
    total = df.count()
    if total == 0:
        raise EmptyInputError("cannot sample from an empty table")
    groups = list(groups)
    bucket = md5_number([key], seed, _BUCKET_DIGITS).cast("int")
    sizes = df.dropna(subset=groups).groupBy(*groups, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    stratum = Window.partitionBy(*groups)
    before = stratum.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = _quota(F.sum("_n").over(stratum), total, target_rows) - F.coalesce(F.sum("_n").over(before), F.lit(0))
    cuts = (
        sizes.withColumn("_left", left).filter("_left > 0")
        .groupBy(*groups).agg(F.max("_bucket").alias("_cut"), F.min("_left").alias("_left"))
    )
    near = (
        df.withColumn("_bucket", bucket)
        .join(broadcast_if_small(freeze(cuts)), groups)
        .filter(F.col("_bucket") <= F.col("_cut"))
    )
    rank = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(md5_key([key], seed), key))
    sampled = near.withColumn("_rank", rank).filter("_bucket < _cut or _rank <= _left")
    return sampled.select(*df.columns)


def stratified_subset(
    df: DataFrame,
    timestamp: str = "author_date",
    first: int = FIRST_YEAR,
    last: int = LAST_YEAR,
    key: str = "commit_id",
    groups: Sequence[str] = ("project", "buggy"),
    target_rows: int = SAMPLE_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """Year filter, then stratified sample."""
    return stratified_sample(filter_years(df, timestamp, first, last), key, groups, target_rows, seed)


def freeze_sample(sample: DataFrame, path: str, ids_path: str, key: str = "commit_id") -> DataFrame:
    """Write a sample and its id list; returns the written sample, for reuse by all experiments."""
    sample.write.mode("overwrite").parquet(path)
    written = sample.sparkSession.read.schema(sample.schema).parquet(path)
    written.select(key).write.mode("overwrite").parquet(ids_path)
    return written


def frozen_sample(df: DataFrame, ids_path: str, key: str = "commit_id") -> DataFrame:
    """Rows of a table that belong to a frozen sample."""
    return df.join(df.sparkSession.read.parquet(ids_path), key, "left_semi")


def top_projects(df: DataFrame, column: str = "project", n: int = 10) -> DataFrame:
    """The ``n`` most frequent values, ties by name."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)


def head_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """First ``n`` rows by a unique key, nulls last; the last of them is found by counting, and no rows are gathered.

    Fewer rows than ``n`` are all returned. Rows that repeat a key are told apart by nothing, so
    those that the limit cuts are any of them.
    """
    kind = df.schema[key].dataType
    known, rest = df.filter(F.col(key).isNotNull()), df.filter(F.col(key).isNull())
    if n <= 0:
        return df.limit(0)
    if isinstance(kind, T.IntegralType):
        if known.count() >= n:
            return known.filter(first_rows(known, F.col(key), [key], n))
        last = None
    elif isinstance(kind, T.StringType):
        last = text_at(known, key, n - 1)
    else:
        keys, _ = with_position(known.select(key), [F.col(key)])
        hit = keys.filter(F.col("pos") == n - 1).first()
        last = hit[key] if hit else None
    if last is None:
        return _filled(known, rest, n)
    below, equal = known.filter(F.col(key) < F.lit(last)), known.filter(F.col(key) == F.lit(last))
    return below.union(equal.limit(n - below.count()))


def _filled(known: DataFrame, nulls: DataFrame, n: int) -> DataFrame:
    """Rows with keys, and of those without as many as are missing to ``n``."""
    return known.union(nulls.limit(max(0, n - known.count())))


def skip_tail(df: DataFrame, key: str, skip: int = 1100, show: int = 5) -> DataFrame:
    """The ``show`` rows before the last ``skip``."""
    return df.orderBy(F.col(key).desc()).offset(skip).limit(show)


def random_subset(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows without replacement (all if there are fewer), reproducible by key and seed."""
    if df.count() <= n:
        return df
    return df.filter(first_rows(df, md5_number([key], seed), [key], n))
