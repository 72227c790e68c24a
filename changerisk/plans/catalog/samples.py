"""Strata, samples and splits."""

from pyspark.sql import functions as F

from changerisk.operators import sampling, split
from changerisk.plans.catalog.registry import query
from changerisk.plans.catalog.roles import LABELLED_ORDERS, labelled_orders
from changerisk.runtime import freeze, scratch_path

TARGET = 1000

_SAMPLE = f"""
    WITH base AS ({LABELLED_ORDERS}),
    kept AS (SELECT * FROM base WHERE {{where}}),
    strata AS (
        SELECT project, buggy, greatest(round_even(count(*) / (SELECT count(*) FROM kept)::DOUBLE * {TARGET}, 0), 1) AS quota
        FROM kept GROUP BY ALL),
    sampled AS (
        SELECT kept.* FROM kept JOIN strata USING (project, buggy)
        QUALIFY row_number() OVER (PARTITION BY project, buggy
                                   ORDER BY md5(CAST(commit_id AS VARCHAR) || ':42'), commit_id) <= quota)"""
_ALL = _SAMPLE.format(where="TRUE")
_YEARS = _SAMPLE.format(where="year(author_date) BETWEEN 1996 AND 2000")
_SIDES = """
    SELECT *, CASE WHEN row_number() OVER (ORDER BY author_date, commit_id) <= floor((SELECT count(*) FROM {table}) * 0.8)
                   THEN 'train' ELSE 'test' END AS side FROM {table}"""


@query("stratum_targets", f"""
    WITH base AS ({LABELLED_ORDERS})
    SELECT project, buggy, count(*) AS count,
           CAST(greatest(round_even(count(*) / (SELECT count(*) FROM base)::DOUBLE * 777, 0), 1) AS BIGINT) AS target_count
    FROM base GROUP BY ALL""")
def stratum_targets(t):
    return sampling.stratum_targets(labelled_orders(t), target_rows=777)


@query("stratified_sample", _ALL + "SELECT commit_id, project, buggy FROM sampled")
def stratified_sample(t):
    return sampling.stratified_sample(labelled_orders(t), target_rows=TARGET).select("commit_id", "project", "buggy")


def subset(t):
    return sampling.stratified_subset(labelled_orders(t), first=1996, last=2000, target_rows=TARGET)


@query("stratified_subset", _YEARS + "SELECT commit_id, project, buggy FROM sampled")
def stratified_subset(t):
    return subset(t).select("commit_id", "project", "buggy")


@query("frozen_sample", _YEARS + "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT commit_id FROM sampled)")
def frozen_sample(t):
    ids = scratch_path(t.spark, "sample-ids")
    sampling.freeze_sample(subset(t), scratch_path(t.spark, "sample"), ids)
    orders = t.orders.withColumn("commit_id", F.col("o_orderkey"))
    return sampling.frozen_sample(orders, ids).select("o_orderkey", "o_custkey")


def orders_sides(t):
    orders = labelled_orders(t)
    return split.with_side(orders, split.chronological_train(orders, "author_date", "commit_id"))


@query("temporal_split", f"WITH base AS ({LABELLED_ORDERS}), sides AS ({_SIDES.format(table='base')}) SELECT commit_id, buggy, side FROM sides")
def temporal_split(t):
    train, test = split.temporal_split(labelled_orders(t))
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.select("commit_id", "buggy", "side")


@query("split_report", _YEARS + f""",
    sides AS ({_SIDES.format(table='sampled')})
    SELECT side, buggy, count(*) AS rows, CAST(sum(count(*)) OVER (PARTITION BY side) AS BIGINT) AS side_rows,
           CASE side WHEN 'train' THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS ratio
    FROM sides GROUP BY side, buggy""")
def split_report(t):
    sample = freeze(subset(t))
    return split.split_report(split.with_side(sample, split.chronological_train(sample, "author_date", "commit_id")))


@query("random_holdout", """
    SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey)
                                 <= floor((SELECT count(*) FROM orders) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS side
    FROM orders""")
def random_holdout(t):
    orders = t.orders.select("o_orderkey")
    return split.with_side(orders, split.random_train(orders, "o_orderkey"))


@query("random_subset", """
    SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 5000""")
def random_subset(t):
    return sampling.random_subset(t.orders.select("o_orderkey"), "o_orderkey", 5000)
