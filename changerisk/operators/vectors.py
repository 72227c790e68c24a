"""Statistics of an embedding column: cells, dimensions, concentration, correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changerisk.fixed_values import (
    CONCENTRATION_RANKS,
    CUMULATIVE_SHARES,
    HISTOGRAM_BINS,
    NEAR_ZERO,
    SEED,
    STRONG_CORRELATIONS,
)
from changerisk.functions.vectors import fold, vector_norm
from changerisk.operators.profile import histogram
from changerisk.operators.sampling import random_subset
from changerisk.runtime import freeze


def embedding_summary(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row over all cells: min, max, mean, std, mean |x|, mean length of a vector, % near zero.

    Each vector is folded to a few numbers in its row; null vectors and null cells do not count.
    The deviation is put together from each vector's own and that of the vectors' means.
    """
    cells = F.filter(F.col(vector).cast("array<double>"), lambda x: x.isNotNull())
    rows = df.filter(F.col(vector).isNotNull()).select(cells.alias("v")).filter(F.size("v") > 0)
    n, mean = F.size("v").cast("double"), fold(F.col("v"), lambda x: x) / F.size("v")
    rows = rows.withColumns({"n": n, "mean": mean})
    rows = rows.select(
        "n",
        "mean",
        F.array_min("v").alias("low"),
        F.array_max("v").alias("high"),
        fold(F.col("v"), lambda x: (x - F.col("mean")) * (x - F.col("mean"))).alias("inside"),
        fold(F.col("v"), F.abs).alias("sizes"),
        vector_norm(F.col("v")).alias("norm"),
        F.size(F.filter("v", lambda x: F.abs(x) < NEAR_ZERO)).alias("near"),
    )
    total = F.sum("n")
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.sum(F.col("n") * F.col("mean")) ** 2 / total
    return rows.agg(
        F.min("low").alias("min_value"),
        F.max("high").alias("max_value"),
        (F.sum(F.col("n") * F.col("mean")) / total).alias("mean_value"),
        F.sqrt((F.sum("inside") + F.greatest(between, F.lit(0.0))) / total).alias("std_value"),
        (F.sum("sizes") / total).alias("mean_abs"),
        F.avg("norm").alias("mean_norm"),
        (F.sum("near") / total * 100).alias("near_zero_percent"),
    )


def dimension_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean, standard deviation and variance (population) per dimension.

    Cells are summed up inside each task, so only one row per dimension and task is shuffled.
    """
    cells = df.select(F.posexplode(vector).alias("dimension", "raw"))
    x = F.col("raw").cast("double")
    return cells.groupBy("dimension").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.var_pop(x).alias("variance")
    )


def variance_share(stats: DataFrame) -> DataFrame:
    """Dimensions by falling variance, with their share and the share reached so far.

    Takes the table of ``dimension_stats``, one row per dimension, hence the global windows.
    """
    everything = Window.partitionBy()
    by_variance = Window.orderBy(F.desc("variance"), "dimension")
    total = F.sum("variance").over(everything)
    share = F.when(total > 0, F.col("variance") / total).otherwise(0.0)
    return (
        stats.select("dimension", "variance", share.alias("variance_share"))
        .withColumn("rank", F.row_number().over(by_variance))
        .withColumn("cumulative_share", F.sum("variance_share").over(by_variance))
    )


def top_variance_dims(shares: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` dimensions of largest variance."""
    return shares.filter(F.col("rank") <= k)


def dims_to_reach(shares: DataFrame, targets: tuple[float, ...] = CUMULATIVE_SHARES) -> DataFrame:
    """Dimensions needed for each cumulative share; all of them where it is never reached."""
    needed = shares.agg(
        F.count("*").cast("int").alias("all"),
        *[F.min(F.when(F.col("cumulative_share") >= t, F.col("rank"))).alias(f"t{i}") for i, t in enumerate(targets)],
    )
    rows = [
        F.struct(F.lit(t).alias("share"), F.coalesce(f"t{i}", "all").alias("dimensions")) for i, t in enumerate(targets)
    ]
    return needed.select(F.inline(F.array(*rows)))


def effective_rank(shares: DataFrame) -> DataFrame:
    """exp of the entropy of the variance shares; 0 when nothing varies."""
    p = F.when(F.col("variance_share") > 0, F.col("variance_share"))
    return shares.agg(F.coalesce(F.exp(F.sum(-p * F.ln(p))), F.lit(0.0)).alias("effective_rank"))


def variance_spread(shares: DataFrame, ranks: tuple[int, ...] = CONCENTRATION_RANKS) -> DataFrame:
    """Spread of the variances and the share of the top dimensions."""
    v = F.col("variance")
    ratio = F.when(F.min(v) > 0, F.max(v) / F.min(v)).otherwise(F.lit(float("inf")))
    return shares.agg(
        F.avg(v).alias("mean_variance"),
        F.stddev_pop(v).alias("std_variance"),
        F.min(v).alias("min_variance"),
        F.max(v).alias("max_variance"),
        ratio.alias("max_min_ratio"),
        *[
            F.sum(F.when(F.col("rank") <= k, F.col("variance_share")).otherwise(0.0)).alias(f"top_{k}_share")
            for k in ranks
        ],
    )


def correlation_pairs(
    df: DataFrame, vector: str = "embedding", key: str = "commit_id", rows: int | None = None, seed: int = SEED
) -> DataFrame:
    """Pearson correlation of all dimension pairs a < b; undefined gives 0.

    All rows count, unless ``rows`` asks for a random sample of that many by ``key``. The
    products are summed by a tree of tasks; only the d x d result reaches the driver.
    """
    known = df.filter(F.col(vector).isNotNull())
    if rows is not None:
        known = random_subset(known.select(key, vector), key, rows, seed)
    vectors = known.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    matrix = np.nan_to_num(Correlation.corr(vectors, "v").first()[0].toArray(), nan=0.0, posinf=0.0, neginf=0.0)
    a, b = np.triu_indices_from(matrix, k=1)
    pairs = pd.DataFrame({"dimension_a": a.astype("int32"), "dimension_b": b.astype("int32"), "correlation": matrix[a, b]})
    pairs["abs_correlation"] = pairs["correlation"].abs()
    schema = "dimension_a int, dimension_b int, correlation double, abs_correlation double"
    return df.sparkSession.createDataFrame(pairs, schema)


def top_correlated_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` pairs of largest absolute correlation."""
    order = Window.orderBy(F.desc("abs_correlation"), "dimension_a", "dimension_b")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def correlation_summary(pairs: DataFrame, thresholds: tuple[float, ...] = STRONG_CORRELATIONS) -> DataFrame:
    """Mean, median, 95th percentile and max of |correlation|, and pairs at or above thresholds."""
    c = F.col("abs_correlation")
    return pairs.agg(
        F.avg(c).alias("mean_abs"),
        F.percentile(c, F.lit(0.5)).alias("median_abs"),
        F.percentile(c, F.lit(0.95)).alias("p95_abs"),
        F.max(c).alias("max_abs"),
        *[F.count_if(c >= t).alias(f"pairs_{round(t * 100)}") for t in thresholds],
    )


def dimension_histogram(
    df: DataFrame, what: str, vector: str = "embedding", key: str = "commit_id", bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Histogram of dimension means, stds or variances, of vector norms, or of |correlation|."""
    if what == "norm":
        return histogram(df, vector_norm(F.col(vector)), bins)
    if what == "correlation":
        return histogram(correlation_pairs(df, vector, key), F.col("abs_correlation"), bins)
    return histogram(dimension_stats(df, vector), F.col(what), bins)


def pca_readiness(df: DataFrame, vector: str = "embedding", key: str = "commit_id", rows: int | None = None) -> DataFrame:
    """All diagnostics as (section, name, value)."""

    def long(one_row: DataFrame, section: str) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in one_row.columns]
        return one_row.select(F.lit(section).alias("section"), F.inline(F.array(*pairs)))

    shares = freeze(variance_share(dimension_stats(df, vector)))  # one row per dimension
    pairs = correlation_pairs(df, vector, key, rows)
    reach = dims_to_reach(shares).select(
        F.lit("reach").alias("section"),
        F.concat(F.lit("share_"), F.round(F.col("share") * 100).cast("int").cast("string")).alias("name"),
        F.col("dimensions").cast("double").alias("value"),
    )
    return (
        long(variance_spread(shares), "variance")
        .unionByName(long(effective_rank(shares), "variance"))
        .unionByName(reach)
        .unionByName(long(correlation_summary(pairs), "correlation"))
    )
