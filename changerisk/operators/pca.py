"""Principal components: fit, transform, evaluate prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.fixed_values import PCA_COMPONENTS, PCA_SWEEP, SEED, VARIANCE_TO_KEEP
from changerisk.functions.vectors import fold
from changerisk.operators.sampling import random_subset
from changerisk.operators.split import random_holdout
from changerisk.runtime import freeze, path_exists


def _with_vector(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_raw", array_to_vector(F.col(vector).cast("array<double>")))


def pca_fit(
    df: DataFrame,
    vector: str = "embedding",
    k: int = PCA_COMPONENTS,
    *,
    key: str | None = "commit_id",
    sample_rows: int | None = None,
    seed: int = SEED,
) -> PipelineModel:
    """Mean and top ``k`` components of all rows, or of a random sample of ``sample_rows``.

    A sample is drawn by hash of ``key``, so it does not favour whatever the table starts with.
    Spark's own PCA leaves the mean in, hence the centring stage before it.
    """
    rows = df.select(*([key] if key else []), vector).filter(F.col(vector).isNotNull())
    if sample_rows is not None:
        rows = random_subset(rows, key, sample_rows, seed)
    stages = [
        StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=k, inputCol="_centred", outputCol="_scores"),
    ]
    return Pipeline(stages=stages).fit(freeze(_with_vector(rows, vector).select("_raw")))


def pca_parts(model: PipelineModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean (d), components (d x k) and share of variance of each component (k)."""
    scaler, pca = model.stages
    return scaler.mean.toArray(), pca.pc.toArray(), pca.explainedVariance.toArray()


def pca_transform(df: DataFrame, model: PipelineModel, vector: str = "embedding") -> DataFrame:
    """Replace each vector by its component scores; null vectors stay null."""
    size = len(pca_parts(model)[0])
    known = F.coalesce(F.col(vector).cast("array<double>"), F.array_repeat(F.lit(0.0), size))
    scored = model.transform(df.withColumn("_raw", array_to_vector(known)))
    scores = F.when(F.col(vector).isNotNull(), vector_to_array("_scores"))
    return scored.withColumn(vector, scores).select(*df.columns)


def pca_inverse(df: DataFrame, model: PipelineModel, vector: str = "embedding") -> DataFrame:
    """Replace component scores by the vectors they stand for, one matrix product per Arrow batch."""
    mean, components, _ = pca_parts(model)
    shared = df.sparkSession.sparkContext.broadcast((mean, components.T))

    @F.pandas_udf("array<double>")
    def restore(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        centre, rows = shared.value
        for scores in batches:
            block = np.vstack(scores.to_list()) if len(scores) else np.empty((0, len(rows)))
            yield pd.Series(list(block @ rows + centre), index=scores.index)

    return df.withColumn(vector, restore(F.col(vector)))


def pca_save(model: PipelineModel, path: str) -> None:
    """Write the model, replacing an older one."""
    model.write().overwrite().save(path)


def pca_load(path: str) -> PipelineModel:
    """Read a written model."""
    return PipelineModel.load(path)


def pca_fit_or_load(df: DataFrame, path: str, overwrite: bool = False, **fit_options) -> PipelineModel:
    """The model at ``path``; fitted and written first if there is none or it shall be replaced."""
    if path_exists(df.sparkSession, path) and not overwrite:
        return pca_load(path)
    model = pca_fit(df, **fit_options)
    pca_save(model, path)
    return model


def _lost(components: int) -> Column:
    """Squared reconstruction error of a row: what its first scores leave of its length."""
    kept = fold(F.slice("scores", 1, components), lambda z: z * z)
    return F.greatest(fold(F.col("centred"), lambda x: x * x) - kept, F.lit(0.0))


def pca_sweep(
    df: DataFrame,
    vector: str = "embedding",
    components: Sequence[int] = PCA_SWEEP,
    *,
    key: str = "commit_id",
    test_fraction: float = 0.2,
    seed: int = SEED,
) -> DataFrame:
    """Explained variance, train and test reconstruction error and compression per size.

    One fit at the largest valid size serves all of them, since smaller models are prefixes, and
    components are orthonormal, so errors follow from the scores without reconstruction.
    """
    df = freeze(df.select(key, vector).filter(F.col(vector).isNotNull()))  # several passes follow
    train, test = random_holdout(df, key, test_fraction, seed)
    size, train_rows = df.select(F.size(vector)).first()[0], train.count()
    limit = min(train_rows, size)
    valid = [k for k in components if k <= limit]
    skipped = [
        (k, None, None, None, None, f"skipped: requires <= {limit} components for this sample")
        for k in components
        if k > limit
    ]
    rows = []
    if valid:
        model = pca_fit(train, vector, max(valid), key=None, sample_rows=None, seed=seed)
        shares = pca_parts(model)[2]
        errors = {}
        for side, part in (("train", train), ("test", test)):
            scored = model.transform(_with_vector(part, vector)).select(
                vector_to_array("_centred").alias("centred"), vector_to_array("_scores").alias("scores")
            )
            errors[side] = scored.agg(*[(F.avg(_lost(k)) / size).alias(f"k{k}") for k in valid]).first()
        rows = [
            (k, float(shares[:k].sum()), errors["train"][f"k{k}"], errors["test"][f"k{k}"], size / k, "ok")
            for k in valid
        ]
    schema = (
        "n_components int, explained_variance_ratio double, train_reconstruction_mse double, "
        "test_reconstruction_mse double, compression_ratio double, status string"
    )
    return df.sparkSession.createDataFrame(rows + skipped, schema)


def pca_evaluate(df: DataFrame, k: int, vector: str = "embedding", **options) -> DataFrame:
    """The row of ``pca_sweep`` for one size."""
    return pca_sweep(df, vector, [k], **options)


def pca_recommend(results: DataFrame, keep: float = VARIANCE_TO_KEEP) -> DataFrame:
    """Smallest size that keeps enough variance, else the best one; a message if none is valid."""
    enough = F.col("explained_variance_ratio") >= keep
    ranked = results.filter("status = 'ok'").orderBy(
        F.desc(enough),
        F.when(enough, F.col("n_components")),
        F.desc("explained_variance_ratio"),
        "n_components",
    )
    chosen = ranked.limit(1).agg(
        F.max("n_components").alias("n_components"),
        F.max("explained_variance_ratio").alias("explained_variance_ratio"),
    )
    message = (
        F.when(F.col("n_components").isNull(), "no valid run; use a larger sample")
        .when(enough, "smallest size that keeps enough variance")
        .otherwise("no size keeps enough variance; this one keeps most")
    )
    return chosen.withColumn("recommendation", message)


def pca_projection_2d(df: DataFrame, vector: str = "embedding", key: str = "commit_id") -> DataFrame:
    """Coordinates of every row on the first two components, and the share each explains."""
    known = df.filter(F.col(vector).isNotNull())
    model = pca_fit(known, vector, 2, key=key, sample_rows=None)
    shares = pca_parts(model)[2]
    placed = pca_transform(known.select(key, vector), model, vector)
    return placed.select(
        key,
        F.col(vector)[0].alias("pc1"),
        F.col(vector)[1].alias("pc2"),
        F.lit(float(shares[0])).alias("pc1_share"),
        F.lit(float(shares[1])).alias("pc2_share"),
    )
