"""Tree models on MLlib: weights, training, scores, importance, comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.errors import ChangeRiskError
from changerisk.fixed_values import SEED
from changerisk.operators.leafwise import LeafwiseBoosting, LeafwiseModel
from changerisk.operators.metrics import classification_metrics
from changerisk.runtime import freeze, path_exists, remove_path

_WEIGHT = "_weight"

_COPIES = "_copies"

# Rows of a training task.
ROWS_PER_TASK = 50_000

#: Cells of merged rows that a task boosts alone: a tree asks a dozen times, and a Spark job costs more than such rows do.
TASK_CELLS = 2_000_000

#: Rows that equal rows become where a model draws rows at random: each is drawn on its own.
DRAWS = 16


def class_weights(df: DataFrame, label: str = "buggy") -> DataFrame:
    """Balanced weight per label value: n / (classes * n of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("rows"))
    facts = counts.agg(F.sum("rows").alias("rows"), F.count("*").alias("classes")).first()
    return counts.withColumn("weight", F.lit(float(facts["rows"])) / (F.lit(facts["classes"]) * F.col("rows")))


def scale_pos_weight(df: DataFrame, label: str = "buggy") -> float:
    """Negatives per positive; 1.0 if there is no positive."""
    facts = df.agg(F.count("*").alias("rows"), F.sum(F.col(label).cast("long")).alias("positives")).first()
    positives = facts["positives"] or 0
    return (facts["rows"] - positives) / positives if positives else 1.0


def balanced_weight(df: DataFrame, label: str = "buggy") -> Column:
    """The balanced weight of a row, as constants per class."""
    weight = F.lit(1.0)
    for row in class_weights(df, label).collect():  # two classes
        weight = F.when(F.col(label) == F.lit(row[label]), F.lit(row["weight"])).otherwise(weight)
    return weight


def random_forest(num_trees: int = 100, max_depth: int = 30, seed: int = SEED, **params) -> Estimator:
    """Bagged trees; 30 is the deepest MLlib grows."""
    return RandomForestClassifier(
        numTrees=num_trees, maxDepth=max_depth, seed=seed, featureSubsetStrategy="sqrt", cacheNodeIds=True, **params
    )


def boosted_trees(rounds: int = 100, learning_rate: float = 0.1, max_depth: int = 6, seed: int = SEED, **params) -> Estimator:
    """Gradient-boosted trees."""
    return GBTClassifier(
        maxIter=rounds, stepSize=learning_rate, maxDepth=max_depth, seed=seed, cacheNodeIds=True, **params
    )


def boosted_trees_fine(rounds: int = 100, learning_rate: float = 0.1, leaves: int = 31, **growth) -> LeafwiseBoosting:
    """Boosted trees that grow by the leaf that gains most, with finer bins."""
    growth = {"task_cells": TASK_CELLS, **growth}
    return LeafwiseBoosting(rounds=rounds, learning_rate=learning_rate, leaves=leaves, **growth)


_MODELS: dict[str, Callable[..., Estimator]] = {
    "random_forest": random_forest,
    "boosted_trees": boosted_trees,
    "boosted_trees_fine": boosted_trees_fine,
}


def register_model(name: str, build: Callable[..., Estimator]) -> None:
    """Make another classifier available by name."""
    _MODELS[name] = build


def model_factory(name: str, **params) -> Estimator:
    """A configured classifier."""
    if name not in _MODELS:
        raise ChangeRiskError(f"unknown model {name!r}; known: {', '.join(sorted(_MODELS))}")
    return _MODELS[name](**params)


def feature_names(df: DataFrame, features: Sequence[str], vector_sizes: dict[str, int] | None = None) -> list[str]:
    """Flat names: arrays become name_1, name_2, ..."""
    names: list[str] = []
    for feature in features:
        size = (vector_sizes or {}).get(feature)
        names += [f"{feature}_{i}" for i in range(1, size + 1)] if size else [feature]
    return names


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """One vector column out of number and array columns."""
    inputs, temporary = [], []
    for feature in features:
        if isinstance(df.schema[feature].dataType, T.ArrayType):
            name = f"_v_{feature}"
            df = df.withColumn(name, array_to_vector(F.col(feature).cast("array<double>")))
            temporary.append(name)
            inputs.append(name)
        else:
            inputs.append(feature)
    return VectorAssembler(inputCols=inputs, outputCol=output).transform(df).drop(*temporary)


def draws_of_equal_rows(estimator: Estimator) -> int | None:
    """As how many rows a model may get equal rows, their weight shared out; None: only as they are.

    Without draws a sum of weights says the same as its rows. A model that counts rows beside their
    weights needs each of them.
    """
    if not isinstance(estimator, (RandomForestClassifier, GBTClassifier)) or estimator.getMinInstancesPerNode() > 1:
        return None
    drawn = isinstance(estimator, RandomForestClassifier) or estimator.getSubsamplingRate() < 1.0
    return DRAWS if drawn else 1


def merged_rows(rows: DataFrame, weight: str, draws: int = 1) -> DataFrame:
    """Equal rows as at most ``draws`` rows that weigh as much together, where this halves the rows at least.

    Columns are numbers and arrays. Trees cost rows x depth x trees, so they then cost no more for a
    table whose values repeat than for its different rows.
    """
    facts = rows.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(*rows.columns)).alias("kinds")).first()
    if 2 * draws * facts["kinds"] > facts["rows"]:
        return rows
    kinds = rows.groupBy(*rows.columns).agg(F.count("*").alias(_COPIES))
    parts = F.least(F.col(_COPIES), F.lit(draws)).cast("int")
    kinds = kinds.withColumn(weight, F.col(weight) * F.col(_COPIES) / parts)
    if draws > 1:
        kinds = kinds.withColumn(_COPIES, F.explode(F.sequence(F.lit(1), parts)))
    return kinds.drop(_COPIES)


def train(
    name: str, train_rows: DataFrame, features: Sequence[str], label: str = "buggy", weight: Column | None = None, **params
):
    """Fit a model; ``weight`` gives each row its weight."""
    estimator = model_factory(name, **params)
    weight = weight if weight is not None else F.lit(1.0)
    rows = train_rows.select(*dict.fromkeys([*features, label]), weight.cast("double").alias(_WEIGHT))
    draws = draws_of_equal_rows(estimator)
    if draws:
        rows = merged_rows(rows, _WEIGHT, draws)
    ready = assemble(rows, features).select("features", F.col(label).cast("double").alias("label"), _WEIGHT)
    # A fit is hundreds of short jobs over the same rows: computed once, in no more tasks than rows warrant.
    ready = freeze(ready)
    ready = ready.coalesce(max(1, math.ceil(ready.count() / ROWS_PER_TASK)))
    return estimator.setParams(featuresCol="features", labelCol="label", weightCol=_WEIGHT).fit(ready)


def train_random_forest(train_rows: DataFrame, features: Sequence[str], label: str = "buggy", **params):
    """100 trees with balanced class weights."""
    return train("random_forest", train_rows, features, label, balanced_weight(train_rows, label), **params)


def train_boosted_trees(
    train_rows: DataFrame, features: Sequence[str], label: str = "buggy", positive_weight: float | None = None, **params
):
    """100 boosting rounds at rate 0.1; positives may weigh more."""
    weight = None if positive_weight is None else F.when(F.col(label) == 1, positive_weight).otherwise(1.0)
    return train("boosted_trees", train_rows, features, label, weight, **params)


def train_boosted_trees_fine(train_rows: DataFrame, features: Sequence[str], label: str = "buggy", **params):
    """The third model of the fused experiment: trees grown leaf by leaf."""
    return train("boosted_trees_fine", train_rows, features, label, **params)


def predictions(model, rows: DataFrame, features: Sequence[str], keep: Sequence[str], label: str = "buggy") -> DataFrame:
    """Key columns, true label, prediction and score of the positive class."""
    scored = model.transform(assemble(rows, features))
    return scored.select(
        *keep,
        F.col(label).cast("int").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability")[1].alias("y_score"),
    )


def predictions_join(scored: DataFrame, commits: DataFrame, key: str = "commit_id") -> DataFrame:
    """Attach commit columns to predictions by key, so each score keeps its own commit."""
    return scored.join(commits.select(key, *[c for c in commits.columns if c not in scored.columns]), key)


def feature_importance(model, names: Sequence[str], spark) -> DataFrame:
    """(feature, importance), most important first; one row per feature of the model."""
    values = model.featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def wide_predictions(scored: dict[str, DataFrame], keep: Sequence[str] = ("commit_id",)) -> DataFrame:
    """Predictions of several models side by side: the key columns, the label, and per model
    ``<model>_pred`` and ``<model>_score``. The tables must hold the same commits, once each.
    """
    key, result = keep[0], None
    for name, rows in scored.items():
        own = [F.col("y_pred").alias(f"{name}_pred"), F.col("y_score").alias(f"{name}_score")]
        part = rows.select(*(keep if result is None else [key]), *(["y_true"] if result is None else []), *own)
        result = part if result is None else result.join(part, key)
    return result


def evaluate(scored: DataFrame) -> DataFrame:
    """Metrics of a predictions table."""
    return classification_metrics(scored, "y_true", "y_pred", "y_score")


def model_comparison(scored: dict[str, DataFrame]) -> DataFrame:
    """One metrics row per model."""
    result = None
    for name, rows in scored.items():
        row = evaluate(rows).select(F.lit(name).alias("model"), "*")
        result = row if result is None else result.unionByName(row)
    return result


def save_model(model, path: str) -> None:
    """Write a fitted model, replacing an older one."""
    if isinstance(model, LeafwiseModel):
        remove_path(_active_session(), path)
        model.save(_active_session(), path)
        return
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | LeafwiseModel:
    """Read a written model of whatever class it names."""
    from pyspark.ml.util import DefaultParamsReader

    if path_exists(_active_session(), f"{path}/leafwise"):
        return LeafwiseModel.load(_active_session(), path)
    return DefaultParamsReader.loadParamsInstance(path, _active_session())


def _active_session():
    from pyspark.sql import SparkSession

    return SparkSession.active()
