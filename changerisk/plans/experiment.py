"""A whole experiment: clean, sample, split, fuse, train, score, compare."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.errors import ChangeRiskError
from changerisk.fixed_values import EXPERIMENTS, FIRST_YEAR, LAST_YEAR, SEED, TRAIN_FRACTION
from changerisk.operators import clean, fusion, models, sampling, split
from changerisk.runtime import freeze
from changerisk.sources.sinks import write_report


@dataclass
class Outcome:
    """Everything an experiment produces.

    ``wide`` has the predictions of all models side by side; ``lost_rows`` counts the commits that
    a joined source lacks.
    """

    number: int
    features: list[str]
    cleaning: DataFrame
    split: DataFrame
    positive_weight: float
    fitted: dict[str, object]
    predictions: dict[str, DataFrame]
    importance: dict[str, DataFrame]
    comparison: DataFrame
    wide: DataFrame
    lost_rows: int

    def save(self, path: str) -> None:
        """Models, predictions, metrics, importance and reports below one folder."""
        for name, model in self.fitted.items():
            models.save_model(model, f"{path}/models/{name}")
            self.predictions[name].write.mode("overwrite").option("header", True).csv(f"{path}/predictions/{name}")
            write_report(self.importance[name], f"{path}/metrics/{name}_importance")
        self.wide.write.mode("overwrite").option("header", True).csv(f"{path}/predictions/all")
        write_report(self.comparison, f"{path}/metrics/comparison")
        write_report(self.split, f"{path}/metrics/split")
        write_report(self.cleaning, f"{path}/metrics/cleaning")


def run_experiment(
    number: int,
    commits: DataFrame,
    sources: Mapping[str, tuple[DataFrame | Callable[[DataFrame], DataFrame] | None, Sequence[str]]],
    *,
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
    target_rows: int | None = None,
    groups: Sequence[str] = ("project", "buggy"),
    fraction: float = TRAIN_FRACTION,
    seed: int = SEED,
    params: Mapping[str, Mapping[str, object]] | None = None,
    weighted: bool | None = None,
) -> Outcome:
    """Run one of the seven experiments.

    ``commits`` has commit_id, project, author_date, buggy. ``sources`` maps "metrics",
    "vectors" and "reasoning" to (table keyed by commit_id, feature columns); a None table means
    that the columns are in ``commits``, and a function makes the table of the commits it is given,
    where the experiment takes that source at all. All commits of the years are split by time; models are
    fitted on the whole train side, or on a stratified sample of at most ``target_rows`` of it, and
    scored on the whole test side. Only those commits take part in the joins.
    """
    if number not in EXPERIMENTS:
        raise ChangeRiskError(f"experiment {number} is not defined")
    wanted, model_names = EXPERIMENTS[number]
    missing = [name for name in wanted if name not in sources]
    if missing:
        raise ChangeRiskError(f"experiment {number} needs the sources {missing}")
    own = [f for name in wanted if sources[name][0] is None for f in sources[name][1]]
    features = [f for name in wanted for f in sources[name][1]]

    base = commits.select(*dict.fromkeys(["commit_id", "project", "author_date", "buggy", *own]))
    cleaned, cleaning_report = clean.clean_commits(base, own)
    known = freeze(sampling.filter_years(cleaned, "author_date", first_year, last_year))
    train_side, test_side = split.temporal_split(known, fraction=fraction)
    if target_rows is not None and train_side.count() > target_rows:
        train_side = sampling.stratified_sample(train_side, "commit_id", groups, target_rows, seed)
    sides = freeze(train_side.withColumn("side", F.lit("train")).unionByName(test_side.withColumn("side", F.lit("test"))))
    joined = _with_sources(sides, [sources[name] for name in wanted if sources[name][0] is not None])
    lost_rows = sides.count() - joined.count()
    sizes = _vector_sizes(joined, features)
    fused = freeze(_imputed(joined, features, sizes))
    train_rows, test_rows = fused.filter("side = 'train'"), fused.filter("side = 'test'")
    split_rows = split.split_report(fused, fraction=fraction)
    names = models.feature_names(fused, features, sizes)
    positive_weight = models.scale_pos_weight(train_rows)
    use_weight = weighted if weighted is not None else "metrics" in wanted
    keep = ["commit_id", "project", "author_date"]
    fitted, scored, importance = {}, {}, {}
    for name in model_names:
        options = dict((params or {}).get(name, {}))
        if name == "random_forest":
            model = models.train_random_forest(train_rows, features, **options)
        elif name == "boosted_trees":
            model = models.train_boosted_trees(
                train_rows, features, positive_weight=positive_weight if use_weight else None, **options
            )
        else:
            model = models.train(name, train_rows, features, **options)
        fitted[name] = model
        scored[name] = freeze(models.predictions(model, test_rows, features, keep))
        importance[name] = models.feature_importance(model, names, commits.sparkSession)
    return Outcome(
        number,
        names,
        cleaning_report,
        split_rows,
        positive_weight,
        fitted,
        scored,
        importance,
        models.model_comparison(scored),
        models.wide_predictions(scored, keep),
        lost_rows,
    )


def _with_sources(sides: DataFrame, sources: Sequence[tuple]) -> DataFrame:
    """Commits that every source has. Tables join first, so that functions are asked for no other commits."""
    tables = [table.select("commit_id", *names) for table, names in sources if not callable(table)]
    joined = freeze(fusion.fuse_features([sides, *tables])) if tables else sides
    made = [make(joined.select("commit_id")).select("commit_id", *names) for make, names in sources if callable(make)]
    return freeze(fusion.fuse_features([joined, *made])) if made else joined


def _imputed(fused: DataFrame, features: Sequence[str], sizes: Mapping[str, int]) -> DataFrame:
    """No nulls: numbers get the medians of the train side, vectors become zeros."""
    numbers = [name for name in features if name not in sizes]
    values, _ = clean.fill_values(fused.filter("side = 'train'"), numbers)
    open_columns = {name: 0 for name in numbers if name not in values}
    filled = clean.apply_fill(fused, {**open_columns, **values})
    for name, size in sizes.items():
        filled = filled.withColumn(name, F.coalesce(F.col(name), F.array_repeat(F.lit(0.0), size).cast(fused.schema[name].dataType)))
    return filled


def _vector_sizes(df: DataFrame, features: Sequence[str]) -> dict[str, int]:
    arrays = [f for f in features if isinstance(df.schema[f].dataType, T.ArrayType)]
    if not arrays:
        return {}
    return df.agg(*[F.max(F.size(f)).alias(f) for f in arrays]).first().asDict()
