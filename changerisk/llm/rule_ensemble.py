"""Quality classifier: a sparse ensemble of rules over text statistics.

1. statistics of a bounded sample of labelled texts (``SAMPLE_ROWS``, the smallest hashes of ids)
2. a random forest of shallow trees; each path from a root to a node is a conjunction of bounds
3. a logistic regression with a lasso penalty on the rules' truth values keeps few of them
4. what is left is a Spark column: a constant and weights under CASE WHEN, and the logistic function

Only the fit sees a sample; every row is scored, by columns alone, in the scan that reads it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.llm.common import text_or_empty
from changerisk.llm.text_stats import STATISTICS, with_statistics
from changerisk.runtime import freeze

#: Labelled rows the classifier is fitted on, at most.
SAMPLE_ROWS = 20_000

TREES, DEPTH, PENALTY, SEED = 24, 3, 0.0005, 42

_CONDITION = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics that must all hold: (name, low, high), low < value <= high."""

    bounds: tuple[tuple[str, float, float], ...]

    def holds(self, stats: str = "stats") -> Column:
        """Whether the rule holds, as a column."""
        result = None
        for name, low, high in self.bounds:
            value = F.col(f"{stats}.{name}")
            for test in ([value > low] if low > -math.inf else []) + ([value <= high] if high < math.inf else []):
                result = test if result is None else result & test
        return F.lit(True) if result is None else result


def rules_of(tree: str) -> list[Rule]:
    """Rules of one tree, from its printed form: one for each node below the root."""
    path: list[tuple[int, int, str, float]] = []
    rules = []
    for line in tree.splitlines():
        match = _CONDITION.match(line)
        if not match:
            continue
        depth, feature, side, edge = len(match[1]), int(match[2]), match[3], float(match[4])
        path = [step for step in path if step[0] < depth] + [(depth, feature, side, edge)]
        bounds: dict[int, list[float]] = {}
        for _, number, direction, value in path:
            low_high = bounds.setdefault(number, [-math.inf, math.inf])
            if direction == ">":
                low_high[0] = max(low_high[0], value)
            else:
                low_high[1] = min(low_high[1], value)
        rules.append(Rule(tuple((STATISTICS[n], *bounds[n]) for n in sorted(bounds))))
    return rules


@dataclass
class RuleEnsemble:
    """Weighted rules; ``score`` is the logistic function of their sum."""

    constant: float = 0.0
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self, stats: str = "stats") -> Column:
        """Probability of label 1 as a column over a struct of statistics."""
        total = F.lit(self.constant)
        for rule, weight in self.weights.items():
            total = total + F.when(rule.holds(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit_rules(labelled: DataFrame, label: str = "label") -> RuleEnsemble:
    """Fit on rows with ``stats`` and a 0/1 ``label``; rows without a label do not count.

    With labels of one kind, or none, the ensemble is a constant: the smoothed share of ones.
    """
    rows = labelled.filter(F.col(label).isin(0, 1)).select("stats", F.col(label).cast("double").alias("label"))
    counts = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    if not ones or not zeros:
        share = (ones + 1) / (ones + zeros + 2)
        return RuleEnsemble(math.log(share / (1 - share)))
    vector = array_to_vector(F.array(*[F.col(f"stats.{name}") for name in STATISTICS]))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird")
    trees = forest.fit(rows.select("label", vector.alias("features"))).trees
    rules = list(dict.fromkeys(rule for tree in trees for rule in rules_of(tree.toDebugString)))
    truth = array_to_vector(F.array(*[rule.holds().cast("double") for rule in rules]))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=100, standardization=True)
    model = lasso.fit(freeze(rows.select("label", truth.alias("features"))))
    weights = {rule: float(w) for rule, w in zip(rules, model.coefficients) if w != 0.0}
    return RuleEnsemble(float(model.intercept), weights)


def sample_labels(labels: DataFrame, docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, stats, label``: statistics of labelled texts, of at most ``rows`` of them.

    The rows with the smallest hashes of their ids are taken, so the sample does not depend on
    their order; their ids, bounded by ``rows``, are broadcast.
    """
    known = labels.filter("doc_id is not null and label is not null").select("doc_id", "label")
    picked = freeze(known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")
    staged = with_statistics(texts).select("doc_id", "label", "stats")
    # One task holds the bounded sample in a fixed order, so that the fit is the same every time.
    return freeze(staged.repartition(1).sortWithinPartitions("doc_id", "label"))


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from: a quarter of all, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fit on ``labels.quality`` of documents that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    return fit_rules(sample_labels(known, docs, rows))


def score_quality(docs: DataFrame, ensemble: RuleEnsemble) -> DataFrame:
    """All rows and columns of ``docs`` and a last column ``score``; texts that are null are empty."""
    name = "_stats"
    return with_statistics(docs, name=name).withColumn("score", ensemble.score(name)).drop(name)
