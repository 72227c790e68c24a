"""Leaf-wise boosted trees against a plain version on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from changerisk.operators import leafwise, models
from changerisk.operators.leafwise import Growth, LeafwiseBoosting, LeafwiseModel, bin_edges


def plain_boost(x, y, w, growth):
    """The same trees by looking at every value of every feature, one leaf at a time."""
    share = (w * y).sum() / w.sum()
    start = math.log(share / (1 - share))
    margin, trees = np.full(len(y), start), []
    for _ in range(growth.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def best(rows):
            found = None
            for f in range(x.shape[1]):
                for t in sorted(set(x[:, f]))[1:]:
                    left, right = rows & (x[:, f] < t), rows & (x[:, f] >= t)
                    if min(left.sum(), right.sum()) < growth.min_rows or min(h[left].sum(), h[right].sum()) < growth.min_hessian:
                        continue
                    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + growth.penalty)
                    gain = (score(left) + score(right) - score(rows)) / 2
                    if gain > growth.min_gain + 1e-12 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, f, t, left, right)
            return found

        leaves = [(best(np.ones(len(y), bool)), np.ones(len(y), bool))]
        splits = []
        while len(leaves) < growth.leaves and any(s for s, _ in leaves):
            at = max((i for i, (s, _) in enumerate(leaves) if s), key=lambda i: leaves[i][0][0])
            gain, f, t, left, right = leaves.pop(at)[0]
            splits.append((f, t, round(gain, 6)))
            leaves += [(best(left), left), (best(right), right)]
        if not splits:
            break
        for _, rows in leaves:
            margin[rows] -= growth.learning_rate * g[rows].sum() / (h[rows].sum() + growth.penalty)
        trees.append(sorted(splits))
    return 1 / (1 + np.exp(-margin)), trees


@pytest.mark.parametrize("growth", [Growth(4, 0.3, 6, 64, 3), Growth(3, 1.0, 3, 64, 1, penalty=2.0), Growth(2, 0.1, 31, 64, 10)])
def test_trees_equal_the_plain_ones(spark, growth):
    dice = random.Random(growth.leaves)
    x = np.array([[dice.randrange(12), dice.randrange(5) / 4, dice.random() < 0.5] for _ in range(160)], "f8")
    y = ((x[:, 0] > 6) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0))).astype("f8")
    y = np.where(np.array([dice.random() < 0.05 for _ in y]), 1 - y, y)
    w = np.array([dice.choice([1.0, 2.0]) for _ in y])
    rows = [(i, [float(v) for v in a], float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(rows, "k int, f array<double>, label double, weight double").withColumn("features", array_to_vector("f"))
    model = LeafwiseBoosting(**growth.__dict__).setParams(weightCol="weight").fit(df.repartition(3))
    likely, trees = plain_boost(x, y, w, growth)
    found = [sorted((f, t, round(g, 6)) for f, t, g in zip(tree.feature, tree.threshold, tree.gain) if f >= 0) for tree in model.trees]
    assert found == trees
    scored = {r["k"]: r for r in model.transform(df).collect()}
    assert [scored[k]["probability"][1] for k in range(len(y))] == pytest.approx(likely.tolist(), abs=1e-9)
    assert all(r["prediction"] == (r["probability"][1] > 0.5) for r in scored.values())
    assert sum(model.featureImportances.toArray()) == pytest.approx(1)


def test_equal_rows_are_one(spark, monkeypatch):
    """A tree asks about each different row once; rows are counted as many as they are."""
    growth = Growth(3, 0.5, 5, 64, 30)
    x = np.array([[i % 7, i % 3] for i in range(840)], "f8")
    y = (((x[:, 0] > 3) | (x[:, 1] > 1)) ^ (np.arange(840) % 5 == 0)).astype("f8")
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "f array<double>, label double").withColumn("features", array_to_vector("f"))
    asked, best = [], leafwise.best_splits
    monkeypatch.setattr(leafwise, "best_splits", lambda rows, growth: (asked.append(rows.count()), best(rows, growth))[1])
    model = LeafwiseBoosting(**growth.__dict__).fit(df)
    found = [sorted((f, t, round(g, 6)) for f, t, g in zip(tree.feature, tree.threshold, tree.gain) if f >= 0) for tree in model.trees]
    assert found == plain_boost(x, y, np.ones(840), growth)[1] and max(asked) <= 42


@pytest.mark.parametrize("growth", [Growth(2, 0.3, 6, 64, 3), Growth(4, 1.0, 3, 4, 1, penalty=2.0), Growth(3, 0.5, 31, 64, 20)])
def test_one_task_grows_the_same_trees(spark, monkeypatch, growth):
    dice = random.Random(growth.rounds)
    rows = []
    for _ in range(400):
        a, b, c = dice.randrange(9), dice.choice([0.0, 0.25, float("nan")]), dice.randrange(40) // 39 * 1.0
        rows.append(([float(a), b, c], float((a > 4) ^ (b == 0.25) ^ (dice.random() < 0.1)), dice.choice([1.0, 2.5])))
    df = spark.createDataFrame(rows, "f array<double>, label double, weight double").withColumn("features", array_to_vector("f"))
    fitted = [LeafwiseBoosting(cells, **growth.__dict__).setParams(weightCol="weight").fit(df) for cells in (0, 1200)]
    assert len(fitted[0].trees) == len(fitted[1].trees) > 1
    for one, other in zip(*(model.trees for model in fitted)):
        assert (one.feature, one.cut, one.threshold, one.left, one.right) == (other.feature, other.cut, other.threshold, other.left, other.right)
        assert one.value == pytest.approx(other.value, abs=1e-9) and one.gain == pytest.approx(other.gain, abs=1e-9)
    monkeypatch.setattr(leafwise, "best_splits", None)  # few cells need no Spark job for a split
    assert LeafwiseBoosting(1200, **growth.__dict__).setParams(weightCol="weight").fit(df.repartition(3)).trees


def test_odd_tables(spark, tmp_path):
    schema = "f array<double>, label double"
    one_kind = spark.createDataFrame([([1.0], 1.0)] * 30, schema).withColumn("features", array_to_vector("f"))
    model = LeafwiseBoosting(rounds=3).fit(one_kind)
    assert model.trees == [] and model.transform(one_kind).first()["prediction"] == 1.0
    nothing = LeafwiseBoosting().fit(one_kind.limit(0))
    assert nothing.trees == [] and nothing.start == 0.0
    gaps = [([float("nan") if i % 3 == 0 else float(i % 3)], float(i % 3 == 0)) for i in range(90)]
    missing = spark.createDataFrame(gaps, schema).withColumn("features", array_to_vector("f"))
    model = LeafwiseBoosting(rounds=5, learning_rate=1.0).fit(missing)
    assert all(r["prediction"] == r["label"] for r in model.transform(missing).collect())
    models.save_model(model, str(tmp_path / "m"))
    assert models.load_model(str(tmp_path / "m")) == model and isinstance(model, LeafwiseModel)


def test_edges(spark):
    df = spark.range(1000).select(F.array((F.col("id") % 7).cast("double"), F.col("id").cast("double"), F.lit(float("nan")), F.lit(3.0)).alias("features"))
    few, many, missing, same = bin_edges(df, 4, 16)
    assert few == [1, 2, 3, 4, 5, 6] and 12 <= len(many) <= 16 and missing == [] and same == []
