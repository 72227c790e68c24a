"""Gradient-boosted trees that grow leaf by leaf: the split that gains most comes next.

Rows are binned once, and rows of equal bins, label and weight are one from then on. For a tree each row has a gradient and a hessian of the logistic loss, and the
candidates for splits are sums of both per (leaf, feature, bin): one grouped aggregate, whose best
split of each leaf comes back to the driver as one row. Rows of at most ``task_cells`` cells, as merged
rows often are, can be boosted by numpy in one task instead, split by split in the same way. Leaves are asked about in rounds, all new ones
at once, ahead of the order in which they are split; which splits a tree gets is decided as if they
had been asked about one by one. Leaf weights and gains are regularised::

    weight = -G / (H + penalty)        gain = (Gl²/(Hl + penalty) + Gr²/(Hr + penalty) - G²/(H + penalty)) / 2

A tree is some dozens of numbers; rows are scored by numpy over Arrow batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changerisk.runtime import freeze

#: Trees between two written states of the margins, and merged rows of a task.
_KEEP, _TASK_ROWS = 10, 50_000


@dataclass(frozen=True)
class Growth:
    """How trees grow: rounds, leaves of a tree, bins of a feature, and what a split must have."""

    rounds: int = 100
    learning_rate: float = 0.1
    leaves: int = 31
    max_bins: int = 255
    min_rows: int = 20
    min_hessian: float = 1e-3
    penalty: float = 0.0
    min_gain: float = 1e-6


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1. Values below ``threshold`` go left, missing ones right."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, threshold: float, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        """Turn a leaf into a node with two leaves; their numbers."""
        left, right = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.threshold[node], self.gain[node] = feature, cut, threshold, gain
        self.left[node], self.right[node] = left, right
        for value in values:
            for name, start in (("feature", -1), ("cut", 0), ("threshold", 0.0), ("left", 0), ("right", 0), ("gain", 0.0)):
                getattr(self, name).append(start)
            self.value.append(value)
        return left, right

    def leaf_of(self, rows: np.ndarray, cuts: bool) -> np.ndarray:
        """Leaf of each row of bins (``cuts``) or of values."""
        feature, left, right = (np.array(x) for x in (self.feature, self.left, self.right))
        limit = np.array(self.cut if cuts else self.threshold)
        at, every = np.zeros(len(rows), "i8"), np.arange(len(rows))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            below = rows[every, np.maximum(feature[at], 0)] < limit[at]
            at = np.where(inner, np.where(below, left[at], right[at]), at)


def bin_edges(rows: DataFrame, size: int, max_bins: int, features: str = "features") -> list[list[float]]:
    """Ascending edges per feature: its values but the least where they are few, else quantiles.

    Bin i holds values from edge i-1 on, below edge i.
    """
    shares = [i / max_bins for i in range(1, max_bins)]
    value = F.posexplode(features)
    cells = rows.select(value.alias("feature", "x")).filter("x is not null and not isnan(x)")
    found = cells.groupBy("feature").agg(
        F.percentile_approx("x", [0.0, *shares, 1.0], 10 * max_bins).alias("edges"), F.min("x").alias("least")
    )
    edges: list[list[float]] = [[] for _ in range(size)]
    for row in found.collect():  # a row per feature
        edges[row["feature"]] = sorted({x for x in row["edges"] if x > row["least"]})
    return edges


def _flat(batch: pa.Array, size: int) -> np.ndarray:
    return batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _binned(features: Column, edges: list[list[float]]) -> Column:
    """Bins of each row's values; missing values are in the last bin, after all others."""

    @F.arrow_udf("array<int>")
    def bins(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = _flat(batch, len(edges)).astype("f8")
            found = np.stack([np.searchsorted(edge, values[:, i], "right") for i, edge in enumerate(edges)], axis=1)
            found = np.where(np.isnan(values), np.array([len(edge) + 1 for edge in edges]), found).astype("i4")
            offsets = np.arange(len(values) + 1, dtype="i4") * len(edges)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

    return bins(features)


def _leaf(bins: Column, tree: Tree, size: int) -> Column:
    @F.arrow_udf("int")
    def leaf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(tree.leaf_of(_flat(batch, size), cuts=True).astype("i4"))

    return leaf(bins)


def _added(bins: Column, trees: list[Tree], size: int) -> Column:
    @F.arrow_udf("double")
    def added(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = _flat(batch, size)
            yield pa.array(sum(np.array(tree.value)[tree.leaf_of(rows, cuts=True)] for tree in trees))

    return added(bins)


def _merged(rows: DataFrame) -> DataFrame:
    """``bins, y, w, n`` for rows ``bins, y, w``: n equal rows are one of their whole weight, where rows are halved so at least."""
    facts = rows.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64("bins", "y", "w")).alias("kinds")).first()
    if 2 * facts["kinds"] > facts["rows"]:
        return rows.withColumn("n", F.lit(1).cast("bigint"))
    kinds = freeze(rows.groupBy("bins", "y", "w").agg(F.count("*").alias("n")))
    return kinds.coalesce(math.ceil(facts["kinds"] / _TASK_ROWS)).withColumn("w", F.col("w") * F.col("n"))


def best_splits(rows: DataFrame, growth: Growth) -> DataFrame:
    """Best split of each leaf of ``leaf, bins, n, g, h`` (sums over n rows): one row of leaf, feature, bin, gain and both sides' sums.

    Rows of the bins up to ``bin`` go left. Equal gains are decided by feature, then bin.
    """
    cells = rows.select("leaf", "n", "g", "h", F.posexplode("bins").alias("feature", "bin"))
    sums = cells.groupBy("leaf", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    every = Window.partitionBy("leaf", "feature")
    upto = every.orderBy("bin")
    for name in ("g", "h", "n"):
        sums = sums.withColumns({f"{name}_left": F.sum(name).over(upto), f"{name}_all": F.sum(name).over(every)})
    for name in ("g", "h", "n"):
        sums = sums.withColumn(f"{name}_right", F.col(f"{name}_all") - F.col(f"{name}_left"))

    def score(side: str) -> Column:
        return F.try_divide(F.col(f"g_{side}") * F.col(f"g_{side}"), F.col(f"h_{side}") + growth.penalty)

    gain = (score("left") + score("right") - score("all")) / 2
    sums = sums.withColumn("gain", gain)
    for side in ("left", "right"):
        sums = sums.filter((F.col(f"n_{side}") >= growth.min_rows) & (F.col(f"h_{side}") >= growth.min_hessian))
    order = F.struct("gain", -F.col("feature"), -F.col("bin"))
    row = F.struct("feature", "bin", "gain", "g_left", "h_left", "n_left", "g_right", "h_right", "n_right")
    return sums.filter(F.col("gain") > growth.min_gain).groupBy("leaf").agg(F.max_by(row, order).alias("s")).select("leaf", "s.*")


def _chosen(draft: Tree, splits: dict[int, dict | None], leaves: int) -> tuple[list[int], list[int]]:
    """Nodes in the order in which they are split, and leaves to split in the draft before more can be said."""
    open_, chosen = [0], []
    while len(chosen) < leaves - 1:
        able = [leaf for leaf in open_ if splits[leaf]]
        if not able:
            break
        best = max(able, key=lambda leaf: (splits[leaf]["gain"], -leaf))
        if draft.feature[best] < 0:
            return chosen, [leaf for leaf in able if draft.feature[leaf] < 0]
        chosen.append(best)
        open_.remove(best)
        open_ += [draft.left[best], draft.right[best]]
    return chosen, []


def _table_splits(rows: DataFrame, size: int, growth: Growth) -> Callable[[Tree, list[int]], dict[int, dict]]:
    """Best splits of leaves of a draft for rows ``bins, n, g, h``, by Spark."""

    def find(draft: Tree, asked: list[int]) -> dict[int, dict]:
        placed = rows.withColumn("leaf", _leaf(F.col("bins"), draft, size)).filter(F.col("leaf").isin(asked))
        return {row["leaf"]: row.asDict() for row in best_splits(placed, growth).collect()}  # a row per leaf

    return find


def _array_splits(bins: np.ndarray, sums: dict[str, np.ndarray], growth: Growth) -> Callable[[Tree, list[int]], dict[int, dict]]:
    """The same for arrays of bins and of ``n, g, h``, within a task."""

    def candidates(rows: np.ndarray, feature: int) -> Iterator[tuple[tuple, dict]]:
        at = bins[rows, feature]
        known = np.bincount(at) > 0
        s: dict[str, np.ndarray] = {}
        for name, values in sums.items():
            upto = np.cumsum(np.bincount(at, values[rows]))
            s[f"{name}_left"], s[f"{name}_right"], s[f"{name}_all"] = upto, upto[-1] - upto, upto[-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            left, right, every = (s[f"g_{side}"] ** 2 / (s[f"h_{side}"] + growth.penalty) for side in ("left", "right", "all"))
            gain = (left + right - every) / 2
        able = known & (gain > growth.min_gain)
        for side in ("left", "right"):
            able &= (s[f"n_{side}"] >= growth.min_rows) & (s[f"h_{side}"] >= growth.min_hessian)
        if able.any():
            bin_ = int(np.argmax(np.where(able, gain, -np.inf)))
            facts = {f"{name}_{side}": float(s[f"{name}_{side}"][bin_]) for name in sums for side in ("left", "right")}
            yield (gain[bin_], -feature), {"feature": feature, "bin": bin_, "gain": float(gain[bin_]), **facts}

    def find(draft: Tree, asked: list[int]) -> dict[int, dict]:
        leaf, found = draft.leaf_of(bins, cuts=True), {}
        for node in asked:
            rows = np.flatnonzero(leaf == node)
            able = [pair for feature in range(bins.shape[1]) for pair in candidates(rows, feature)] if len(rows) else []
            if able:
                found[node] = max(able, key=lambda pair: pair[0])[1]
        return found

    return find


def _grow(find: Callable[[Tree, list[int]], dict[int, dict]], edges: list[list[float]], growth: Growth) -> Tree:
    """One tree: a draft grows in rounds, the tree takes its best splits."""

    def split(tree: Tree, node: int, s: dict) -> tuple[int, int]:
        edge, values = edges[s["feature"]], []
        for g, h in ((s["g_left"], s["h_left"]), (s["g_right"], s["h_right"])):
            values.append(-growth.learning_rate * g / (h + growth.penalty) if h + growth.penalty else 0.0)
        threshold = edge[s["bin"]] if s["bin"] < len(edge) else math.inf
        return tree.split(node, s["feature"], s["bin"] + 1, threshold, s["gain"], (values[0], values[1]))

    draft, asked = Tree(), [0]
    splits: dict[int, dict | None] = {}
    while True:
        found = find(draft, asked)
        splits.update({leaf: found.get(leaf) for leaf in asked})
        chosen, waiting = _chosen(draft, splits, growth.leaves)
        if not waiting:
            break
        asked = [child for leaf in waiting for child in split(draft, leaf, splits[leaf])]
    tree, place = Tree(), {0: 0}
    for node in chosen:
        place[draft.left[node]], place[draft.right[node]] = split(tree, place[node], splits[node])
    return tree


def _boosted_in_task(rows: DataFrame, edges: list[list[float]], growth: Growth, start: float) -> list[Tree]:
    """All trees for rows ``bins, y, w, n`` that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if batch.num_rows]
        bins = np.concatenate([_flat(batch.column("bins"), len(edges)) for batch in parts])
        n, y, w = (np.concatenate([batch.column(name).to_numpy() for batch in parts]) for name in ("n", "y", "w"))
        margin = np.full(len(y), start)
        for _ in range(growth.rounds):
            likely = 1 / (1 + np.exp(-margin))
            tree = _grow(_array_splits(bins, {"n": n, "g": w * (likely - y), "h": w * likely * (1 - likely)}, growth), edges, growth)
            if len(tree.feature) == 1:
                return
            margin += np.array(tree.value)[tree.leaf_of(bins, cuts=True)]
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(asdict(tree))])], names=["tree"])

    found = rows.coalesce(1).select("bins", "n", "y", "w").mapInArrow(run, "tree string").collect()  # a row per tree
    return [Tree(**json.loads(row["tree"])) for row in found]


@dataclass
class LeafwiseModel:
    """A fitted ensemble: margin = start + the values of the trees' leaves."""

    start: float
    size: int
    trees: list[Tree]

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each feature in all gains."""
        total = np.zeros(self.size)
        for tree in self.trees:
            for feature, gain in zip(tree.feature, tree.gain):
                if feature >= 0:
                    total[feature] += gain
        return DenseVector(total / (total.sum() or 1.0))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (a vector of both classes) and ``prediction`` to rows with ``features``."""
        start, trees, size = self.start, self.trees, self.size

        @F.arrow_udf("double")
        def margin(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                rows = _flat(batch, size).astype("f8")
                yield pa.array(start + sum((np.array(t.value)[t.leaf_of(rows, cuts=False)] for t in trees), np.zeros(len(rows))))

        likely = 1 / (1 + F.exp(-margin(vector_to_array("features"))))
        scored = df.withColumn("_likely", likely)
        scored = scored.withColumn("probability", array_to_vector(F.array(1 - F.col("_likely"), F.col("_likely"))))
        return scored.withColumn("prediction", (F.col("_likely") > 0.5).cast("double")).drop("_likely")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as one line of JSON, replacing an older one."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/leafwise")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LeafwiseModel:
        raw = json.loads(spark.read.text(f"{path}/leafwise").first()["value"])
        return LeafwiseModel(raw["start"], raw["size"], [Tree(**tree) for tree in raw["trees"]])


class LeafwiseBoosting:
    """Estimator for 0/1 labels on a vector column; one task boosts rows whose number times features is at most ``task_cells``."""

    def __init__(self, task_cells: int = 0, **growth) -> None:
        self.growth, self.task_cells = Growth(**growth), task_cells
        self.columns = {"featuresCol": "features", "labelCol": "label", "weightCol": None}

    def setParams(self, **columns: str) -> LeafwiseBoosting:
        self.columns.update(columns)
        return self

    def fit(self, df: DataFrame) -> LeafwiseModel:
        """Rows without a label do not count; without any row the model says one half."""
        growth, names = self.growth, self.columns
        weight = F.col(names["weightCol"]) if names["weightCol"] else F.lit(1.0)
        rows = df.select(vector_to_array(names["featuresCol"]).alias("features"), F.col(names["labelCol"]).cast("double").alias("y"), weight.alias("w"))
        rows = rows.filter("y is not null")
        facts = rows.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("ones"), F.max(F.size("features")).alias("size")).first()
        if not facts["w"]:
            return LeafwiseModel(0.0, facts["size"] or 0, [])
        share = min(max(facts["ones"] / facts["w"], 1e-9), 1 - 1e-9)
        start, size = math.log(share / (1 - share)), facts["size"]
        edges = bin_edges(rows, size, growth.max_bins)
        rows = _merged(freeze(rows.select(_binned(F.col("features"), edges).alias("bins"), "y", "w")))
        if rows.count() * size <= self.task_cells:
            return LeafwiseModel(start, size, _boosted_in_task(rows, edges, growth, start))
        rows = rows.withColumn("margin", F.lit(start))
        trees: list[Tree] = []
        new: list[Tree] = []
        for _ in range(growth.rounds):
            margin = F.col("margin") + _added(F.col("bins"), new, size) if new else F.col("margin")
            likely = 1 / (1 + F.exp(-F.col("now")))
            now = rows.withColumn("now", margin)
            steps = now.select("bins", "n", (F.col("w") * (likely - F.col("y"))).alias("g"), (F.col("w") * likely * (1 - likely)).alias("h"))
            tree = _grow(_table_splits(steps, size, growth), edges, growth)
            if len(tree.feature) == 1:
                break
            trees.append(tree)
            new.append(tree)
            if len(new) == _KEEP:
                rows, new = freeze(now.select("bins", "n", "y", "w", (F.col("margin") + _added(F.col("bins"), new, size)).alias("margin"))), []
        return LeafwiseModel(start, size, trees)
