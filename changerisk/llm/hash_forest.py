"""Approximate nearest neighbours by cosine with a forest of hash prefixes.

Each tree gives a vector a hash string: the signs of ``BITS`` random projections. A tree is the
sorted array of its strings; a block of rows holds its part of every tree. A query descends every tree to the
longest prefix that any row shares with it and then ascends all trees together, one bit at a time,
until its candidates number ``share`` of all rows (at least ``LEAST``): the rows that share a prefix
of that length in some tree. Candidates are scored in double precision on the original vectors.

What makes this distributed:

* equal vectors are one node with its six smallest ids; more can never be among five neighbours
* a directory counts rows by tree and string (at most TREES * 2**BITS numbers, 5 MB): with it a
  query knows how far to ascend before any vector moves
* a row moves once, with its strings, to one block of at most about ``BLOCK`` rows, which sorts them
  by tree; a row found in several trees is scored once
* queries come to the blocks in groups of at most about ``BLOCK``, so a task's memory is bounded; rows
  move once for each group
* a block returns the best six for each of its queries, so what is merged does not grow with it

How many candidates are needed depends on the data: isotropic random vectors, where the nearest
is hardly nearer than the rest, need a large share for a recall of 0.9; clustered ones a small one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.runtime import freeze

TREES, BITS, SEED = 18, 16, 42

#: Candidates of a query, repeats in several trees included, as a share of all rows; and the least.
SHARE, LEAST = 0.8, 1_000

#: Rows of a block and queries of a group at most, blocks of a small table, queries of one product of
#: matrices, and what such a product may be off by.
BLOCK, SPREAD, TOGETHER, MARGIN = 16_384, 64, 256, 1e-9


def _planes(dimension: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimension, trees * bits))


def _vectors(column, kind: str) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    packed = list(column)
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype("f8")


def _tamed(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled where their squares would leave the range of doubles; cosines do not change."""
    most = np.abs(vectors).max(axis=1, keepdims=True, initial=0.0)
    return np.where((most > 1e150) | (most < 1e-150), vectors / np.where(most == 0, 1, most), vectors)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; equal rows give equal results."""
    norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return (a * b).sum(axis=1) / norms


def _valid(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, str, int]:
    """``id, vec`` (packed) of the rows that take part, the type of components, and the dimension."""
    element = vectors.schema[vector].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter("id is not null and v is not null").filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    dimension = sizes["size"] if sizes else 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            packed = [row.tobytes() for row in (flat + 0.0).astype(kind)]  # no negative zero
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], names=["id", "vec"])

    return rows.filter(F.size("v") == dimension).mapInArrow(pack, "id bigint, vec binary").distinct(), kind, dimension


class HashForest:
    """The forest over one table; ``key`` and ``vector`` name its columns.

    Rows without an id, and vectors that are null, zero, or hold a null or a number that is not
    finite, take no part. Neither do vectors whose length is not the most frequent one. Rows that
    repeat an id and a vector count once.
    """

    def __init__(self, vectors: DataFrame, key: str, vector: str, neighbours: int = 5, trees: int = TREES) -> None:
        self.spark, self.most, self.trees = vectors.sparkSession, neighbours + 1, trees
        rows, self.kind, self.dimension = _valid(vectors, key, vector)
        self.rows = freeze(rows)
        order = Window.partitionBy("vec").orderBy("id")
        first = self.rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= self.most)
        nodes = first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        self.nodes = freeze(self._hashed(nodes).withColumn("node", F.monotonically_increasing_id()))
        self.counts = self._directory()

    def _hashed(self, nodes: DataFrame) -> DataFrame:
        """Adds ``strings``: the hash string in each tree, as a number."""
        kind, dimension, trees = self.kind, self.dimension, self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = _planes(dimension, trees, BITS)
            values = 1 << np.arange(BITS - 1, -1, -1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                signs = _tamed(_vectors(batch.column("vec").to_pylist(), kind)) @ planes > 0
                strings = (signs.reshape(-1, trees, BITS) * values).sum(axis=2)
                columns = [batch.column("vec"), batch.column("ids"), pa.array(list(strings.astype("int32")), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec", "ids", "strings"])

        return nodes.mapInArrow(run, "vec binary, ids array<bigint>, strings array<int>")

    def _directory(self) -> np.ndarray:
        """Rows by tree and string; its size does not depend on the number of rows."""
        strings = self.nodes.select(F.posexplode("strings").alias("tree", "string"))
        found = strings.groupBy("tree", "string").agg(F.count("*").alias("n")).toPandas()
        counts = np.zeros((self.trees, 1 << BITS), "int64")
        counts[found["tree"].to_numpy("int64"), found["string"].to_numpy("int64")] = found["n"].to_numpy("int64")
        return counts

    def search(self, chosen: Column, share: float = SHARE, least: int = LEAST) -> DataFrame:
        """``query_id, rank, vec_id, score``: the nearest rows found for the rows ``chosen`` by ``id``.

        Nearest first, ties to the smaller id, the query's own row left out; fewer rows than asked
        for if there are no more. An empty table gives no rows.
        """
        trees, kind, most, counts = self.trees, self.kind, self.most, self.counts
        total = int(counts[0].sum())
        wanted = max(least, int(share * total))
        shared = self.spark.sparkContext.broadcast(counts)

        def ascend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = shared.value
            levels = [counts.reshape(trees, 1 << level, -1).sum(axis=2) for level in range(BITS + 1)]
            for batch in batches:
                if not len(batch):
                    continue
                strings = np.array(batch["strings"].tolist(), "int64").reshape(len(batch), trees)
                # From the longest prefix up, all trees at once, until there are enough candidates.
                level = np.zeros(len(batch), "int64")
                for length in range(BITS, 0, -1):
                    here = strings >> (BITS - length)
                    found = sum(levels[length][tree][here[:, tree]] for tree in range(trees))
                    level = np.where((level == 0) & (found >= wanted), length, level)
                yield pd.DataFrame({"node": batch["node"], "vec": batch["vec"], "strings": batch["strings"], "level": level})

        def score(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(rows) and len(queries):
                strings, vectors = np.array(rows["strings"].tolist(), "int64"), _tamed(_vectors(rows["vec"], kind))
                order = np.argsort(strings, axis=0, kind="stable")
                arrays = np.take_along_axis(strings, order, axis=0)
                nodes, firsts = rows["node"].to_numpy(), rows["least"].to_numpy()
                unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                for start in range(0, len(queries), TOGETHER):
                    chunk = queries.iloc[start : start + TOGETHER]
                    own, names = _tamed(_vectors(chunk["vec"], kind)), chunk["node"].to_numpy()
                    asked, rest = np.array(chunk["strings"].tolist(), "int64"), (BITS - chunk["level"].to_numpy())[:, None]
                    low = (asked >> rest) << rest
                    high = low + (1 << rest)
                    candidate = np.zeros((len(chunk), len(rows)), bool)
                    for tree in range(trees):
                        begin = np.searchsorted(arrays[:, tree], low[:, tree])
                        end = np.searchsorted(arrays[:, tree], high[:, tree])
                        for i in np.flatnonzero(end > begin):
                            candidate[i, order[begin[i] : end[i], tree]] = True
                    size = np.sqrt((own * own).sum(axis=1, keepdims=True))
                    near = np.where(candidate, (own / size) @ unit.T, -np.inf)
                    # Whatever may be among the best is scored: all rows that reach the last of them, ties included.
                    last = min(most, len(rows)) - 1
                    limit = -np.partition(-near, last, axis=1)[:, last, None] - MARGIN
                    reach = candidate & (near >= limit)
                    tied = reach.sum(axis=1) > 2 * most
                    which, at = np.nonzero(reach & ~tied[:, None])
                    exact = cosines(own[which], vectors[at])
                    found.append(pd.DataFrame({"query": names[which], "node": nodes[at], "least": firsts[at], "score": exact}))
                    for i in np.flatnonzero(tied):
                        at = np.flatnonzero(reach[i])
                        exact = cosines(np.broadcast_to(own[i], (len(at), own.shape[1])), vectors[at])
                        first = np.lexsort((firsts[at], -exact))[:most]
                        found.append(
                            pd.DataFrame({"query": names[i], "node": nodes[at[first]], "least": firsts[at[first]], "score": exact[first]})
                        )
            if not found:
                return pd.DataFrame({"query": [], "node": [], "least": [], "score": []})
            best = pd.concat(found).sort_values(["query", "score", "least"], ascending=[True, False, True])
            return best.groupby("query").head(most)

        asking = self.rows.filter(chosen).select(F.col("id").alias("query_id"), "vec")
        asked = self.nodes.join(asking.select("vec").distinct(), "vec", "left_semi").select("node", "strings", "vec")
        asked = freeze(asked.mapInPandas(ascend, "node bigint, vec binary, strings array<int>, level bigint"))
        blocks = -(-total // min(BLOCK, max(LEAST, total // SPREAD))) or 1
        groups = -(-asked.count() // BLOCK) or 1

        def every(n: int, name: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

        # A row is in one block, with its strings in all trees; queries come in groups, so no task has all of either.
        block, group = F.pmod("node", F.lit(blocks)).cast("int"), F.pmod("node", F.lit(groups)).cast("int")
        rows = self.nodes.select(
            block.alias("block"), every(groups, "group"), "node", F.col("ids")[0].alias("least"), "strings", "vec"
        )
        visits = asked.select(every(blocks, "block"), group.alias("group"), "node", "vec", "strings", "level")
        scored = rows.groupBy("block", "group").cogroup(visits.groupBy("block", "group"))
        scored = scored.applyInPandas(score, "query bigint, node bigint, least bigint, score double")

        pairs = scored.groupBy("query", "node", "least").agg(F.max("score").alias("score"))
        nearest = Window.partitionBy("query").orderBy(F.desc("score"), "least")
        pairs = pairs.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= most)
        listed = pairs.join(self.nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
        owners = asking.join(self.nodes.select("vec", F.col("node").alias("query")), "vec").select("query_id", "query")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        answer = owners.join(listed, "query").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
        return answer.filter(F.col("rank") < most).select("query_id", "rank", "vec_id", "score")
