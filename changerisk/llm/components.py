"""Connected components of a graph given as links, without any part of it in the driver.

Alternating large-star and small-star steps: each joins nodes to the smallest neighbour known,
and the number of rounds grows with the logarithm of the longest chain. Each round is written
below the checkpoint folder, so that a lost executor costs no more than the round. A round takes
tasks by the number of its links, whatever the session's partitions: each task of each exchange
leaves files until the round is forgotten, and for few links these would be all it costs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.runtime import freeze

#: Tasks of a step of a round: some, and one more for every so many links.
_TASKS, _LINKS = 8, 100_000


def _unique(links: DataFrame, tasks: int) -> DataFrame:
    """Distinct links, made and left in few partitions."""
    return links.coalesce(tasks).distinct().coalesce(tasks)


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Larger neighbours of each node go to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return _unique(both.join(least, "a").filter("b > a").select(F.col("root").alias("a"), "b"), tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them; links are ``a < b``."""
    least = edges.groupBy("b").agg(F.min("a").alias("root"))
    moved = edges.join(least, "b")
    own = least.select(F.col("root").alias("a"), "b")
    moved = moved.filter("a <> root").select(F.col("root").alias("a"), F.col("a").alias("b"))
    return _unique(own.union(moved), tasks)


def components(links: DataFrame) -> DataFrame:
    """``node, root``: for each node of the links ``a, b`` the smallest node it is connected to.

    Order, repeats and loops of links do not matter; null ends do not count. Nodes without links
    to others are not listed.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = freeze(links.filter("a is not null and b is not null and a <> b").select(a, b).distinct())
    mark, tasks = None, _TASKS + edges.count() // _LINKS
    while True:
        edges = freeze(_small_star(_large_star(edges, tasks), tasks))
        # Done when every node hangs on a root: no root hangs on anything, no node hangs twice.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        mark = now
