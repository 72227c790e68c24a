"""Prefix trie of conversations, with the totals of every subtree, as a node table.

A node is a sequence of turns that some conversation starts with; the root is the empty one.

1. turns become digests; a sequence is named by sums of the digests of (place, turn) over its turns,
   so that prefix sums name all prefixes of a conversation, however long, block by block
2. distinct names are the nodes; each is checked to stand for one parent and one last turn
3. paths are cut into blocks of depths and dealt to shards. A shard enumerates its distinct
   names, gives each a slot by a minimal perfect hash (verified against the stored name), scatters
   the weights into flat arrays, and adds them up through an array of parent slots, deepest first
4. what the shards found for a node is added up; a node's own weight counts once, on the path of its
   smallest member

No key is followed through one task: a conversation with a third of all turns is as many blocks as
it is long, and carries what its deeper blocks weigh in a small table; a turn that a third of all
conversations start with is one slot in each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changerisk.operators.ordering import with_position
from changerisk.runtime import freeze


@dataclass(frozen=True)
class Sizes:
    """Depths of a block, rows of a shard's table, bytes of a run of ids, and parts that copies of a parent are dealt to.

    They bound the memory of a task; the nodes do not depend on them.
    """

    block: int = 4_096
    shard_rows: int = 200_000
    run_bytes: int = 1 << 16
    salts: int = 16


_PARTS = ("s1", "s2", "s3", "s4")


class SlotTable:
    """Minimal perfect hash of distinct 16-byte names: levels of bits, ranks of set bits are slots.

    On each level the names left are hashed into twice as many places; those alone in their place
    are settled there, the others go on. ``slots`` compares each name with the one stored.
    """

    def __init__(self, names: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []
        self.stored = np.zeros((len(names), 2), "u8")
        left, settled = names, 0
        while len(left):
            size, level = 2 * len(left) + 1, len(self.levels)
            places = self._places(left, level, size)
            alone = np.bincount(places, minlength=size) == 1
            ranks = np.where(alone, np.cumsum(alone) - 1 + settled, -1)
            self.levels.append((size, ranks))
            mine = ranks[places] >= 0
            self.stored[ranks[places[mine]]] = left[mine]
            settled += int(alone.sum())
            left = left[~mine]

    @staticmethod
    def _places(names: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (names[:, 0] ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
            mixed = (mixed ^ (mixed >> np.uint64(32)) ^ names[:, 1]) * np.uint64(0xC4CEB9FE1A85EC53)
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype("i8")

    def slots(self, names: np.ndarray) -> np.ndarray:
        """Slot of each name; a name that is not in the table raises."""
        found = np.full(len(names), -1, "i8")
        for level, (size, ranks) in enumerate(self.levels):
            open_ = np.flatnonzero(found < 0)
            if not len(open_):
                break
            found[open_] = ranks[self._places(names[open_], level, size)]
        if (found < 0).any() or (self.stored[found] != names).any():
            raise RuntimeError("a name has no slot of its own")
        return found


def subtree_sums(
    names: np.ndarray, parents: np.ndarray, depths: np.ndarray, weights: np.ndarray, block: int
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, and the sums of the rows' weights over each one's subtree.

    Names and parents are rows of two 64-bit words. Rows whose depth is a multiple of ``block`` pass
    nothing on; every other row's parent must be among the names.
    """
    table = SlotTable(np.unique(names, axis=0))
    slots, n = table.slots(names), len(table.stored)
    totals = np.zeros((n, weights.shape[1]), "i8")
    np.add.at(totals, slots, weights)
    depth, parent = np.zeros(n, "i8"), np.full(n, -1, "i8")
    depth[slots] = depths
    inner = depths % block != 0
    parent[slots[inner]] = table.slots(parents[inner])
    order = np.argsort(-depth, kind="stable")
    order = order[parent[order] >= 0]
    bounds = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, bounds):
        np.add.at(totals, parent[level], totals[level])
    return table.stored, totals


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes over from the first of its hundred."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(6)).cast("bigint")


def _turns(rows: DataFrame, block: int) -> DataFrame:
    """``conv, ordinal, turn, points`` of each row: its place from 0, and digest and length of its turn."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.col("turn").alias("at"),
        digest.alias("turn"),
        F.length(text).cast("bigint").alias("points"),
    )
    placed, _ = with_position(turns, [F.col("conv"), F.col("at").asc_nulls_first(), F.col("turn")])
    placed = placed.withColumn("block", F.expr(f"pos div {block}"))
    firsts = placed.groupBy("conv", "block").agg(F.min("pos").alias("first"))
    firsts = firsts.withColumn("first", F.min("first").over(Window.partitionBy("conv")))
    placed = placed.join(firsts, ["conv", "block"])
    return freeze(placed.select("conv", (F.col("pos") - F.col("first")).alias("ordinal"), "block", "turn", "points"))


def _rebuilt(turns: DataFrame) -> DataFrame:
    """``conv, depth, turn, points, last``: each rebuilt conversation, its root included, one row per depth."""
    counts = freeze(turns.groupBy("conv", "block").agg(F.count("*").alias("rows")))
    convs = counts.groupBy("conv").agg(F.sum("rows").alias("own"))
    convs = convs.withColumns({"most": shared_turns(F.col("conv")), "donor": F.col("conv") - F.col("conv") % 100})
    donors = convs.select(F.col("conv").alias("donor"), F.col("own").alias("given"))
    convs = convs.join(donors, "donor", "left").withColumn("shared", F.least("most", F.coalesce("given", F.lit(0))))
    convs = convs.withColumn("total", F.col("shared") + F.greatest(F.col("own") - F.col("most"), F.lit(0)))
    convs = freeze(convs.select("conv", "donor", "most", "shared", "total"))

    last = (F.col("depth") == F.col("total")).alias("last")
    roots = convs.selectExpr("conv", "0L as depth", "cast(null as binary) as turn", "0L as points", "total")
    lent = turns.filter("ordinal < 6 and conv % 100 = 0").select(F.col("conv").alias("donor"), "ordinal", "turn", "points")
    lent = convs.join(lent, "donor").filter("ordinal < shared").withColumn("depth", F.col("ordinal") + 1)
    facts = counts.join(convs, "conv").select("conv", "block", "most", "shared", "total")
    own = turns.join(facts, ["conv", "block"]).filter("ordinal >= most")
    own = own.withColumn("depth", F.col("shared") + F.col("ordinal") - F.col("most") + 1)
    columns = ("conv", "depth", "turn", "points", "total")
    return roots.union(lent.select(*columns)).union(own.select(*columns)).select("conv", "depth", "turn", "points", last)


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth, *sums).cast("binary")))


def _paths(rebuilt: DataFrame, block: int) -> DataFrame:
    """``conv, depth, block, node, parent, turn, points, last``: prefix names by sums inside blocks and over blocks."""
    ones = [F.xxhash64("turn", "depth", F.lit(1)), F.xxhash64("depth", "turn", F.lit(2))]
    halves = [half for one in ones for half in (F.shiftrightunsigned(one, 32), one.bitwiseAND(0xFFFFFFFF))]
    halves = [F.when(F.col("depth") > 0, half).otherwise(0).alias(name) for name, half in zip(_PARTS, halves)]
    rows = rebuilt.withColumn("block", F.expr(f"depth div {block}")).select("*", *halves)
    rows = freeze(rows)
    across = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "block").agg(*[F.sum(name).alias(name) for name in _PARTS])
    carried = totals.select("conv", "block", *[F.coalesce(F.sum(name).over(across), F.lit(0)).alias(f"{name}_before") for name in _PARTS])
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(name).over(inside).alias(f"{name}_sum") for name in _PARTS]
    rows = rows.select("*", *sums).join(carried, ["conv", "block"])
    upto = [F.col(f"{name}_sum") + F.col(f"{name}_before") for name in _PARTS]
    before = [total - F.col(name) for total, name in zip(upto, _PARTS)]
    parent = F.when(F.col("depth") > 0, _name(F.col("depth") - 1, before))
    node = _name(F.col("depth"), upto)
    return freeze(rows.select("conv", "depth", "block", node.alias("node"), parent.alias("parent"), "turn", "points", "last"))


def _nodes(paths: DataFrame) -> DataFrame:
    """``node, parent, depth, conv_id, n_convs, points``: distinct names, each proved to be one sequence."""
    same = [F.min("parent").eqNullSafe(F.max("parent")), F.min("turn").eqNullSafe(F.max("turn")), F.min("depth") == F.max("depth")]
    nodes = paths.groupBy("node").agg(
        F.min("parent").alias("parent"),
        F.min("depth").alias("depth"),
        F.min("conv").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("points").alias("points"),
        (same[0] & same[1] & same[2]).alias("same"),
    )
    checked = F.when(F.col("same"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two sequences have one name")))
    nodes = nodes.withColumn("n_convs", checked).drop("same")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    return freeze(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def _words(column: pa.Array) -> np.ndarray:
    """16-byte binaries as rows of two 64-bit words; nulls as zeros."""
    return np.frombuffer(b"".join(x or bytes(16) for x in column.to_pylist()), "u8").reshape(-1, 2)


def _flush(parts: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    names, parents = _words(table.column("node")), _words(table.column("parent"))
    weights = np.stack([table.column(name).to_numpy() for name in ("leaf", "saved")], axis=1)
    names, totals = subtree_sums(names, parents, table.column("depth").to_numpy(), weights, block)
    used = (totals != 0).any(axis=1)
    raw = names[used].tobytes()
    found = [raw[i : i + 16] for i in range(0, len(raw), 16)]
    columns = [pa.array(found, pa.binary()), pa.array(totals[used, 0]), pa.array(totals[used, 1])]
    return pa.RecordBatch.from_arrays(columns, names=["node", "n_leaves", "saved_tokens"])


def _shard_sums(sizes: Sizes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``node, n_leaves, saved_tokens`` of whole blocks that arrive one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            # A shard ends where a block does: before the last row of the batch that starts one.
            starts = np.flatnonzero(batch.column("depth").to_numpy() % sizes.block == 0)
            if rows >= sizes.shard_rows and len(starts):
                kept.append(batch.slice(0, int(starts[-1])))
                yield _flush(kept, sizes.block)
                kept, rows = [], 0
                batch = batch.slice(int(starts[-1]))
            kept.append(batch)
            rows += batch.num_rows
        if rows:
            yield _flush(kept, sizes.block)

    return run


def _totals(paths: DataFrame, nodes: DataFrame, sizes: Sizes) -> DataFrame:
    """``node, n_leaves, saved_tokens`` over the subtree of each node."""
    own = nodes.select(
        F.col("conv_id").alias("conv"),
        "depth",
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("points")).alias("saved"),
    )
    rows = paths.select("conv", "depth", "block", "node", "parent").join(own, ["conv", "depth"], "left")
    rows = freeze(rows.fillna(0, ["leaf", "saved"]))
    blocks = rows.groupBy("conv", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.max("depth").alias("depth"))
    deeper = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    below = blocks.select("conv", "depth", F.sum("leaf").over(deeper).alias("leaf_below"), F.sum("saved").over(deeper).alias("saved_below"))
    rows = rows.join(below.filter("leaf_below is not null"), ["conv", "depth"], "left").select(
        "conv",
        "block",
        "depth",
        "node",
        "parent",
        (F.col("leaf") + F.coalesce("leaf_below", F.lit(0))).alias("leaf"),
        (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved"),
    )
    dealt = rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "depth")
    sums = dealt.drop("conv", "block").mapInArrow(_shard_sums(sizes), "node binary, n_leaves bigint, saved_tokens bigint")
    return sums.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _parents(nodes: DataFrame, salts: int) -> DataFrame:
    """``node, parent_conv_id``: smallest member of the parent of each node but the root.

    Along the path of one conversation that is mostly the conversation itself; only where a branch
    begins the parent is looked up, its copies dealt to ``salts`` parts.
    """
    inner = nodes.filter("parent is not null").select("node", "parent", "conv_id", (F.col("depth") - 1).alias("depth"))
    same = nodes.select("conv_id", "depth", F.lit(True).alias("same"))
    inner = freeze(inner.join(same, ["conv_id", "depth"], "left"))
    heads = inner.filter("same is null").select("node", "parent", F.pmod(F.xxhash64("node"), F.lit(salts)).alias("salt"))
    wanted = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    wanted = wanted.join(heads.select("parent").distinct(), "parent", "left_semi")
    wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    found = heads.join(wanted, ["parent", "salt"]).select("node", "parent_conv_id")
    return inner.filter("same").select("node", F.col("conv_id").alias("parent_conv_id")).union(found)


def _joined_ids(run_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``node, first, ids``: comma-joined ids of one node in runs of about ``run_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, 0, [], 0
        for batch in batches:
            done: list[tuple] = []
            for name, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist()):
                if ids and (name != node or size > run_bytes):
                    done.append((node, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    node, first = name, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if done:
                yield _runs(done)
        if ids:
            yield _runs([(node, first, ",".join(ids))])

    return run


def _runs(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.string())
    arrays = [pa.array(column, kind) for column, kind in zip(zip(*done), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["node", "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, ends_sha256`` of runs that come in order; a node's digest is fed run by run."""
    node, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if name == node:
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((node, digest.hexdigest()))
            node, digest = name, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def _ends(paths: DataFrame, run_bytes: int) -> DataFrame:
    """``node, ends_sha256`` of the ids, in numeric order, of the conversations that end at a node."""
    ends = paths.filter("last").select("node", "conv")
    runs = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    runs = runs.mapInArrow(_joined_ids(run_bytes), "node binary, first bigint, ids string")
    runs = runs.repartition("node").sortWithinPartitions("node", "first")
    return runs.mapInArrow(_hashed_ids, "node binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """A row per node of the trie of the rebuilt conversations of ``conv_id, turn, role, text``.

    ``node`` (hex name), ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the
    root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` (over the subtree), and
    ``ends_sha256`` of the ids of the conversations that end there.

    Conversation c is rebuilt from the first ``shared_turns(c)`` turns of conversation c - c % 100
    and its own turns after as many. Turns are ordered by turn, null first; rows of one turn by the
    digest of role and text; repeated rows are turns of their own. Null roles and texts are empty.
    Rows with a null id belong to no conversation and are left out. An empty table has no nodes.
    """
    paths = _paths(_rebuilt(_turns(rows, sizes.block)), sizes.block)
    nodes = _nodes(paths)
    found = nodes
    for facts in (_parents(nodes, sizes.salts), _totals(paths, nodes, sizes), _ends(paths, sizes.run_bytes)):
        found = found.join(facts, "node", "left")
    return found.select(
        F.lower(F.hex("node")).alias("node"),
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
