"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. a text becomes the set of its shingle hashes; equal sets are one node
2. ``BANDS`` bands of ``ROWS`` minima over the set name the entries of a node; two sets of similarity
   s share none with probability (1 - s^5)^32, at most 3 in a million from 0.8 on
3. entries of few nodes list their pairs; members of larger ones are a crowd
4. inside the crowd an exact second filter decides who may meet (below), so unlike texts that share a
   passage never do
5. candidates are verified on the whole sets; components of the verified links are the groups

**Crowds.** Shingles of the crowd are counted, and each node orders its own from rare to frequent. If
two sets of n and m shingles share 0.8 of their union, they have 4(n + m)/9 in common. So at the first
shingle that they share, each must still have that many left: a node whose shingle has r left (itself
included) can meet sets of at most (9r - 4n)/4 shingles there. A node is listed under its shingle once
for every size class that it can still meet, and meets only nodes listed for its own class. What two
texts have for themselves is rare and comes first; only if it is less than a ninth of equally long
texts do frequent shingles bring them together. The filter loses no pair.

Sub-entries of few nodes list their pairs. In larger ones each node is first compared with the same
``HUBS`` nodes of the other side; most nodes are then in one component. Nodes still outside of it
are compared with all of the other side, in blocks: one row holds some dozens of sets of each side,
so sets do not travel once per pair. That last step costs (outsiders x members) comparisons, no
rows: texts on the very edge of similarity cannot be told apart for less without losing links.

Sets are large, so a second scan makes them for candidates only: their texts are marked in a bitmap
of fixed size, as in ``exact_dedup``. A false mark costs a set that no pair asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.llm.common import text_or_empty, texts_of
from changerisk.llm.components import components
from changerisk.llm.exact_dedup import _ROW, MARKS, _is_marked, _mark
from changerisk.runtime import freeze

#: Words of a shingle, and the least similarity of near copies.
WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 5
SEED = 42

#: Nodes of an entry up to which all their pairs are listed, and hubs of a side in larger ones.
FEW, HUBS = 16, 8

#: Ratio of neighbouring size classes; sets of a block, and shingles of a block of long sets.
CLASS, BLOCK, BLOCK_SHINGLES = 1.05, 64, 1 << 18

#: Shingles per step of the minima.
_CHUNK = 256
_DICE = np.random.default_rng(SEED)
_MASKS = _DICE.integers(0, 1 << 32, (BANDS * ROWS, 1), "u4")
_FACTORS = _DICE.integers(0, 1 << 32, (BANDS * ROWS, 1), "u4") | np.uint32(1)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles of a text, sorted; words and short texts as in ``simhash``."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, "u8")
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else [b" ".join(words)]
    total = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "u8", total))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def entries_of(hashes: np.ndarray) -> list[int]:
    """One number per band: a hash of its minima. An empty set has none."""
    if not len(hashes):
        return []
    low, least = hashes.astype("u4"), np.full(BANDS * ROWS, (1 << 32) - 1, "u4")
    for start in range(0, len(low), _CHUNK):
        least = np.minimum(least, ((low[start : start + _CHUNK] ^ _MASKS) * _FACTORS).min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes(), i) - (1 << 63) for i, band in enumerate(least.reshape(BANDS, ROWS))]


_SKETCH = T.StructType().add("node", T.LongType()).add("n", T.LongType()).add("entries", T.ArrayType(T.LongType()))


@F.pandas_udf(_SKETCH)
def _sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        found = []
        for text in batch:
            hashes = shingle_set(text)
            found.append((_node(hashes), len(hashes), entries_of(hashes)))
        yield pd.DataFrame(found, columns=["node", "n", "entries"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text) for text in texts_of(batch.column("raw"))]
        columns = [pa.array([_node(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "hashes"])


def _blocks_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` between the sets of ``lefts`` and those of ``rights``, one pair of blocks per row."""
    for batch in batches:
        found: list[tuple[int, int]] = []
        for row in range(batch.num_rows):
            lefts, rights = batch.column("lefts")[row].values, batch.column("rights")[row].values
            others = [np.frombuffer(x, "u8") for x in rights.field("hashes").to_pylist()]
            names = rights.field("node").to_numpy()
            sizes = np.array([len(x) for x in others])
            flat, starts = np.concatenate(others), np.cumsum(sizes) - sizes
            for node, raw in zip(lefts.field("node").to_pylist(), lefts.field("hashes").to_pylist()):
                own = np.frombuffer(raw, "u8")
                places = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                common = np.add.reduceat((own[places] == flat).astype("i8"), starts)
                near = (common / (len(own) + sizes - common) >= SIMILAR) & (names != node)
                found += [(node, other) for other in names[near].tolist()]
        columns = [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, n, shingle`` of each set, a set at a time."""
    for batch in batches:
        for node, raw in zip(batch.column("node").to_pylist(), batch.column("hashes").to_pylist()):
            hashes = np.frombuffer(raw, "i8")
            same = [pa.array(np.full(len(hashes), value), pa.int64()) for value in (node, len(hashes))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(hashes)], names=["node", "n", "shingle"])


def _keyed(docs: DataFrame, text: str, *columns: str) -> DataFrame:
    """``columns`` and the text as ``raw``, with the two numbers that the bitmap goes by."""
    rows = docs.select(*columns, text_or_empty(text).alias("raw"))
    return rows.withColumn("size", F.length("raw").cast("bigint")).withColumn("prefix", F.xxhash64("raw"))


def _candidate_sets(docs: DataFrame, text: str, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, hashes`` of the given nodes, from a scan of the texts that are marked."""
    marks = rows.join(nodes, "node", "left_semi").select(_mark().alias("mark"))
    marks = marks.select(F.expr(f"mark div {_ROW}").alias("slice"), F.pmod("mark", F.lit(_ROW)).alias("place"))
    bitmaps = freeze(marks.groupBy("slice").agg(F.bitmap_construct_agg("place").alias("bitmap")))
    texts = _keyed(docs, text).withColumn("slice", F.expr(f"pmod(xxhash64(size, prefix), {MARKS}) div {_ROW}"))
    texts = texts.join(F.broadcast(bitmaps), "slice", "left").filter(_is_marked()).select("raw")
    sets = texts.mapInArrow(_sets, "node bigint, hashes binary")
    return freeze(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def _class(size: Column) -> Column:
    return F.floor(F.log(size) / np.log(CLASS)).cast("int")


def _few_pairs(members: DataFrame, few: DataFrame) -> DataFrame:
    """Distinct pairs ``a, b`` of the entries of few nodes that may meet there."""
    members = members.join(few, "entry", "left_semi")
    x, y = members.alias("x"), members.alias("y")
    sides = (F.col("x.low") & F.col("y.high")) | (F.col("x.high") & F.col("y.low"))
    allowed = sides & (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
    pairs = x.join(y, (F.col("x.entry") == F.col("y.entry")) & (F.col("x.node") < F.col("y.node")) & allowed)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _sub_entries(crowd_sets: DataFrame) -> DataFrame:
    """``entry, node, n, most, low, high`` of the crowd: who may meet under a shingle, by size classes.

    ``most`` is the largest set that the node can meet there; ``low`` and ``high`` say whether it is of
    the lower or the higher class of the entry, which meet each other. Entries in which nobody meets
    anybody are left out.
    """
    rows = freeze(crowd_sets.mapInArrow(_shingle_rows, "node bigint, n bigint, shingle bigint"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1")
    node = Window.partitionBy("node")
    ranked = rows.join(counts, "shingle").select(
        "node",
        "n",
        "shingle",
        (F.count("*").over(node) + 1 - F.row_number().over(node.orderBy("texts", "shingle"))).alias("left"),
    )
    most = F.least(F.expr("(9 * left - 4 * n) div 4"), F.expr("5 * n div 4")).alias("most")
    ranked = ranked.select("node", "n", "shingle", most).filter("5 * most >= 4 * n")
    own, other = _class(F.col("n")), F.explode(F.sequence(_class(F.ceil(F.col("n") * 4 / 5)), _class(F.col("most"))))
    listed = ranked.select("node", "n", "shingle", "most", own.alias("own"), other.alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    sides = (F.col("own") == low).alias("low"), (F.col("own") == high).alias("high")
    listed = freeze(listed.select(F.xxhash64("shingle", low, high).alias("entry"), "node", "n", "most", *sides))
    sides = F.count_if("low").alias("lows"), F.count_if("high").alias("highs"), F.count("*").alias("nodes")
    met = listed.groupBy("entry").agg(*sides).filter("nodes > 1 and lows > 0 and highs > 0").select("entry")
    return freeze(listed.join(met, "entry", "left_semi"))


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Each node of an entry with the same few nodes of the other side."""
    hub = F.struct("node", "n", "most", "low", "high")
    picks = [F.min_by(hub, F.xxhash64("node", F.lit(i))).alias(f"hub{i}") for i in range(HUBS)]
    hubs = members.groupBy("entry", "low", "high").agg(*picks)
    hubs = hubs.select("entry", F.explode(F.array_distinct(F.array(*[f"hub{i}" for i in range(HUBS)]))).alias("hub"))
    met = members.join(hubs, "entry").filter("node <> hub.node and n <= hub.most and hub.n <= most")
    met = met.filter("(low and hub.high) or (high and hub.low)")
    return met.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the entries that hold several components, with the component of each as ``root``."""
    now = freeze(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    several = now.groupBy("entry").agg(F.min("root").alias("least"), F.max("root").alias("last")).filter("least <> last")
    return freeze(now.join(several.select("entry"), "entry", "left_semi"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among distinct pairs ``a, b``; the set of a node ``a`` travels once per block of its partners."""
    pairs = freeze(pairs)
    blocks = pairs.groupBy("a").agg(F.expr(f"count(*) div {BLOCK} + 1").alias("blocks"))
    pairs = pairs.join(blocks, "a").select("a", F.expr("pmod(xxhash64(b), blocks)").alias("block"), "b")
    rights = pairs.join(sets.withColumnRenamed("node", "b"), "b")
    rights = rights.groupBy("a", "block").agg(F.collect_list(F.struct(F.col("b").alias("node"), "hashes")).alias("rights"))
    lefts = pairs.select("a", "block").distinct().join(sets.withColumnRenamed("node", "a"), "a")
    lefts = lefts.select("a", "block", F.array(F.struct(F.col("a").alias("node"), "hashes")).alias("lefts"))
    return lefts.join(rights, ["a", "block"]).select("lefts", "rights").mapInArrow(_blocks_alike, "a bigint, b bigint")


def _outsider_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the nodes outside an entry's largest component with all of the entry, in blocks of sets."""
    roots = members.groupBy("entry", "root").agg(F.count("*").alias("nodes"), F.max("n").alias("n"))
    main = roots.groupBy("entry").agg(
        F.max_by("root", F.struct("nodes", "root")).alias("main"), F.sum("nodes").alias("nodes"), F.max("n").alias("longest")
    )
    per = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"{BLOCK_SHINGLES} div longest")))
    main = main.select("entry", "main", (F.floor(F.col("nodes") / per) + 1).alias("blocks"))
    placed = members.join(main, "entry")
    placed = placed.withColumn("block", F.expr("pmod(xxhash64(node, entry), blocks)")).join(sets, "node")
    member = F.struct("node", "hashes")
    rights = placed.groupBy("entry", "high", "block").agg(F.collect_list(member).alias("rights"))
    wanted = placed.filter("root <> main").groupBy("entry", F.col("low").alias("high"), "block")
    lefts = wanted.agg(F.collect_list(member).alias("lefts"))
    met = lefts.select("entry", "high", "lefts").join(rights.select("entry", "high", "rights"), ["entry", "high"])
    return met.select("lefts", "rights").mapInArrow(_blocks_alike, "a bigint, b bigint").distinct()


def _few_and_many(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of at most ``FEW`` nodes, and larger ones."""
    counts = freeze(members.groupBy("entry").agg(F.count("*").alias("nodes")))
    return counts.filter(F.col("nodes") <= FEW).select("entry"), counts.filter(F.col("nodes") > FEW).select("entry")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after ``links`` between nodes, of which ``roots`` knows some, are added."""
    for side in ("a", "b"):
        named = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        links = links.join(named, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    merged = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    merged = merged.select(F.col("node").alias("from"), F.col("root").alias("to"))
    alone = merged.select(F.col("from").alias("node"), F.col("to").alias("root")).join(roots, "node", "left_anti")
    moved = roots.join(merged, roots["root"] == merged["from"], "left").select("node", F.coalesce("to", "root").alias("root"))
    return freeze(moved.union(alone))


def near_copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, component_id``: the smallest id that a row is linked to, its own included.

    A text of fewer than five words is one shingle; texts without words are equal. Null texts are
    empty. A component of null ids only has a null id. Repeated rows give repeated rows.
    """
    rows = freeze(_keyed(docs, text, key).select(key, "size", "prefix", _sketch("raw").alias("s")))
    rows = rows.select(key, "size", "prefix", "s.node", "s.n", "s.entries")
    spread = rows.select("node", "n", F.explode("entries").alias("entry"))
    shared = spread.groupBy("entry").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    members = spread.join(shared.select("entry"), "entry", "left_semi").distinct()
    members = members.withColumn("most", F.expr("5 * n div 4")).withColumns({"low": F.lit(True), "high": F.lit(True)})
    members = freeze(members)
    sets = _candidate_sets(docs, text, rows, members.select("node").distinct())

    few, many = _few_and_many(members)
    pairs, crowded = _few_pairs(members, few), None
    if not many.isEmpty():
        crowd = members.join(many, "entry", "left_semi").select("node").distinct()
        members = _sub_entries(sets.join(crowd, "node", "left_semi"))
        few, many = _few_and_many(members)
        crowded = members.join(many, "entry", "left_semi")
        pairs = pairs.union(_few_pairs(members, few)).union(_hub_pairs(crowded)).distinct()
    roots = freeze(components(_verified(pairs, sets)))
    if crowded is not None:
        crowded = _open(crowded, roots)
        if not crowded.isEmpty():
            roots = _joined(roots, _outsider_links(crowded, sets))

    nodes = rows.groupBy("node").agg(F.min(key).alias("least"))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = freeze(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select(key, "node").join(named.join(least, "root").select("node", "component_id"), "node").select(key, "component_id")
