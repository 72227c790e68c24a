"""Near duplicates by SimHash: fingerprints, links at two or fewer differing bits, components.

Links are found with deletion-variant signatures. A fingerprint is cut into two halves, so that of
any two fingerprints at distance two or less one half differs by at most one bit. For each half
and each of its 32 bits the index holds the half with that bit wild: halves that differ in one
bit meet where that bit is wild, equal halves meet everywhere. An equality grouping brings
candidates together and their whole distance is verified.

No group is expanded into pairs. Equal fingerprints are one node from the start. An index entry of
two nodes is one candidate pair. The nodes of a more crowded entry are linked exactly and without
pairs: two fingerprints are at distance two or less if and only if some word is at distance one
or less from both, so each such node emits the 65 words around it and every word links the nodes
it reaches to the smallest of them. Work is at most 64 + 65 rows for each distinct fingerprint,
however the copies are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.llm.components import components
from changerisk.llm.common import text_or_empty
from changerisk.runtime import broadcast_if_small, freeze

SEED = 42
BITS = 64
#: Shingles hashed at a time, so that a long text needs no more memory than a short one.
_CHUNK = 65_536


def fingerprint_of(text: str, width: int = 3, seed: int = SEED) -> int:
    """SimHash of the word shingles of one text, each bit decided by over half of the hashes.

    Words are what ASCII white space leaves after A-Z become small; shingles are ``width`` words
    joined by spaces, repeats included. Fewer words make one shingle; no words give zero.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
        total = len(words) - width + 1
    ones = np.zeros(BITS, "int64")
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, _CHUNK):
        n = min(_CHUNK, total - start)
        hashes = np.fromiter((digest(next(shingles), seed) for _ in range(n)), ">u8", n)
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        bits = np.fromiter((fingerprint_of(text) for text in batch), "u8", len(batch))
        yield pd.Series(bits.view("i8"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, bits``: one fingerprint per row, as a signed 64-bit number. Null texts are empty."""
    return docs.select(F.col(key), _fingerprints(text_or_empty(text)).alias("bits"))


def _halves() -> list[Column]:
    """The 64 one-wildcard variants of ``bits``: (half and wild bit, half without that bit)."""
    low, high = F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("bits", 32)
    return [
        F.struct(F.lit(32 * i + bit).alias("slot"), half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).alias("rest"))
        for i, half in enumerate((low, high))
        for bit in range(32)
    ]


def links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``bits`` that join all at distance two or less.

    Two fingerprints are in one component of the result exactly if a chain of such distances
    connects them; every link is itself such a distance or joins two of them through a third node.
    """
    variants = nodes.select("bits", F.explode(F.array(*_halves())).alias("v")).select("bits", "v.slot", "v.rest")
    entries = variants.groupBy("slot", "rest").agg(
        F.count("*").alias("n"), F.min("bits").alias("a"), F.max("bits").alias("b")
    )
    entries = freeze(entries.filter("n > 1"))
    pairs = entries.filter("n = 2").select("a", "b").distinct()
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)

    crowded = broadcast_if_small(entries.filter("n > 2").select("slot", "rest"))
    members = variants.join(crowded, ["slot", "rest"], "left_semi").select("bits").distinct()
    around = F.array(F.col("bits"), *[F.col("bits").bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(BITS)])
    reached = members.select("bits", F.explode(around).alias("word"))
    hubs = reached.groupBy("word").agg(F.count("*").alias("n"), F.min("bits").alias("a"), F.max("bits").alias("b"))
    hubs = hubs.filter("n > 1")
    # A word that reaches two nodes is a link; one that reaches more links each of them to the smallest.
    two = hubs.filter("n = 2").select("a", "b")
    more = reached.join(hubs.filter("n > 2").select("word", "a"), "word").filter("bits <> a")
    return pairs.union(two).union(more.select("a", F.col("bits").alias("b"))).distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, bits, component_id``: the smallest id that a row is linked to, its own included.

    Rows with null ids are fingerprinted; a component of only such rows has a null id. Repeated
    rows give repeated rows. An empty table gives no rows.
    """
    rows = freeze(fingerprints(docs, key, text))
    nodes = freeze(rows.groupBy("bits").agg(F.min(key).alias("least")))
    groups = components(links(nodes.select("bits")))
    joined = nodes.join(groups, nodes["bits"] == groups["node"], "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("bits", "component_id")
    return rows.join(named, "bits").select(key, "bits", "component_id")
