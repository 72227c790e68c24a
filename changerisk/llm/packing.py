"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A sequence costs ``linear`` per token and ``quadratic`` per pair of tokens of one piece, as attention
inside documents does. Documents are taken in descending cost; each goes to the sequence of lowest
cost that has room for it, or, where none has, is cut to fill the one of lowest cost.

1. every text is tokenised once; its ids travel as packed integers from here on, not its text
2. a prefix sum over the written parts gives each document a place in one line of tokens
3. the line is cut into groups of ``GROUP`` full sequences; a document that lies across a border is
   cut there
4. each group is packed on its own, holding ``GROUP`` sequences of ids and no more

All sequences of a group are filled, so there is no padding. Only the last group is shorter: what it
has beyond full sequences goes to sequences whose lengths are powers of two, at most twelve for the
whole table, which need no padding either. A document longer than a sequence fills whole ones.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changerisk.llm.common import share_file, text_or_empty
from changerisk.llm.pieces import PieceEncoder
from changerisk.runtime import freeze

#: Full sequences packed together; tokens of a row on its way to its group.
GROUP, ROW_TOKENS = 64, 1 << 16

#: Rows of a batch that leaves a task.
_ROWS = 1_000


@dataclass(frozen=True)
class Cost:
    """Cost of a piece of n tokens: linear * n + quadratic * n * n."""

    linear: float = 1.0
    quadratic: float = 1 / 2048

    def of(self, tokens: int) -> float:
        return self.linear * tokens + self.quadratic * tokens * tokens


def capacities(tokens: int, size: int) -> list[int]:
    """Lengths of sequences that hold exactly so many tokens: full ones, then powers of two."""
    rest = tokens % size
    return [size] * (tokens // size) + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pack(lengths: list[int], room: list[int], cost: Cost) -> list[tuple[int, int, int, int, int]]:
    """``document, start, length, sequence, offset`` of each piece; ``room`` holds all tokens exactly.

    Equal documents are taken in the order given, equal sequences from the first on.
    """
    left, spent = np.array(room), np.zeros(len(room))
    waiting = [(-n, at, 0) for at, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    pieces = []
    while waiting:
        negative, at, start = heapq.heappop(waiting)
        n = -negative
        fits = left >= n
        place = int(np.argmin(np.where(fits if fits.any() else left > 0, spent, np.inf)))
        length = min(n, int(left[place]))
        pieces.append((at, start, length, place, room[place] - int(left[place])))
        left[place] -= length
        spent[place] += cost.of(length)
        if length < n:
            heapq.heappush(waiting, (length - n, at, start + length))
    return pieces


@lru_cache(maxsize=2)
def _encoder(content: bytes, kind: str) -> PieceEncoder:
    return PieceEncoder(Tokenizer.from_str(content.decode()), kind, spaced=False)


def _batches(rows: list[tuple], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(rows), _ROWS):
        columns = zip(names, zip(*rows[low : low + _ROWS]))
        arrays = [pa.array(column, pa.binary() if name == "ids" else pa.int64()) for name, column in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=list(names))


_RUNS = ("key", "slot", "place", "first", "n", "tokens", "ids")


def _tokenised(docs: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int, kind: str) -> DataFrame:
    """Runs of ids: of the document ``key`` with ``tokens`` ids those from ``first``, at ``place`` of the part ``slot``."""
    content = share_file(docs.sparkSession, tokenizer_path)
    size, end = np.dtype(kind).itemsize, np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, slot, place = _encoder(content.value, kind), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows: list[tuple] = []
            for name, value in zip(batch.column("key"), batch.column("text")):
                packed = encoder.packed(value.as_py()) + end
                tokens = len(packed) // size
                for first in range(0, tokens, ROW_TOKENS):
                    ids = packed[first * size : (first + ROW_TOKENS) * size]
                    rows.append((name.as_py(), slot, place + first, first, len(ids) // size, tokens, ids))
                place += tokens
            yield from _batches(rows, _RUNS)

    rows = docs.select(F.col(key).cast("bigint").alias("key"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{name} {'binary' if name == 'ids' else 'bigint'}" for name in _RUNS))


def _in_groups(runs: DataFrame, width: int, size: int) -> DataFrame:
    """``group, line, key, first, n, tokens, ids``: runs placed in one line of tokens and cut at the borders of groups."""
    totals = {row["slot"]: row["n"] for row in runs.groupBy("slot").agg(F.sum("n").alias("n")).collect()}  # a row per part
    bases = np.cumsum([0, *(totals.get(slot, 0) for slot in range(max(totals, default=0)))]).tolist()
    base = F.from_json(F.lit(json.dumps(bases)), "array<bigint>")[F.col("slot").cast("int")]
    runs = runs.withColumn("line", base + F.col("place"))
    groups = F.sequence(F.expr(f"line div {width}"), F.expr(f"(line + n - 1) div {width}"))
    runs = runs.withColumn("group", F.explode(groups))
    low = F.greatest(F.col("line"), F.col("group") * width)
    high = F.least(F.col("line") + F.col("n"), (F.col("group") + 1) * width)
    skipped, length = low - F.col("line"), high - low
    ids = F.substring("ids", (skipped * size + 1).cast("int"), (length * size).cast("int"))
    first = F.col("first") + skipped
    return runs.select("group", low.alias("line"), "key", first.alias("first"), length.alias("n"), "tokens", ids.alias("ids"))


_PIECES = ("key", "start", "length", "tokens", "sequence_id", "offset", "ids")


def _packed_group(rows: list[dict], size: int, kind: str, cost: Cost, group_size: int) -> list[tuple]:
    """Pieces of one group; runs of one document that follow each other are one document."""
    docs: list[dict] = []
    first_id = rows[0]["group"] * group_size
    for row in rows:
        if docs and row["first"] and row["first"] == docs[-1]["first"] + docs[-1]["n"]:
            docs[-1]["n"] += row["n"]
            docs[-1]["ids"] += row["ids"]
        else:
            docs.append(row)
    room = capacities(sum(row["n"] for row in docs), size)
    pieces = []
    for at, start, length, place, offset in pack([row["n"] for row in docs], room, cost):
        row = docs[at]
        ids = np.frombuffer(row["ids"], kind)[start : start + length].astype("<u4").tobytes()
        pieces.append((row["key"], row["first"] + start, length, row["tokens"], first_id + place, offset, ids))
    return pieces


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    vocabulary: int,
    size: int = 4096,
    key: str = "doc_id",
    text: str = "text",
    cost: Cost = Cost(),
) -> DataFrame:
    """``key, start, length, tokens, sequence_id, offset, ids`` of every piece.

    ``start`` counts the document's ids before the piece, ``tokens`` all of the document's, the end
    id included; ``offset`` is the place in the sequence; ``ids`` are little-endian unsigned 32-bit
    integers. A null or empty text is the end id alone. Every row is a document of its own, also if
    it repeats an id or has a null one; an empty table gives no pieces. ``size`` must be a power of
    two. The tokenizer file (1 to 2 MB) is broadcast.
    """
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    group_size = GROUP
    runs = freeze(_tokenised(docs, key, text, tokenizer_path, end_id, kind))
    placed = _in_groups(runs, group_size * size, np.dtype(kind).itemsize)
    placed = placed.repartition("group").sortWithinPartitions("group", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["group"] != rows[-1]["group"]:
                    yield from _batches(_packed_group(rows, size, kind, cost, group_size), _PIECES)
                    rows = []
                rows.append(row)
        if rows:
            yield from _batches(_packed_group(rows, size, kind, cost, group_size), _PIECES)

    schema = ", ".join(f"{name} {'binary' if name == 'ids' else 'bigint'}" for name in _PIECES)
    return placed.mapInArrow(run, schema).withColumnRenamed("key", key)
