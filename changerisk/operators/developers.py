"""Distinct developers before a commit, from sets that are carried forward from block to block.

Developers have dense numbers. The developers of a file are a set of numbers while they are few, and
a bitmap from ``LISTED`` on. Positions are cut into blocks:

1. per file, first touches are added up in order; where a file is looked up in a block, its set at
   the start of the block is written, once for all its lookups
2. per block, the sets at its start, the first touches inside it and the lookups are walked in the
   order of positions; the sets of a commit's files are united and counted

So no pair of a commit and a developer is ever listed: a file with a million developers is an eighth
of a megabyte for each block that looks it up. A task holds one set in the first step, and the sets
of one block's files in the second; a file has as many rows as it has developers and blocks.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.operators.ordering import with_position
from changerisk.runtime import freeze

#: Developers from which a bitmap is kept, and positions of a block.
LISTED, BLOCK = 1_024, 1 << 15

_FILE = ["project", "file"]

# Order of what happens at one place: bits at the start, then lookups, then touches.
_START, _LOOKUP, _TOUCH = 0, 1, 2


def first_touches(touches: DataFrame) -> DataFrame:
    """``project, file, number, since``: dense number of each developer of a file, and their first position there."""
    known = touches.filter("author is not null").groupBy(*_FILE, "author").agg(F.min("pos").alias("since"))
    people = known.groupBy("project", "author").agg(F.min("since").alias("since"))
    numbered, _ = with_position(people, [F.col(c) for c in ("project", "since", "author")], "number")
    numbered = numbered.select("project", "author", "number")
    return known.join(numbered.hint("merge"), ["project", "author"]).select(*_FILE, "number", "since")


@dataclass
class Developers:
    """A growing set of numbers; a bitmap as soon as it is large."""

    few: set[int] = field(default_factory=set)
    many: int = 0

    def add(self, number: int) -> None:
        if self.many:
            self.many |= 1 << number
            return
        self.few.add(number)
        if len(self.few) >= LISTED:
            self.many, self.few = _bitmap(self.few), set()

    def packed(self) -> tuple[bool, bytes]:
        """Whether the bytes are a bitmap, and the bytes: else 32-bit numbers."""
        if self.many:
            return True, self.many.to_bytes((self.many.bit_length() + 7) // 8, "little")
        return False, array("i", self.few).tobytes()

    @staticmethod
    def unpacked(many: bool, raw: bytes) -> Developers:
        return Developers(many=int.from_bytes(raw, "little")) if many else Developers(set(memoryview(raw).cast("i")))


def _bitmap(numbers: set[int]) -> int:
    bits = bytearray(max(numbers) // 8 + 1)
    for number in numbers:
        bits[number >> 3] |= 1 << (number & 7)
    return int.from_bytes(bits, "little")


def united(sets: list[Developers]) -> int:
    """How many developers are in any of the sets."""
    few, many = set(), 0
    for one in sets:
        few |= one.few
        many |= one.many
    if not many:
        return len(few)
    return (many | _bitmap(few)).bit_count() if few else many.bit_count()


def _running_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``project, file, block, many, raw`` where asked; rows come by project, file and block, questions first."""
    current, known = None, Developers()
    for batch in batches:
        found: list[tuple] = []
        for project, file, block, number in zip(*(batch.column(name).to_pylist() for name in (*_FILE, "block", "number"))):
            if (project, file) != current:
                current, known = (project, file), Developers()
            if number is not None:
                known.add(number)
            elif known.few or known.many:
                found.append((project, file, block, *known.packed()))
        if found:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*_FILE, "block", "many", "raw"])


def _counted(found: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(column, kind) for column, kind in zip(zip(*found), (pa.string(), pa.string(), pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["project", "commit_id", "ndev"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``project, commit_id, ndev``; rows come by block, position and kind."""
    names = ("block", "pos", "kind", *_FILE, "commit_id", "many", "raw", "number")
    files: dict[tuple, Developers] = {}
    now, asked, sets = None, None, []
    for batch in batches:
        found: list[tuple] = []
        for block, pos, kind, project, file, commit, many, raw, number in zip(*(batch.column(n).to_pylist() for n in names)):
            if asked is not None and (block, pos, kind) != now:
                found.append((*asked, united(sets)))
                asked, sets = None, []
            if now is not None and block != now[0]:
                files = {}
            now = (block, pos, kind)
            if kind == _START:
                files[project, file] = Developers.unpacked(many, raw)
            elif kind == _TOUCH:
                files.setdefault((project, file), Developers()).add(number)
            else:
                asked = (project, commit)
                if (project, file) in files:
                    sets.append(files[project, file])
        if found:
            yield _counted(found)
    if asked is not None:
        yield _counted([(*asked, united(sets))])


def distinct_developers(lookups: DataFrame, touches: DataFrame, block: int = BLOCK) -> DataFrame:
    """``project, commit_id, ndev``: developers with a first touch of any of a commit's files before the commit.

    ``lookups``: project, commit_id, file, pos; ``touches``: project, file, author, pos. Positions
    are unique to commits. Unknown authors do not count.
    """
    first = freeze(first_touches(touches)).withColumn("block", F.expr(f"since div {block}"))
    lookups = lookups.select(*_FILE, "commit_id", "pos", F.expr(f"pos div {block}").alias("block"))

    place = [*_FILE, "block"]
    asked = lookups.select(*place).distinct().select(*place, F.lit(None).cast("bigint").alias("number"))
    events = asked.union(first.select(*place, "number")).repartition(*_FILE)
    events = events.sortWithinPartitions(*place, F.col("number").asc_nulls_first())
    starts = events.mapInArrow(_running_sets, "project string, file string, block bigint, many boolean, raw binary")

    no_commit, no_number = "cast(null as string) as commit_id", "cast(null as bigint) as number"
    no_set = "cast(null as boolean) as many", "cast(null as binary) as raw"
    rows = starts.selectExpr("block", "-1L as pos", f"{_START} as kind", *_FILE, no_commit, "many", "raw", no_number)
    rows = rows.union(lookups.selectExpr("block", "pos", f"{_LOOKUP} as kind", *_FILE, "commit_id", *no_set, no_number))
    rows = rows.union(first.selectExpr("block", "since as pos", f"{_TOUCH} as kind", *_FILE, no_commit, *no_set, "number"))
    rows = rows.repartition("block").sortWithinPartitions("block", "pos", "kind")
    return rows.mapInArrow(_counts, "project string, commit_id string, ndev bigint")
