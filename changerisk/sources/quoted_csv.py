"""CSV files with line breaks inside quoted cells, read by as many tasks as the files have splits.

Spark reads such files whole (``multiLine``), one task a file, as a line break alone does not say
whether it ends a record. Here files are read as lines, which can be split anywhere:

1. quotes are counted per split; the parity of all splits before says whether a split starts inside
   a quoted cell
2. each split is read again with that knowledge; its lines are put together to records on the way,
   without a shuffle
3. only records that cross splits are put together by a shuffle: at most two fragments per split

Quotes inside cells must be doubled (RFC 4180), and cells that hold quotes must be quoted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_READ = {"header": True, "multiLine": True, "escape": '"'}

# Kinds of a text: a whole record, lines of a record that began in an earlier split, the begin of
# one that goes on in a later split.
_WHOLE, _REST, _BEGIN = 0, 1, 2

_PARTS = "file string, block bigint, kind int, header boolean, returns boolean, text string"

# Spark's parser takes U+FFFF for the end of a record, so it is parsed in disguise.
_END, _MASK = "\uffff", "\ue000"


class _Split:
    """What is open in the split that is being read."""

    def __init__(self, file: str, block: int, inside: bool, returns: bool) -> None:
        self.file, self.block, self.parity, self.returns = file, block, int(inside), returns
        self.open = _REST if inside else None
        self.lines: list[str] = []
        self.header = block == 0 and not inside

    def take(self, lines: pa.Array, found: list[tuple]) -> None:
        """Add lines; records that they complete go to ``found``."""
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        before = (self.parity + np.concatenate([[0], np.cumsum(quotes)])) % 2
        self.parity = int(before[-1])
        values, starts = lines.to_pylist(), np.flatnonzero(before[:-1] == 0).tolist()
        low = 0
        for start in starts:
            self.lines += values[low:start]
            self.close(found)
            self.open, low = _BEGIN, start
        self.lines += values[low:]

    def close(self, found: list[tuple], whole: bool = True) -> None:
        """The open text is complete, or at the end of the split goes on in the next one."""
        if self.open is not None and (self.lines or self.open == _REST):
            text = "\n".join(self.lines)
            kind = _WHOLE if self.open == _BEGIN and whole else self.open
            if kind != _WHOLE or text != ("\r" if self.returns else ""):
                found.append((self.file, self.block, kind, self.header and self.open == _BEGIN, self.returns, text))
                self.header = self.header and self.open != _BEGIN
        self.lines = []


def _put_together(kinds: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts of the given kinds out of lines ``file, block, inside, returns, value`` in the order of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            found: list[tuple] = []
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
            changes = [i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]]
            for low, high in zip([0, *changes], [*changes, len(files)]):
                if split is None or (files[low], blocks[low]) != (split.file, split.block):
                    if split is not None:
                        split.close(found, split.parity == 0)
                    facts = [batch.column(name)[low].as_py() for name in ("inside", "returns")]
                    split = _Split(files[low], int(blocks[low]), *facts)
                split.take(batch.column("value").slice(low, high - low), found)
            yield from _texts(found, kinds)
        if split is not None:
            found = []
            split.close(found, split.parity == 0)
            yield from _texts(found, kinds)

    return run


def _texts(found: list[tuple], kinds: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    found = [row for row in found if row[2] in kinds]
    if found:
        types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
        arrays = [pa.array(column, kind) for column, kind in zip(zip(*found), types)]
        yield pa.RecordBatch.from_arrays(arrays, names=["file", "block", "kind", "header", "returns", "text"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return lines.select(*place, "value")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``text, header``: every record of the files as one text, and whether it is the first of its file.

    Records of a file end with "\\r\\n" if its first line does. Empty lines outside of cells are no records.
    Order is that of the files within a task.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"), F.first(F.endswith("value", F.lit("\r"))).alias("returns"))
    upto = Window.partitionBy("file").orderBy("block")
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(earlier) % 2 == 1, F.lit(False))
    splits = splits.withColumns({"inside": inside, "returns": F.first("returns").over(upto)}).filter("inside or returns")
    # One number for each split that starts inside a cell or has "\r\n": 16 bytes for 128 MB of text.
    splits = F.broadcast(splits.select(F.xxhash64("file", "block").alias("split"), "inside", "returns"))
    lines = lines.withColumn("split", F.xxhash64("file", "block")).join(splits, "split", "left")
    lines = lines.select("file", "block", *[F.coalesce(name, F.lit(False)).alias(name) for name in ("inside", "returns")], "value")

    whole = lines.mapInArrow(_put_together((_WHOLE,)), _PARTS)
    parts = lines.mapInArrow(_put_together((_REST, _BEGIN)), _PARTS)
    # A rest belongs to the last begin before it in its file; of one block the rest comes first.
    upto = Window.partitionBy("file").orderBy("block", "kind")
    begins = F.last(F.when(F.col("kind") == _BEGIN, F.col("block")), ignorenulls=True).over(upto)
    origin = parts.select("file", "block", "kind").withColumn("origin", begins)
    parts = parts.join(origin, ["file", "block", "kind"])
    pieces = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
    crossing = parts.groupBy("file", "origin", "returns").agg(pieces.alias("pieces"), F.bool_or("header").alias("header"))
    crossing = crossing.select(F.array_join("pieces.text", "\n").alias("text"), "header", "returns")
    records = whole.select("text", "header", "returns").union(crossing)
    return records.select(F.when(F.col("returns"), F.regexp_replace("text", r"\r\z", "")).otherwise(F.col("text")).alias("text"), "header")


def read_quoted_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, empty_texts: bool = False
) -> DataFrame:
    """A CSV table with header lines and quoted cells, like ``spark.read.csv(header, multiLine, escape='"')``.

    Without a ``schema`` all columns are strings, named by the header. Rows are those of the
    ``multiLine`` reader, cells with quotes and line breaks included; only their order may differ,
    and in files with "\\r\\n" line ends that reader changes such a break inside a cell to "\\n", this
    one keeps it. With ``empty_texts`` a quoted cell of no characters is an empty text, and only one that is not
    quoted is missing; else both are.
    """
    reader = spark.read.options(**_READ)
    if schema is not None:
        reader = reader.schema(schema)
    schema = reader.csv(path).schema
    records = csv_records(spark, path).filter("not header")
    options = {"escape": '"', "multiLine": "true", "lineSep": "\n", "charToEscapeQuoteEscaping": '"'}
    if empty_texts:
        options["nullValue"] = uuid.uuid4().hex  # stands for cells without quotes and characters; no text is equal to it
    ddl = ", ".join(f"`{field.name.replace('`', '``')}` {field.dataType.simpleString()}" for field in schema)
    text = _replaced(F.col("text"), (_MASK, _MASK + "a"), (_END, _MASK + "b"))
    rows = records.select(F.from_csv(text, ddl, options).alias("row")).select("row.*")
    texts = [field.name for field in schema if isinstance(field.dataType, T.StringType)]
    names = {name: F.col("`" + name.replace("`", "``") + "`") for name in texts}
    return rows.withColumns({name: _replaced(cell, (_MASK + "b", _END), (_MASK + "a", _MASK)) for name, cell in names.items()})


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
