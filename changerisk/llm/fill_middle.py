"""Fill-in-middle transformation of whole texts with ``pyarrow.compute``, one Arrow batch at a time.

A text of n code points is cut at two drawn places into prefix, middle and suffix, and written in
one of three forms::

    plain   text
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

The draws are digests of the document's id, so a lost task draws the same again. A text that is
empty or holds a mark stays plain, so the marks of an output can be told from its text and the text
is rebuilt exactly.

Each batch is a column pipeline: texts are split into lists of units, the lists are flattened with
the index of their text, units get ordinals, each role's units are filtered and rebuilt into lists,
and the lists are joined into pieces, the pieces into outputs. Texts are taken in runs of at most
``RUN_BYTES``, longer ones in several parts, so that the units of one run are all that is in memory
besides the batch and its output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.llm.common import text_or_empty

#: Marks before prefix, suffix and middle (fixed values of this format).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of text whose units are handled at once.
RUN_BYTES = 1 << 20

_DRAWS = ("draw_1", "draw_2", "draw_3", "draw_4")
_FORMS = np.array(["plain", "psm", "spm"])


@dataclass(frozen=True)
class Rates:
    """Percentages: texts that are transformed, and those of them that are written suffix first."""

    transformed: int = 90
    suffix_first: int = 20


def draws(key: str, seed: int) -> list[Column]:
    """Four reproducible numbers of 32 bits for an id; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(name) for i, name in enumerate(_DRAWS)]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_string array."""
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, "i8"), np.empty(0, "u1")
    places = np.frombuffer(offsets, "i8")[texts.offset : texts.offset + len(texts) + 1]
    return places, np.frombuffer(data, "u1") if data is not None else np.empty(0, "u1")


def split_units(texts: pa.Array) -> pa.Array:
    """``list<string>`` of the code points of each text of a large_string array."""
    places, data = _bytes_of(texts)
    low, high = int(places[0]), int(places[-1])
    starts = np.flatnonzero((data[low:high] & 0xC0) != 0x80)
    lists = np.searchsorted(starts, places - low)
    offsets = np.append(starts, high - low).astype("i8")
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[low:high]))
    return pa.LargeListArray.from_arrays(pa.array(lists, pa.int64()), units)


def cut_pieces(texts: pa.Array, first: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each text.

    ``first`` is the ordinal of a text's first unit, ``cuts`` the two ordinals at which middle and
    suffix start.
    """
    lists = split_units(texts)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    starts = lists.offsets.to_numpy()
    ordinals = np.arange(len(units)) - starts[parents] + first[parents]
    roles = (ordinals >= cuts[0][parents]).astype("i1") + (ordinals >= cuts[1][parents])
    pieces = []
    for role in range(3):
        mine = roles == role
        bounds = np.concatenate([[0], np.cumsum(np.bincount(parents[mine], minlength=len(texts)))])
        rebuilt = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pc.filter(units, pa.array(mine)))
        pieces.append(pc.binary_join(rebuilt.cast(pa.list_(pa.large_string())), pa.scalar("", pa.large_string())))
    return pieces


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, int]]:
    """``row, low, high``: byte ranges of at most ``RUN_BYTES`` that start at code points and cover each text."""
    places, data = _bytes_of(texts)
    for row in range(len(texts)):
        low, end = int(places[row]), int(places[row + 1])
        while end - low > RUN_BYTES:
            high = low + RUN_BYTES
            while (data[high] & 0xC0) == 0x80:
                high -= 1
            yield row, low, high
            low = high
        yield row, low, end


def _runs(texts: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
    """Parts of different texts, as many at a time as ``RUN_BYTES`` hold."""
    run, size = [], 0
    for part in _parts(texts):
        if run and (part[0] == run[-1][0] or size + part[2] - part[1] > RUN_BYTES):
            yield run
            run, size = [], 0
        run.append(part)
        size += part[2] - part[1]
    if run:
        yield run


def _counts(texts: pa.Array) -> np.ndarray:
    return pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype("i8")


def _pieces(texts: pa.Array, cuts: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of all texts of a batch, run by run."""
    _, data = _bytes_of(texts)
    found: list[list[pa.Array]] = [[], [], []]
    owners: list[int] = []
    seen = np.zeros(len(texts), "i8")
    for run in _runs(texts):
        rows = np.array([row for row, _, _ in run])
        bounds = np.array([run[0][1], *(high for _, _, high in run)], "i8")
        own = pa.LargeStringArray.from_buffers(len(run), pa.py_buffer(bounds), pa.py_buffer(data))
        first = seen[rows]
        for role, piece in enumerate(cut_pieces(own, first, cuts[:, rows])):
            found[role].append(piece)
        np.add.at(seen, rows, _counts(own))
        owners += rows.tolist()
    if len(owners) == len(texts):
        return [pa.concat_arrays(pieces) for pieces in found]
    bounds = np.searchsorted(np.array(owners), np.arange(len(texts) + 1))
    joined = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.concat_arrays(pieces)) for pieces in found]
    return [pc.binary_join(lists, pa.scalar("", pa.large_string())) for lists in joined]


def transform_batch(batch: pa.RecordBatch, rates: Rates) -> pa.RecordBatch:
    """``key, n, form, prefix_chars, middle_chars, output`` of a batch ``key, text, draw_1 .. draw_4``."""
    texts = batch.column("text").cast(pa.large_string())
    n = _counts(texts)
    one, two, three, four = (batch.column(name).to_numpy(zero_copy_only=False) for name in _DRAWS)
    marked = [pc.match_substring(texts, mark).to_numpy(zero_copy_only=False) for mark in (PREFIX, SUFFIX, MIDDLE)]
    plain = (n == 0) | np.logical_or.reduce(marked) | (three % 100 >= rates.transformed)
    forms = np.where(plain, 0, np.where(four % 100 < rates.suffix_first, 2, 1))
    cuts = np.sort(np.stack([one % (n + 1), two % (n + 1)]), axis=0)

    outputs = texts
    if not plain.all():
        rows = np.flatnonzero(~plain)
        prefix, middle, suffix = _pieces(texts.take(pa.array(rows)), cuts[:, rows])
        mark = [pa.scalar(m, pa.large_string()) for m in (PREFIX, SUFFIX, MIDDLE, "")]
        psm = pc.binary_join_element_wise(mark[0], prefix, mark[1], suffix, mark[2], middle, mark[3])
        spm = pc.binary_join_element_wise(mark[1], suffix, mark[0], prefix, mark[2], middle, mark[3])
        outputs = pc.replace_with_mask(texts, pa.array(~plain), pc.if_else(pa.array(forms[rows] == 2), spm, psm))
    columns = {
        "key": batch.column("key"),
        "n": pa.array(n),
        "form": pa.array(_FORMS[forms].tolist(), pa.string()),
        "prefix_chars": pa.array(cuts[0], mask=plain),
        "middle_chars": pa.array(cuts[1] - cuts[0], mask=plain),
        "output": outputs.cast(pa.string()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rates: Rates = Rates()
) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every row.

    ``n`` counts code points; the last two counts are null for plain texts. A null text is an empty
    text, and empty texts are plain. Rows with one id are cut by the same draws; a null id draws
    like an empty one. Every row gives one row, other columns are not looked at, and an empty
    table gives no rows. A text may have as many bytes as a cell of Spark, 2 GB with its marks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield transform_batch(batch, rates)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"), *draws(key, seed))
    schema = f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def restore(output: str = "output", form: str = "form") -> Column:
    """The text that an output of a form was made from."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.split(F.expr(f"substring({output}, {len(first) + 1})"), second, 2)
        rest = F.split(body[1], MIDDLE, 2)
        return body[0], rest[0], rest[1]

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
