"""Main text of HTML pages by nearest-URL page differencing.

1. a page is read into lines that its own markup puts in an article, in boilerplate, or in neither
2. pages are ordered by host and URL path; each is paired with the neighbour of its host that
   shares the longest path prefix
3. the lines of the two are aligned by a longest common subsequence; lines on it are the template
   of the site rather than the text of the page

Markup is believed where it speaks. Of a page with an article element, that element is the text,
and no line of it is deleted for being quoted elsewhere. Of a page without one, the undecided lines
are the text, less those shared with the partner. A partner that shares nearly all of them
(``COPY``) may be a copy of the page or have the same large template. Then only lines that stand on
at least ``TEMPLATE`` different pages of the host are template; what the two alone share stays.

Pairing never gathers a host: rows get a position in one global order, and windows run over
fixed blocks of positions, each with the row before and after it. They carry line hashes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.llm.html_lines import ARTICLE, BOILERPLATE, lines_of
from changerisk.operators.ordering import with_position
from changerisk.runtime import freeze

#: Share of the undecided characters of a page from which its partner may be a copy.
COPY = 0.8
#: Different pages of a host that show a line of such a page to be template. Equal pages are one.
TEMPLATE = 3

#: Positions of one window.
_BLOCK = 4_096


def url_host(url: Column) -> Column:
    """Host of a URL in small letters; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    """Segments of a URL's path, without empty ones, query and fragment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda part: part != "")


def common_lines(own: np.ndarray, other: np.ndarray) -> list[int]:
    """Positions in ``own`` of a longest common subsequence of two arrays of line hashes.

    Lines that the other lacks cannot be on it and are left out first. Rows of the table are kept
    as the bits of one integer each: bit j of row i is 0 where column j adds to the length.
    """
    here, there = np.isin(own, other), np.isin(other, own)
    places, rows, columns = np.flatnonzero(here), own[here].tolist(), other[there].tolist()
    if not rows:
        return []
    masks: dict[int, int] = {}
    for j, value in enumerate(columns):
        masks[value] = masks.get(value, 0) | (1 << j)
    full = (1 << len(columns)) - 1
    state, table = full, []
    for value in rows:
        hit = state & masks[value]
        state = ((state + hit) | (state - hit)) & full
        table.append(state)
    i, j, found = len(rows), len(columns), []
    while i and j:
        if table[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not table[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append(int(places[i]))
    return found[::-1]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _shared(own: pd.Series, other: pd.Series) -> pd.Series:
    empty = np.empty(0, "int64")
    return pd.Series([common_lines(a, empty if b is None else b) for a, b in zip(own, other)])


def _read_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, url, hashes, bare``: a hash of each line of a page, and whether none is an article's."""
    for batch in batches:
        pages = [lines_of(page.as_py()) for page in batch.column("html")]
        hashes = [[xxhash.xxh64_intdigest(text) - (1 << 63) for text, _ in lines] for lines in pages]
        bare = [all(mark != ARTICLE for _, mark in lines) for lines in pages]
        columns = [batch.column("key"), batch.column("url"), pa.array(hashes, pa.list_(pa.int64())), pa.array(bare, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "url", "hashes", "bare"])


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, page_id, url, marks, packed``: a byte for each line, and the compressed lines that are no boilerplate."""
    pack = zstandard.ZstdCompressor().compress
    for batch in batches:
        marks, packed = [], []
        for page in batch.column("html"):
            lines = lines_of(page.as_py())
            marks.append(bytes(mark for _, mark in lines))
            packed.append(pack("\n".join(text for text, mark in lines if mark != BOILERPLATE).encode("utf-8", "replace")))
        columns = [batch.column(n) for n in ("key", "page_id", "url")] + [pa.array(marks, pa.binary()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "page_id", "url", "marks", "packed"])


def main_text(marks: bytes, lines: list[str], shared: set[int], template: set[int]) -> str:
    """Text of a page from the marks of all its lines, its lines that are no boilerplate, and the
    places of the lines that its partner shares and of those among them that more pages have.
    """
    places = [i for i, mark in enumerate(marks) if mark != BOILERPLATE]
    article = [line for i, line in zip(places, lines) if marks[i] == ARTICLE]
    if article:
        return "\n".join(article)
    own = [line for i, line in zip(places, lines) if i not in shared]
    if sum(map(len, own)) <= (1 - COPY) * sum(map(len, lines)):
        own = [line for i, line in zip(places, lines) if i not in template]
    return "\n".join(own)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, sizes, common = [], [], []
        for marks, packed, shared, template in zip(*(batch.column(n) for n in ("marks", "packed", "shared", "template"))):
            marks, text, shared = marks.as_py(), unpack(packed.as_py()).decode(), shared.as_py() or []
            lines = text.split("\n") if text else []
            texts.append(main_text(marks, lines, set(shared), set(template.as_py() or [])))
            sizes.append(len(marks))
            common.append(len(shared))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(common, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_lines", "n_shared"])


def partners(lines: DataFrame) -> DataFrame:
    """``key, hashes, other``: each page's line hashes and those of its nearest neighbour, or null."""
    url = F.coalesce("url", F.lit(""))
    rows = lines.select("key", url_host(url).alias("host"), url_path(url).alias("path"), "hashes")
    placed, _ = with_position(rows, [F.col("host"), F.col("path"), F.col("key")])
    block = F.expr(f"pos div {_BLOCK}")
    around = F.array(block, F.expr(f"(pos - 1) div {_BLOCK}"), F.expr(f"(pos + 1) div {_BLOCK}"))
    spread = placed.withColumn("own", block).withColumn("block", F.explode(F.array_distinct(around)))
    order = Window.partitionBy("block").orderBy("pos")
    sides = spread
    for name, move in (("before", F.lag), ("after", F.lead)):
        sides = sides.withColumn(name, move(F.struct("host", "path", "hashes")).over(order))

    def depth(side: str) -> Column:
        """Path segments shared with a neighbour of the same host; -1 if there is no such neighbour."""
        path = F.col(f"{side}.path")
        same = F.zip_with("path", path, lambda a, b: F.coalesce(a == b, F.lit(False)))
        first = F.array_position(same, False)
        return F.when(F.col(f"{side}.host") == F.col("host"), F.when(first == 0, F.size(same)).otherwise(first - 1)).otherwise(-1)

    sides = sides.filter("own = block").withColumn("b", depth("before")).withColumn("a", depth("after"))
    nearest = F.when((F.col("b") < 0) & (F.col("a") < 0), None).when(F.col("b") >= F.col("a"), F.col("before.hashes")).otherwise(
        F.col("after.hashes")
    )
    return sides.select("key", "hashes", nearest.alias("other"))


def template_lines(hashed: DataFrame, shared: DataFrame) -> DataFrame:
    """``key, template``: of pages without an article, the shared places whose lines are on ``TEMPLATE`` pages of the host."""
    host = url_host(F.coalesce("url", F.lit("")))
    asked = hashed.filter("bare").join(shared, "key").select("key", "url", "hashes", F.explode("shared").alias("place"))
    asked = asked.select("key", "place", F.xxhash64(host, F.expr("hashes[place]")).alias("line"))
    shown = hashed.select(host.alias("host"), F.xxhash64("hashes").alias("page"), F.explode(F.array_distinct("hashes")).alias("hash"))
    shown = shown.select("page", F.xxhash64("host", "hash").alias("line")).join(asked.select("line"), "line", "left_semi")
    often = shown.distinct().groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= TEMPLATE)
    return asked.join(often.select("line"), "line").groupBy("key").agg(F.collect_list("place").alias("template"))


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_lines, n_shared`` for every row of ``page_id, url, html``.

    Blocks of the text are joined by line feeds. A null or empty page has an empty text; a null or
    unusual URL has an empty host, and is paired within that. Rows that repeat an id have their own
    results. ``n_lines`` counts all lines, ``n_shared`` those on the common subsequence.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).withColumn("key", F.xxhash64("page_id", "url", "html"))
    # Hashes first and texts later: pages are read twice, so that texts are shuffled once, compressed.
    hashed = rows.mapInArrow(_read_hashes, "key bigint, url string, hashes array<bigint>, bare boolean").dropDuplicates(["key"])
    hashed = freeze(hashed)
    shared = freeze(partners(hashed).select("key", _shared("hashes", "other").alias("shared")))
    shared = shared.join(template_lines(hashed, shared), "key", "left")
    lines = rows.mapInArrow(_read_lines, "key bigint, page_id bigint, url string, marks binary, packed binary")
    schema = "page_id bigint, url string, text string, n_lines int, n_shared int"
    texts = lines.join(shared, "key").mapInArrow(_assemble, schema)
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_lines", "n_shared")
