"""Token ids as flat binary files with 64-bit document offsets, written and read by Spark tasks.

Format, in one folder:

``<part>.bin``  ids of the part's documents, one after the other, little-endian unsigned integers
                of 2 or 4 bytes (the smallest that holds the vocabulary and the end id)
``<part>.off``  little-endian unsigned 64-bit: one offset per document and a last one, in ids,
                counted from the start of the part
``<part>.key``  little-endian signed 64-bit: the document's id; ``NO_KEY`` for a null id
manifest        one row per part: position, files, documents, ids, and the part's base, which is
                the prefix sum of the ids of the parts before it

Documents are in ascending id order: a range partitioning deals them to the parts, a sort orders
each part. The base of a part is only known when all parts are written, so offsets stay local and
readers add the base. Files of failed or repeated task attempts have other names and are in no
manifest. Memory per task: one Arrow batch, 16 bytes per document of the part, and a bounded memo.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changerisk.llm.common import share_file, shuffle_partitions, text_or_empty
from changerisk.llm.pieces import PieceEncoder

#: Key of a document whose id is null.
NO_KEY = -(2**63)

_MANIFEST = "part int, name string, docs bigint, ids bigint"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or as a URI."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@lru_cache(maxsize=2)
def _encoder(content: bytes, kind: str) -> PieceEncoder:
    return PieceEncoder(Tokenizer.from_str(content.decode()), kind, spaced=False)


@dataclass
class TokenFiles:
    """A written folder: its parts in order, with the base of each."""

    spark: SparkSession
    folder: str
    kind: str
    parts: list[Row]

    def documents(self) -> DataFrame:
        """``doc_id, start, n_tokens, ids_crc32`` read back from the files, one task per part.

        ``start`` counts the ids of all documents before; the crc is that of the ids as
        little-endian unsigned 32-bit integers. Local files are memory-mapped; of files in an
        object store a document's range is read.
        """
        folder, kind = self.folder, self.kind
        size = np.dtype(kind).itemsize

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, path = _place(folder)
            for batch in batches:
                for part in batch.to_pylist():
                    stem = f"{path}/{part['name']}"
                    if isinstance(system, fs.LocalFileSystem):
                        ids = np.memmap(f"{stem}.bin", kind, "r") if part["ids"] else np.empty(0, kind)
                        take = lambda a, b, ids=ids: ids[a:b]
                    else:
                        file = system.open_input_file(f"{stem}.bin")
                        take = lambda a, b, file=file: np.frombuffer(file.read_at((b - a) * size, a * size), kind)
                    with system.open_input_stream(f"{stem}.off") as file:
                        offsets = np.frombuffer(file.read(), "<u8").astype("int64")
                    with system.open_input_stream(f"{stem}.key") as file:
                        keys = np.frombuffer(file.read(), "<i8")
                    for low in range(0, part["docs"], 10_000):
                        high = min(low + 10_000, part["docs"])
                        at = offsets[low : high + 1]
                        sums = [zlib.crc32(take(a, b).astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(keys[low:high], pa.int64(), mask=keys[low:high] == NO_KEY),
                                pa.array(at[:-1] + part["base"], pa.int64()),
                                pa.array(np.diff(at), pa.int64()),
                                pa.array(sums, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

        schema = f"{_MANIFEST}, base bigint"
        manifest = self.spark.createDataFrame([tuple(p) for p in self.parts], schema).repartition(max(1, len(self.parts)))
        return manifest.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, vocabulary: int, parts: int | None = None
) -> TokenFiles:
    """Encode ``doc_id, text`` and write the files; the tokenizer file (1 to 2 MB) is broadcast.

    Null and empty texts give the end id alone. Ids come in ascending order, null ids first; rows
    with the same id are all written, ordered by text. An empty table gives no files and no parts.
    ``folder`` must be one that all executors share.
    """
    spark = docs.sparkSession
    content = share_file(spark, tokenizer_path)
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    end = np.array([end_id], kind).tobytes()
    size = len(end)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(parts or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value, kind)
        system, path = _place(folder)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        system.create_dir(path, recursive=True)
        keys, counts = [], []
        with system.open_output_stream(f"{path}/{name}.bin") as file:
            for batch in batches:
                key = batch.column("doc_id").fill_null(NO_KEY).to_numpy(zero_copy_only=False)
                keys.append(key.astype("<i8"))
                for text in batch.column("text"):
                    packed = encoder.packed(text.as_py())
                    file.write(packed)
                    file.write(end)
                    counts.append(len(packed) // size + 1)
        n = len(counts)
        if n:
            offsets = np.concatenate([[0], np.cumsum(np.array(counts, "int64"))]).astype("<u8")
            with system.open_output_stream(f"{path}/{name}.off") as file:
                file.write(offsets.tobytes())
            with system.open_output_stream(f"{path}/{name}.key") as file:
                file.write(np.concatenate(keys).tobytes())
        else:
            system.delete_file(f"{path}/{name}.bin")
        total = [int(sum(counts))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array(total, pa.int64())],
            names=["part", "name", "docs", "ids"],
        )

    written = ordered.mapInArrow(run, _MANIFEST).collect()  # one row per part
    found, base = [], 0
    for row in sorted((r for r in written if r["docs"]), key=lambda r: r["part"]):
        found.append(Row(**row.asDict(), base=base))
        base += row["ids"]
    return TokenFiles(spark, folder, kind, found)
