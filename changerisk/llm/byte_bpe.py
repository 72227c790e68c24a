"""Byte-level BPE: encode and decode whole texts with the tokenizers library over Arrow batches.

The ranks of a vocabulary file are turned into the library's vocabulary and merges: each byte is
written as one printable character (the byte table), and a token of several bytes is the merge of
the two parts that lower ranks make of it. Encoding gives ids and, on request, the characters each
id covers. Decoding goes back through the byte table; bytes are joined before they are read as
UTF-8, so characters that were split across tokens come back whole.

Memory per task: one Arrow batch, and the worker's bounded memo of pieces (``pieces.py``).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

from changerisk.llm.common import share_file, text_or_empty, texts_of
from changerisk.llm.pieces import PieceEncoder, byte_characters


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and their rank, from a file with a base64 token and a rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What the merges before a token's own leave of it."""
    own, parts = ranks[token], [bytes([b]) for b in token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def build_tokenizer(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """The library's tokenizer for a rank file; no string is special."""
    characters = byte_characters()
    written = {token: "".join(characters[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1:
            parts = _parts(token, ranks)
            if len(parts) == 2:  # else no merge makes it, in either library
                merges.append((written[parts[0]], written[parts[1]]))
    tokenizer = Tokenizer(BPE({written[token]: rank for token, rank in ranks.items()}, merges))
    tokenizer.pre_tokenizer = Sequence(
        [Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer


@lru_cache(maxsize=2)
def _codec(content: bytes, pattern: str) -> tuple[PieceEncoder, list[bytes]]:
    """Encoder, and the bytes of each id found by reversing the byte table; one per worker."""
    tokenizer = build_tokenizer(read_ranks(content), pattern)
    back = {character: byte for byte, character in enumerate(byte_characters())}
    vocabulary = tokenizer.get_vocab()
    table = [b""] * (max(vocabulary.values()) + 1)
    for written, rank in vocabulary.items():
        table[rank] = bytes(back[c] for c in written)
    return PieceEncoder(tokenizer), table


def decode_packed(packed: bytes, table: list[bytes]) -> bytes:
    """Text bytes of packed ids."""
    return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()])


class ByteBpe:
    """Encode and decode with one rank file.

    ``path`` is read once on the driver and broadcast (under 1 MB). Null texts are empty texts;
    an empty text has no ids. Every row gives one row, so repeated rows and null ids stay.
    """

    def __init__(self, spark, path: str, pattern: str) -> None:
        self.content, self.pattern = share_file(spark, path), pattern

    def encode(self, docs: DataFrame, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
        """``key, ids`` (array<int>) and with ``offsets`` also ``starts, ends`` in characters."""
        content, pattern = self.content, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, _ = _codec(content.value, pattern)
            for batch in batches:
                columns = {"key": batch.column("key"), "ids": []}
                if offsets:
                    columns |= {"starts": [], "ends": []}
                for value in texts_of(batch.column("text")):
                    packed, spans = encoder.with_offsets(value) if offsets else (encoder.packed(value), ())
                    columns["ids"].append(np.frombuffer(packed, "<u4").astype("int32"))
                    if offsets:
                        columns["starts"].append([s for s, _ in spans])
                        columns["ends"].append([e for _, e in spans])
                arrays = [columns["key"], *(pa.array(columns[n], pa.list_(pa.int32())) for n in columns if n != "key")]
                yield pa.RecordBatch.from_arrays(arrays, names=list(columns))

        kind = docs.schema[key].dataType.simpleString()
        more = ", starts array<int>, ends array<int>" if offsets else ""
        rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
        return rows.mapInArrow(run, f"key {kind}, ids array<int>{more}").withColumnRenamed("key", key)

    def decode(self, encoded: DataFrame, key: str = "doc_id") -> DataFrame:
        """``key, bytes, text`` from ``key, ids``; ``text`` is null if the bytes are no UTF-8.

        Null ids are an empty list; an id without an entry raises.
        """
        content, pattern = self.content, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, table = _codec(content.value, pattern)
            for batch in batches:
                raw = [b"".join([table[i] for i in ids or ()]) for ids in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(raw, pa.binary())], names=["key", "bytes"])

        kind = encoded.schema[key].dataType.simpleString()
        raw = encoded.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, bytes binary")
        text = F.when(F.is_valid_utf8(F.col("bytes").cast("string")), F.col("bytes").cast("string"))
        return raw.select(F.col("key").alias(key), "bytes", text.alias("text"))

    def digests(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``key, n_tokens, ids_sha256, decoded_sha256``: encode, decode the ids, and digest both.

        Ids are hashed as little-endian unsigned 32-bit integers. Ids and decoded bytes stay in
        the task; only the digests leave it.
        """
        content, pattern = self.content, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, table = _codec(content.value, pattern)
            for batch in batches:
                counts, ids, decoded = [], [], []
                for value in batch.column("text"):
                    packed = encoder.packed(value.as_py())
                    counts.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(decode_packed(packed, table)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

        kind = docs.schema[key].dataType.simpleString()
        rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
        schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
        return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
