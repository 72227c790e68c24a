"""Text to dense vectors: an encoder protocol for Spark tasks, and a hashing encoder.

An encoder is a small frozen object that travels to the workers. What it needs there (a model, a
vocabulary, a memo) is made by ``setup`` once per Python worker and kept as long as the worker
lives, over batches and tasks. Texts reach it in batches of bounded rows and bytes.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ``setup`` returned in this worker, by encoder; a worker keeps the last few.
_STATES: dict[TextEncoder, Any] = {}
_MOST_STATES = 4

#: Words of a hashing encoder's memo.
MEMO_WORDS = 100_000


@dataclass(frozen=True)
class TextEncoder:
    """Base of encoders: subclass it as a frozen dataclass with what the encoder is configured by.

    ``encode`` gets at most ``batch_rows`` texts, and at most ``batch_bytes`` of them unless one
    text alone is longer, and returns an array of one row of ``size`` numbers per text.
    """

    size: int = 768
    batch_rows: int = 64
    batch_bytes: int = 4 << 20

    def setup(self) -> Any:
        """State of a worker, made at its first batch."""
        return None

    def encode(self, state: Any, texts: list[str]) -> np.ndarray:
        raise NotImplementedError


@dataclass(frozen=True)
class HashingEncoder(TextEncoder):
    """Signed word counts at ``size`` places, scaled to length one.

    A text's words are its runs of characters that are no ASCII white space, as they are given.
    The MD5 of a word, as 32 hex digits, says its place (the number of the first eight, modulo
    ``size``) and its sign (minus if the ninth is odd), so that any engine can recompute a vector.
    ``max_tokens`` keeps only the first words, as a model with a bounded input would; by default
    all count. A text without words is all zeros; without ``scaled`` the counts stay as they are.
    """

    max_tokens: int | None = None
    scaled: bool = True
    batch_rows: int = 1_000

    def setup(self) -> dict[bytes, int]:
        return {}

    def place(self, word: bytes) -> tuple[int, int]:
        """Place and sign of a word."""
        digest = hashlib.md5(word, usedforsecurity=False).hexdigest()
        return int(digest[:8], 16) % self.size, -1 if int(digest[8], 16) % 2 else 1

    def encode(self, state: dict[bytes, int], texts: list[str]) -> np.ndarray:
        codes = array("q")  # twice the place, and one more for a minus
        counts = []
        for text in texts:
            words = text.encode().split()
            if self.max_tokens is not None:
                words = list(islice(words, self.max_tokens))
            counts.append(len(words))
            for word in words:
                found = state.get(word)
                if found is None:
                    if len(state) >= MEMO_WORDS:
                        state.clear()
                    place, sign = self.place(word)
                    found = state[word] = 2 * place + (sign < 0)
                codes.append(found)
        flat = np.frombuffer(codes, "i8") if codes else np.empty(0, "i8")
        rows = np.repeat(np.arange(len(texts)), counts)
        sums = np.bincount(rows * self.size + flat // 2, 1.0 - 2 * (flat % 2), len(texts) * self.size)
        sums = sums.reshape(len(texts), self.size)
        if self.scaled:
            lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            sums = sums / np.where(lengths == 0, 1.0, lengths)
        return sums


def state_of(encoder: TextEncoder) -> Any:
    """The worker's state of an encoder, set up on first use."""
    if encoder not in _STATES:
        while len(_STATES) >= _MOST_STATES:
            del _STATES[next(iter(_STATES))]
        _STATES[encoder] = encoder.setup()
    return _STATES[encoder]


def text_batches(texts: Iterable[str], rows: int, size: int) -> Iterator[list[str]]:
    """Runs of at most ``rows`` texts and ``size`` bytes; a longer text is a run of its own."""
    batch: list[str] = []
    used = 0
    for text in texts:
        bytes_of = len(text.encode())
        if batch and (len(batch) >= rows or used + bytes_of > size):
            yield batch
            batch, used = [], 0
        batch.append(text)
        used += bytes_of
    if batch:
        yield batch


def encoded(encoder: TextEncoder, batch: pa.Array) -> Iterator[pa.Array]:
    """Vectors of a batch in parts, each of the texts that the encoder gets at a time."""
    state = state_of(encoder)
    texts_of_batch = (text.as_py() or "" for text in batch)
    for texts in text_batches(texts_of_batch, encoder.batch_rows, encoder.batch_bytes):
        found = np.asarray(encoder.encode(state, texts), "f4")
        if found.shape != (len(texts), encoder.size):
            raise ValueError(f"{type(encoder).__name__} gave {found.shape} for {len(texts)} texts of {encoder.size} numbers")
        offsets = np.arange(len(texts) + 1, dtype="i4") * encoder.size
        yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))


def _vectors(encoder: TextEncoder, text: Column) -> Column:
    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from encoded(encoder, batch)

    return encode(text)


def embed_text(
    df: DataFrame,
    text: str = "input_text",
    output: str = "embedding",
    size: int = 768,
    max_tokens: int | None = None,
    encoder: TextEncoder | None = None,
) -> DataFrame:
    """Add a vector of floats per row; only the text leaves the JVM, and no row its partition.

    Without an ``encoder``, lower-cased words are hashed, counted and scaled to length one at
    ``size`` places; ``max_tokens`` keeps only the first ones. Null texts are empty texts.
    """
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    if encoder is None:
        encoder, words = HashingEncoder(size, max_tokens=max_tokens), F.lower(words)
    return df.withColumn(output, _vectors(encoder, words))
