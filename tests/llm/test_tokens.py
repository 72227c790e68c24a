"""Byte-level BPE and token files against the libraries on whole texts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from changerisk.llm.byte_bpe import ByteBpe, _codec, byte_characters, decode_packed
from changerisk.llm.token_files import _encoder, write_token_files
from changerisk.runtime import scratch_path

ALPHABET = "ab 'sS\n\t\r\x0b\x1c\x01\x85 \xa0　é́漢😀1²_,.!?|<e>​ſ"


def odd_texts(n=3000):
    dice = random.Random(7)
    return ["".join(dice.choice(ALPHABET) for _ in range(dice.randrange(50))) for _ in range(n)]


@pytest.fixture(scope="module")
def oracle():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture
def codec(spark):
    return ByteBpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_byte_table_is_a_bijection():
    assert len(set(byte_characters())) == 256 and byte_characters()[32] == "Ġ"


def test_ids_equal_tiktoken_on_odd_texts(oracle, texts):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        encoder, table = _codec(file.read(), P.PATTERN)
    for text in [*odd_texts(), *(t or "" for t in texts), *odd_texts(100)]:
        packed = encoder.packed(text)
        assert np.frombuffer(packed, "<u4").tolist() == oracle.encode_ordinary(text), repr(text)
        assert decode_packed(packed, table) == text.encode()


def test_digests(codec, docs, oracle):
    rows = docs.select("doc_id", "text").collect()
    found = sorted(map(tuple, codec.digests(docs).collect()), key=str)
    expected = []
    for row in rows:
        ids = oracle.encode_ordinary(row["text"] or "")
        raw = np.array(ids, "<u4").tobytes()
        expected.append(
            (row["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest())
        )
    assert found == sorted(expected, key=str)


def test_decode_brings_split_characters_back(codec, docs, texts):
    decoded = {r["doc_id"]: r for r in codec.decode(codec.encode(docs)).collect()}
    assert all(decoded[i]["text"] == (text or "") for i, text in enumerate(texts))


def test_half_a_character_is_bytes_without_text(spark, codec):
    ids = codec.encode(spark.createDataFrame([(1, "漢")], "doc_id bigint, text string")).first()["ids"]
    half = spark.createDataFrame([(1, ids[:1]), (2, None)], "doc_id bigint, ids array<int>")
    rows = {r["doc_id"]: r for r in codec.decode(half).collect()}
    assert rows[1]["text"] is None and rows[1]["bytes"] and rows[2]["text"] == ""


def test_offsets_cover_the_text(codec, docs):
    for row in codec.encode(docs, offsets=True).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        text = row["text"] or ""
        assert len(row["ids"]) == len(row["starts"]) == len(row["ends"])
        covered = set()
        for start, end in zip(row["starts"], row["ends"]):
            covered.update(range(start, end))
        assert covered == set(range(len(text)))


def test_empty_table(codec, none, spark):
    assert codec.digests(none).collect() == []
    files = write_token_files(none, scratch_path(spark, "t"), P.path("word_bpe_49k.json"), 2, 49_408)
    assert files.parts == [] and files.documents().collect() == []


def test_token_files(spark, docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    files = write_token_files(docs, scratch_path(spark, "t"), P.path("word_bpe_49k.json"), 2, 49_408, parts=3)
    rows = sorted(files.documents().collect(), key=lambda r: r["start"])
    source = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in source]
    start = 0
    for row, doc in zip(rows, source):
        ids = [*library.encode(doc["text"] or "", add_special_tokens=False).ids, 2]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert [p["base"] for p in files.parts] == [0, *np.cumsum([p["ids"] for p in files.parts])[:-1]]


def test_word_ids_equal_the_library_on_odd_texts(texts):
    with open(P.path("word_bpe_49k.json"), "rb") as file:
        encoder = _encoder(file.read(), "<u2")
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for text in [*odd_texts(), *(t or "" for t in texts), "hi <|endoftext|> x", "a<|STARTOFTEXT|>.b, c"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.packed(text), "<u2").tolist() == ids, repr(text)
