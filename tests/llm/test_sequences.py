"""Fill-in-middle, packing and the prefix trie against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changerisk.llm import fill_middle, packing
from changerisk.llm.fill_middle import Rates, fill_in_middle, restore
from changerisk.llm.packing import Cost, capacities, pack, pack_documents
from changerisk.llm.prefix_trie import Sizes, SlotTable, prefix_trie

SMALL = "/root/testdata/sf0.001"


def plain_fill(key, text, seed=1, rates=Rates()):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    one, two, three, four = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or three % 100 >= rates.transformed:
        return (key, n, "plain", None, None, text)
    low, high = sorted((one % (n + 1), two % (n + 1)))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if four % 100 < rates.suffix_first:
        return (key, n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (key, n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}")


def awkward(n):
    dice = random.Random(11)
    return ["".join(dice.choice("aé漢😀<P>SM \n") for _ in range(dice.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("seed, rates", [(1, Rates()), (7, Rates(100, 50)), (1, Rates(0, 20))])
def test_fill_in_middle(spark, docs, seed, rates):
    more = [(1000 + i, t) for i, t in enumerate([*awkward(600), "<P", "<", ">", "é漢😀" * 100_000])]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    found = fill_in_middle(rows, seed=seed, rates=rates)
    assert Counter(map(tuple, found.collect())) == Counter(plain_fill(*r, seed, rates) for r in rows.collect())
    back = found.select("doc_id", restore().alias("text"))
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in rows.collect())


def test_fill_in_middle_in_short_runs(monkeypatch):
    """Texts longer than a run are cut at code points and put together again."""
    import pyarrow as pa

    texts = awkward(300)
    numbers = [pa.array(np.random.default_rng(i).integers(0, 1 << 32, len(texts))) for i in range(4)]
    names = ["key", "text", "draw_1", "draw_2", "draw_3", "draw_4"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), *numbers], names=names)
    whole = fill_middle.transform_batch(batch, Rates()).to_pylist()
    for size in (4, 7, 64):
        monkeypatch.setattr(fill_middle, "RUN_BYTES", size)
        assert fill_middle.transform_batch(batch, Rates()).to_pylist() == whole


def test_fill_in_middle_with_clashing_columns(spark, none):
    assert fill_in_middle(none).collect() == []
    df = spark.createDataFrame([(3, "some text", "x", "y", 5)], "doc_id int, text string, key string, output string, n int")
    row = fill_in_middle(df).first()
    assert tuple(row) == plain_fill(3, "some text") and row.__fields__[0] == "doc_id"


def test_capacities_hold_all_tokens():
    for tokens in (0, 1, 4095, 4096, 4097, 12_345, 262_144):
        room = capacities(tokens, 4096)
        assert sum(room) == tokens and all(n & (n - 1) == 0 for n in room) and len(room) <= tokens // 4096 + 12


def plain_pack(lengths, room, cost):
    """The rule word for word: descending documents, lowest cost with room, cut only where none has."""
    waiting, left, spent, pieces = [[n, at, 0] for at, n in enumerate(lengths) if n], list(room), [0.0] * len(room), []
    while waiting:
        n, at, start = item = min(waiting, key=lambda w: (-w[0], w[1], w[2]))
        waiting.remove(item)
        able = [i for i in range(len(room)) if left[i] >= n] or [i for i in range(len(room)) if left[i]]
        place = min(able, key=lambda i: (spent[i], i))
        length = min(n, left[place])
        pieces.append((at, start, length, place, room[place] - left[place]))
        left[place] -= length
        spent[place] += cost.linear * length + cost.quadratic * length * length
        if length < n:
            waiting.append([n - length, at, start + length])
    return pieces


def test_pack_follows_the_rule():
    dice = random.Random(12)
    for size in (8, 64):
        for _ in range(40):
            lengths = [dice.choice([0, 1, 5, dice.randrange(1, 4 * size)]) for _ in range(dice.randrange(1, 30))]
            room = capacities(sum(lengths), size)
            assert pack(lengths, room, Cost()) == plain_pack(lengths, room, Cost())


def test_costs_are_balanced():
    dice = random.Random(13)
    lengths = []
    while sum(lengths) < 64 * 4096:
        lengths.append(min(dice.randrange(20, 1200), 64 * 4096 - sum(lengths)))
    cost = Cost()
    spread = []
    for order in (sorted(lengths, reverse=True), lengths):
        at, costs, left = 0, defaultdict(float), 4096
        for n in order:  # one after the other, without looking at costs
            while n:
                take = min(n, left)
                costs[at] += cost.of(take)
                n, left = n - take, left - take
                at, left = (at, left) if left else (at + 1, 4096)
        spread.append(max(costs.values()) - min(costs.values()))
    costs = defaultdict(float)
    for _, _, length, place, _ in pack(lengths, [4096] * 64, cost):
        costs[place] += cost.of(length)
    assert max(costs.values()) - min(costs.values()) < min(spread) / 10


def check_pieces(found, source, size):
    """Every id once, sequences gapless and full or a power of two."""
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sequences, docs = defaultdict(list), defaultdict(list)
    for row in found:
        ids = np.frombuffer(row["ids"], "<u4")
        assert len(ids) == row["length"] > 0
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
        docs[row["doc_id"], row["tokens"]].append((row["start"], ids))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == size or (end < size and end & (end - 1) == 0)
    expected = Counter()
    for key, text in source:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected[key, len(ids)] += 1
    assert {key: len([1 for start, _ in pieces if start == 0]) for key, pieces in docs.items()} == dict(expected)
    for key, text in source:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        if expected[key, len(ids)] == 1:
            pieces = sorted(docs[key, len(ids)], key=lambda p: p[0])
            assert np.concatenate([ids for _, ids in pieces]).tolist() == ids
            assert [start for start, _ in pieces] == [0, *np.cumsum([len(p) for _, p in pieces])[:-1]]
    return sequences


@pytest.mark.parametrize("size, group, row", [(4096, 64, 1 << 16), (64, 4, 100), (16, 2, 7)])
def test_pack_documents(spark, docs, monkeypatch, size, group, row):
    monkeypatch.setattr(packing, "GROUP", group)
    monkeypatch.setattr(packing, "ROW_TOKENS", row)
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id") + 1000, "text").limit(60)
    rows = docs.select("doc_id", "text").union(table).repartition(5)
    found = pack_documents(rows, P.path("word_bpe_49k.json"), 2, 49_408, size=size).collect()
    sequences = check_pieces(found, [tuple(r) for r in rows.collect()], size)
    assert sum(sum(n for _, n in pieces) < size for pieces in sequences.values()) <= size.bit_length()


def test_pack_nothing(none):
    assert pack_documents(none, P.path("word_bpe_49k.json"), 2, 49_408).collect() == []


def plain_trie(rows):
    """Nodes by listing every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(r[3], r[4]) for r in sorted(found)] for c, found in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(turns.get(base, [])[:h]) + tuple(turns[c][h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, nodes = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = sorted(c for c in members[node] if len(rebuilt[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        nodes.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], digest))
    return Counter(nodes)


CONV = "conv_id bigint, turn int, role string, text string"


def trie_of(df, *sizes):
    return Counter(tuple(r)[1:] for r in prefix_trie(df, *sizes).collect())


def odd_conversations():
    dice = random.Random(14)
    rows = []
    for c in [*range(-150, 150, 7), *range(0, 400, 3), 0, 100, 200, 10**12, 10**12 + 1]:
        for turn in range(dice.randrange(1, 9)):
            rows.append((c, dice.choice([turn, turn, None, 1]), dice.choice(["user", "assistant", None]), dice.choice(["hi", "", None, "é漢", "a:b", "x" * 50])))
    return [*rows, *rows[:20], (None, 1, "user", "nobody"), (None, None, None, None)]


def test_trie(spark):
    rows = odd_conversations()
    assert trie_of(spark.createDataFrame(rows, CONV).repartition(3)) == plain_trie(rows)


def test_trie_in_short_blocks_and_shards(spark):
    """Blocks, shards and runs of ids that hold little give the same nodes."""
    rows = odd_conversations()
    rows += [(c, i, "user", f"turn {i}") for c in (5000, 5100, 5101, 5102) for i in range(40)]  # long ones
    rows += [(c, 0, "user", "same") for c in range(6000, 6400)]  # one that is very common
    assert trie_of(spark.createDataFrame(rows, CONV).repartition(7), Sizes(3, 5, 8, 2)) == plain_trie(rows)


def test_trie_of_nothing_and_of_clashing_columns(spark):
    empty = spark.createDataFrame([], CONV)
    assert prefix_trie(empty).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "hi", 3, "x", 9)], CONV + ", depth int, node string, conv int")
    assert trie_of(df) == plain_trie([(1, 0, "user", "hi")])


def test_trie_of_the_table(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert trie_of(df) == plain_trie([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_slots_are_a_minimal_perfect_hash(n):
    names = np.random.default_rng(n).integers(0, 1 << 63, (n, 2)).astype("u8")
    names[: n // 2, 0] = 5
    table = SlotTable(names)
    assert sorted(table.slots(names).tolist()) == list(range(n))
    if n:
        with pytest.raises(RuntimeError):
            table.slots(names[:1] + np.uint64(1))
