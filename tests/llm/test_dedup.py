"""Exact and near duplicates against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import xxhash

from brute import brute_near_copies

from changerisk.llm import components as components_module
from changerisk.llm import exact_dedup, near_copies, simhash
from changerisk.llm.components import components
from changerisk.llm.exact_dedup import duplicate_groups
from changerisk.llm.simhash import fingerprint_of, links, near_duplicate_groups


def squeeze(text):
    return "".join(c for c in text or "" if c not in " \t\n\r\x0b\x0c")


def brute_groups(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(squeeze(text), []).append((-len(text or ""), i is None, i))
    return {
        (i, (best := min(groups[squeeze(text)], key=lambda x: (x[0], x[1], x[2] or 0)))[2], len(groups[squeeze(text)]), best[2] == i,
         hashlib.sha256(squeeze(text).encode()).hexdigest())
        for i, text in rows
    }


def test_exact_groups(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = [tuple(r) for r in duplicate_groups(docs, digests=True).collect()]
    assert len(found) == len(rows) and set(found) == brute_groups(rows)


def test_exact_groups_of_random_texts(spark):
    dice = random.Random(3)
    rows = [(i, "".join(dice.choice("ab \n") for _ in range(dice.randrange(9)))) for i in range(800)]
    rows += [(1000 + i, "x" * exact_dedup.PREFIX + dice.choice("ab ") * dice.randrange(3)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in duplicate_groups(df, digests=True).collect()} == brute_groups(rows)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MARKS", 1 << 15)
    rows = [(i, f"text {i // 2}") for i in range(60)] + [(100 + i, f"single {i}" * i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in duplicate_groups(df, digests=True).collect()} == brute_groups(rows)


def test_unsettled_rows_only_are_hashed(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "abc")], "doc_id bigint, text string")
    assert {tuple(r) for r in duplicate_groups(df).collect()} == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(bits):
    roots = {b: b for b in bits}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    values = sorted(roots)
    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                roots[find(a)] = find(b)
    return {b: find(b) for b in values}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprints_with_small_chunks(texts, monkeypatch):
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    for text in texts:
        if len(text or "") < 5000:
            assert fingerprint_of(text or "") == brute_fingerprint(text)


def test_near_groups(docs):
    rows = docs.select("doc_id", "text").collect()
    bits = [signed(brute_fingerprint(r["text"])) for r in rows]
    roots = brute_components(bits)
    least = {}
    for row, value in zip(rows, bits):
        if row["doc_id"] is not None:
            least[roots[value]] = min(least.get(roots[value], row["doc_id"]), row["doc_id"])
    expected = sorted(((r["doc_id"], b, least.get(roots[b])) for r, b in zip(rows, bits)), key=str)
    assert sorted(map(tuple, near_duplicate_groups(docs).collect()), key=str) == expected


def test_links_of_crowded_and_sparse_fingerprints(spark):
    dice = random.Random(5)
    centre = dice.getrandbits(64)
    values = {centre}
    for _ in range(250):  # a dense cloud
        values.add(centre ^ sum({1 << dice.randrange(64) for _ in range(dice.randrange(1, 5))}))
    for _ in range(150):  # pairs of distance 1 to 4
        a = dice.getrandbits(64)
        values |= {a, a ^ sum({1 << dice.randrange(64) for _ in range(dice.randrange(1, 5))})}
    chain = dice.getrandbits(64)
    for step in range(40):  # a chain
        chain ^= 3 << step
        values.add(chain)
    values |= {0, 1, 2**63, 2**64 - 1}
    nodes = spark.createDataFrame([(signed(v),) for v in values], "bits bigint")
    found = {r["node"]: r["root"] for r in components(links(nodes)).collect()}
    expected = brute_components([signed(v) for v in values])
    same = {}
    for v in map(signed, values):
        same.setdefault(expected[v], set()).add(found.get(v, v))
    assert all(len(roots) == 1 for roots in same.values())
    assert len({found.get(signed(v), signed(v)) for v in values}) == len(same)


def test_components_of_odd_links(spark):
    edges = [(1, 2), (2, 1), (3, 3), (None, 4), (5, None), (9, 8), (8, 7), (7, 6), (6, 2), (20, 21)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {tuple(r) for r in components(df).collect()} == {(x, 1) for x in (1, 2, 6, 7, 8, 9)} | {(20, 20), (21, 20)}


def test_rounds_over_few_links_take_few_tasks(spark, monkeypatch):
    """Whatever the session's partitions: each task of an exchange leaves files."""
    tasks, freeze = [], components_module.freeze

    def counted(df):
        done = freeze(df)
        tasks.append(done.rdd.getNumPartitions())
        return done

    monkeypatch.setattr(components_module, "freeze", counted)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for name, value in zip(old, ("40", "false")):
        spark.conf.set(name, value)
    try:
        chains = spark.range(200).selectExpr("id as a", "if(id % 20 = 19, id, id + 1) as b")
        found = {r["node"]: r["root"] for r in components(chains).collect()}
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert found == {i: i - i % 20 for i in range(200)}
    assert len(tasks) > 2 and max(tasks[1:]) <= components_module._TASKS


def test_empty_tables(none):
    assert duplicate_groups(none).collect() == [] and near_duplicate_groups(none).collect() == []


def edited(dice, words, times):
    words = list(words)
    for _ in range(times):
        words[dice.randrange(len(words))] = f"new{dice.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_of_families_and_crowds(spark, monkeypatch):
    dice = random.Random(8)
    rows, word = [], lambda: f"w{dice.randrange(5000)}"
    for _ in range(40):  # small families around the limit
        base = [word() for _ in range(dice.randrange(60, 300))]
        rows += [edited(dice, base, dice.randrange(1, 8)) for _ in range(4)]
    base = [word() for _ in range(200)]
    rows += [edited(dice, base, dice.randrange(1, 9)) for _ in range(90)]  # a crowd in several components
    rows += [None, "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f"]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute_near_copies(rows)
    assert len({expected[i] for i in range(160, 250)}) > 1
    for hubs, few in ((1, 2), (8, 16)):
        monkeypatch.setattr(near_copies, "HUBS", hubs)
        monkeypatch.setattr(near_copies, "FEW", few)
        assert dict(map(tuple, copies_of(df))) == expected


def test_crowd_of_unlike_texts_does_not_meet(spark):
    """Texts that share a passage of two thirds: no pair is listed, however many they are."""
    dice = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts = [[*passage, *(f"o{dice.randrange(10**9)}" for _ in range(30))] for _ in range(300)]
    sets = [near_copies.shingle_set(" ".join(words)) for words in texts]
    rows = [(i, x.tobytes()) for i, x in enumerate(sets)]
    crowd = spark.createDataFrame(rows, "node bigint, hashes binary")
    assert near_copies._sub_entries(crowd).count() == 0


def test_crowd_of_near_copies_is_compared_with_hubs(spark):
    """Candidate rows of a crowd grow with its members, and groups are those of all pairs."""
    dice, made = random.Random(10), []
    base = [f"w{dice.randrange(5000)}" for _ in range(150)]
    for n in (100, 400):
        texts = [edited(dice, base, dice.randrange(0, 3)) for _ in range(n)]
        sets = [near_copies.shingle_set(t) for t in texts]
        rows = {near_copies._node(x): x.tobytes() for x in sets}
        crowd = spark.createDataFrame(list(rows.items()), "node bigint, hashes binary")
        entries = near_copies._sub_entries(crowd)
        pairs = near_copies._hub_pairs(entries).count()
        made.append((len(rows), pairs))
        found = dict(map(tuple, copies_of(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))))
        assert found == brute_near_copies(list(enumerate(texts)))
    (few, small), (many, large) = made
    assert large / small < 2 * many / few


def copies_of(df):
    return near_copies.near_copy_groups(df).collect()


def test_near_copies_with_odd_rows(docs, none):
    groups = near_copies.near_copy_groups(docs)
    assert groups.count() == docs.count() and near_copies.near_copy_groups(none).collect() == []
    assert {r["doc_id"]: r["component_id"] for r in groups.collect()}[11] == 10


def test_stage_finds_all_similar_pairs_of_the_table(spark):
    """Against all pairs that share a shingle: 48 of sf0.1 are similar."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = {}
    for row in docs.collect():
        sets.setdefault(near_copies.shingle_set(row["text"] or "").tobytes(), row["doc_id"])
    sets = {i: np.frombuffer(x, "u8") for x, i in sets.items()}
    hashes, owners = np.concatenate(list(sets.values())), np.repeat(list(sets), [len(x) for x in sets.values()])
    order = np.argsort(hashes, kind="stable")
    common = Counter()
    for group in np.split(owners[order], np.flatnonzero(np.diff(hashes[order])) + 1):
        if len(group) > 1:
            common.update(itertools.combinations(sorted(group.tolist()), 2))
    pairs = [(a, b) for (a, b), n in common.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    root = dict(map(tuple, copies_of(docs)))
    assert len(pairs) == 48 and all(root[a] == root[b] for a, b in pairs)
    fingerprints = {r["doc_id"]: r["component_id"] for r in near_duplicate_groups(docs).collect()}
    print("pairs joined by SimHash:", sum(fingerprints[a] == fingerprints[b] for a, b in pairs))
