"""Nearest neighbours, the rule ensemble, mixing, and the pipeline."""

import hashlib
import importlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import brute_near_copies

from changerisk.llm import hash_forest
from changerisk.llm.hash_forest import HashForest
from changerisk.llm.mixing import entropy, find_exponent, mixed_documents, mixture, repetitions, tempered
from changerisk.llm.rule_ensemble import Rule, fit_quality, fit_rules, held_out, rules_of, score_quality
from changerisk.llm.text_stats import STATISTICS, with_statistics

SMALL = "/root/testdata/sf0.001"


def brute_nearest(rows, k=5):
    valid = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            valid.setdefault((i, tuple(v)), np.array(v, "f8"))
    items = list(valid.items())
    answer = {}
    for (i, _), v in items:
        scores = []
        for (j, _), w in items:
            if j != i:
                scores.append((-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), j))
        answer[i] = sorted(scores)[:k]
    return answer


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "'x' AS node")


def test_all_rows_are_candidates_of_a_small_table(spark, monkeypatch):
    monkeypatch.setattr(hash_forest, "BLOCK", 8)  # many blocks, split ones too
    dice = np.random.default_rng(1)
    rows = [(i, dice.standard_normal(8).astype("f4").tolist()) for i in range(120)]
    rows += [(200 + i, [1.0] * 8) for i in range(40)] + [(300, [2.0] * 8)]  # copies, and one that is longer
    odd = [(400, None), (401, [0.0] * 8), (402, [None] + [1.0] * 7), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, [1.0] * 8)]
    odd += [(405, []), (406, [1.0, 2.0]), rows[0]]
    found = HashForest(vectors(spark, rows + odd), "vec_id", "embedding").search(F.col("id") % 2 == 0).collect()
    expected = brute_nearest(rows)
    by_query = defaultdict(list)
    for row in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query[row["query_id"]].append(row)
    assert set(by_query) == {i for i, _ in rows if i % 2 == 0}
    for query, answer in by_query.items():
        assert [r["rank"] for r in answer] == [1, 2, 3, 4, 5]
        assert [r["score"] for r in answer] == pytest.approx([-s for s, _ in expected[query]], abs=1e-12)
        if query < 200:
            assert [r["vec_id"] for r in answer] == [j for _, j in expected[query]]
    assert [r["vec_id"] for r in by_query[200]][:4] == [201, 202, 203, 204]


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    """Vectors of one direction and quantised ones: far more equal cosines than are kept by a block."""
    dice = np.random.default_rng(4)
    line = [(i, [3.0 * 2 ** (i % 9), 4.0 * 2 ** (i % 9), 0.0, 0.0]) for i in dice.permutation(400).tolist()]
    bits = [(i, (dice.integers(0, 2, 4) * 2.0 ** dice.integers(0, 5)).tolist()) for i in range(300)]
    for block in (16, 8192):
        monkeypatch.setattr(hash_forest, "BLOCK", block)
        for rows in (line, bits):
            found = HashForest(vectors(spark, rows), "vec_id", "embedding").search(F.col("id") % 20 == 0, share=1e9).collect()
            expected = brute_nearest(rows)
            answer = defaultdict(dict)
            for row in found:
                answer[row["query_id"]][row["rank"]] = row["vec_id"]
            wanted = {i: [j for _, j in best] for i, best in expected.items() if i % 20 == 0}
            assert {i: [by_rank[r] for r in sorted(by_rank)] for i, by_rank in answer.items()} == wanted


def test_recall_on_random_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    values = np.array([r["embedding"] for r in rows], "f8")
    ids = np.array([r["vec_id"] for r in rows])
    found = HashForest(table, "vec_id", "embedding").search(F.col("id") % 50 == 0).collect()
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    hits = 0
    for query in ids[ids % 50 == 0]:
        scores = unit @ unit[ids == query][0]
        scores[ids == query] = -2
        hits += len(set(ids[np.argsort(-scores)[:5]]) & {r["vec_id"] for r in found if r["query_id"] == query})
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_few_vectors(spark):
    none = HashForest(vectors(spark, []), "vec_id", "embedding").search(F.lit(True))
    assert none.collect() == []
    two = HashForest(vectors(spark, [(1, [1.0, 0.0]), (2, [1.0, 1.0])]), "vec_id", "embedding").search(F.lit(True))
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in two.collect()} == {(1, 1, 2), (2, 1, 1)}


TREE = """DecisionTreeClassificationModel: depth=2
  If (feature 1 <= 2.5)
   If (feature 0 <= 1.0)
    Predict: 0.0
   Else (feature 0 > 1.0)
    Predict: 1.0
  Else (feature 1 > 2.5)
   Predict: 1.0
"""


def test_paths_become_rules():
    a, b = STATISTICS[:2]
    inf = math.inf
    assert rules_of(TREE) == [
        Rule(((b, -inf, 2.5),)),
        Rule(((a, -inf, 1.0), (b, -inf, 2.5))),
        Rule(((a, 1.0, inf), (b, -inf, 2.5))),
        Rule(((b, 2.5, inf),)),
    ]


def test_statistics_by_hand(spark, docs, texts):
    df = spark.createDataFrame([(1, "Ab AB ab ab.\nx1 !!")], "doc_id bigint, text string")
    stats = with_statistics(df).first()["stats"].asDict()
    assert stats["upper_share"] == 3 / 9 and stats["repeat_share"] == 0 and stats["marked_share"] == 1 / 6
    assert stats["distinct_share"] == 1 and stats["line_words"] == 3 and stats["digit_share"] == 1 / 18
    rows = with_statistics(docs).collect()
    assert len(rows) == len(texts) + 2
    assert all(x is not None and math.isfinite(x) for r in rows for x in r["stats"])


def test_labels_of_one_kind_or_none_give_a_constant(spark, docs):
    stats = with_statistics(docs)
    one = fit_rules(stats.withColumn("label", F.lit(1)))
    none = fit_rules(stats.withColumn("label", F.lit(None).cast("int")))
    assert not one.weights and one.constant > 2 and none.constant == 0.0
    assert all(r["score"] == 0.5 for r in score_quality(docs, none).collect())


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    ensemble = fit_quality(docs, labels)
    return ensemble, score_quality(docs, ensemble).join(labels, "doc_id").withColumn("held", held_out(F.col("doc_id"))).collect()


def test_held_out_accuracy(scored):
    ensemble, rows = scored
    assert 0 < len(ensemble.weights) < 60
    held = [r for r in rows if r["held"]]
    assert held and all(0 <= r["score"] <= 1 for r in rows)
    right = sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in held)
    assert right >= 0.97 * len(held)
    assert all(r["score"] >= 0.7 for r in held if r["quality"] == 1)


def test_odd_texts_have_scores(scored, docs, none):
    ensemble, _ = scored
    rows = score_quality(docs, ensemble)
    assert rows.columns == [*docs.columns, "score"]
    assert all(0 <= r["score"] <= 1 for r in rows.collect())
    assert score_quality(none, ensemble).collect() == []


TOKENS = {"big": 6_000, "a": 1_000, "b": 900, "c": 50, "empty": 0}


def test_exponent_meets_entropy_and_limit():
    target = 1.1
    a = find_exponent(TOKENS, target_entropy=target, most=None)
    assert entropy(tempered(TOKENS, a)) == pytest.approx(target, abs=1e-9)
    b = find_exponent(TOKENS, most=4.0)
    assert max(repetitions(TOKENS, tempered(TOKENS, b)).values()) == pytest.approx(4.0)
    assert min(repetitions(TOKENS, tempered(TOKENS, b)).values()) == 1.0
    assert find_exponent(TOKENS, most=None) == 0.0 and find_exponent({}, most=4.0) == 0.0
    assert find_exponent({"a": 0}) == 0.0 and find_exponent(TOKENS, target_entropy=0.0, most=None) == 1.0


def brute_copies(rows, most, seed=42):
    sources = defaultdict(list)
    for i, source, text in rows:
        sources[source].append((hashlib.md5(f"{seed}:{i}".encode() if i is not None else f"{seed}".encode()).hexdigest(), i, len((text or "").encode().split())))
    tokens = {s: sum(n for _, _, n in members) for s, members in sources.items()}
    passes = repetitions(tokens, tempered(tokens, find_exponent(tokens, most=most)))
    found = Counter()
    for s, members in sources.items():
        budget = int(passes[s] * tokens[s] + 1e-6)
        whole = budget // tokens[s] if tokens[s] else 1
        rest = budget - whole * tokens[s]
        for digest, i, n in members:
            upto = sum(m for d, _, m in members if d <= digest)
            found[(i, s, n, whole + (rest > 0 and upto <= rest))] += 1
    return found


@pytest.mark.parametrize("most", [1.0, 2.5, 4.0])
def test_mixture(spark, docs, most):
    dice = random.Random(6)
    rows = [(100 + i, dice.choice(["big"] * 8 + ["a", "b", None]), "w " * dice.randrange(30)) for i in range(400)]
    df = docs.select("doc_id", "source", "text").union(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
    expected = brute_copies([tuple(r) for r in df.collect()], most)
    used, report = mixture(df, most=most)
    assert Counter(map(tuple, used.collect())) == expected
    mixed = mixed_documents(df, most=most)
    assert mixed.columns == df.columns and mixed.count() == sum(n * copies for (_, _, _, copies), n in expected.items())
    for row in report.collect():
        spent = sum(n * size * copies for (_, s, size, copies), n in expected.items() if s == row["source"])
        assert spent <= row["budget"]


def test_ids_shared_by_sources_keep_their_own_counts(spark):
    rows = [(i % 40, source, "w " * n) for source, n, count in (("big", 20, 100), ("small", 3, 20)) for i in range(count)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    used, _ = mixture(df, most=4.0)
    assert mixed_documents(df, most=4.0).count() == used.agg(F.sum("copies")).first()[0]


def test_empty_mixture(none):
    assert mixture(none)[0].collect() == [] and mixed_documents(none).collect() == []


def test_pipeline(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    rows = pipeline.run(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = pipeline.reject_low_quality(spark, docs, SMALL)
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    kept = {r["doc_id"] for r in rows}
    assert kept <= set(texts)
    groups = defaultdict(list)
    for i, text in texts.items():
        groups["".join(text.split())].append((-len(text), i))
    singles = [(i, texts[i]) for i in (min(members)[1] for members in groups.values())]
    assert kept == set(brute_near_copies(singles).values())
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_stages_with_odd_rows(spark, docs, none):
    pipeline = importlib.import_module("corpus_pipeline")
    names = ("score", "_raw", "_words", "_stats", "_gone", "gone", "row", "_key", "_copy", "copies", "tokens", "key", "n")
    docs = docs.withColumns({name: F.lit(name) for name in names})
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, SMALL).collect() == []
        after = stage(spark, docs, SMALL)
        assert name == "encode" or all({r[c] for r in after.select(c).distinct().collect()} <= {c} for c in ("score", "copies"))
        assert name == "encode" or after.columns == docs.columns
        assert after.count() <= docs.count() * (4 if name == "mixture" else 1)
    kept = {r["doc_id"] for r in pipeline.drop_exact_copies(spark, docs, SMALL).collect()}
    assert {2, 10, 11} & kept == {2, 10} and None in kept  # of texts without characters the longest stays
