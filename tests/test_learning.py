"""Metrics, reduction, models, experiments, incremental jobs."""

import datetime as dt
import hashlib
import math
import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from changerisk.errors import ChangeRiskError
from changerisk.operators import embedding, fusion, metrics, models, pca, selection, vectors
from changerisk.operators.leafwise import LeafwiseBoosting
from changerisk.plans.catalog import learning
from changerisk.plans.catalog.registry import Tables
from changerisk.plans.experiment import run_experiment
from changerisk.runtime import remove_path
from changerisk.streaming import incremental

# tn, fp, fn, tp and the published scores of four models.
PUBLISHED = [
    ((1206, 193, 392, 209), (0.7075, 0.5199, 0.3478, 0.4167, 0.2400)),
    ((1067, 332, 194, 407), (0.7370, 0.5507, 0.6772, 0.6075, 0.4178)),
    ((1377, 22, 582, 19), (0.6980, 0.4634, 0.0316, 0.0592, 0.0514)),
    ((1375, 24, 557, 44), (0.7095, 0.6471, 0.0732, 0.1315, 0.1418)),
]


@pytest.mark.parametrize("cells, scores", PUBLISHED)
def test_published_scores(spark, cells, scores):
    counts = spark.createDataFrame([cells], "tn bigint, fp bigint, fn bigint, tp bigint")
    row = metrics.confusion_metrics(counts).first()
    assert [row[c] for c in ("accuracy", "precision", "recall", "f1", "mcc")] == pytest.approx(scores, abs=6e-5)


def test_ranking_metrics_against_definitions(spark):
    rng = np.random.default_rng(5)
    label, score = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    df = spark.createDataFrame([(int(a), int(b > 0.5), float(b)) for a, b in zip(label, score)], "label int, prediction int, score double")
    pos, neg = score[label == 1], score[label == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    precision, ap, recall = 0.0, 0.0, 0.0
    for cut in sorted(set(score), reverse=True):
        hit = label[score >= cut]
        precision, new_recall = hit.mean(), hit.sum() / label.sum()
        ap, recall = ap + (new_recall - recall) * precision, new_recall
    row = metrics.classification_metrics(df).first()
    assert row["roc_auc"] == pytest.approx(auc) and row["pr_auc"] == pytest.approx(ap)
    assert row["tp"] == int(((label == 1) & (score > 0.5)).sum())
    points = metrics.roc_points(df).orderBy("tpr", "fpr").collect()
    assert len(points) == len(set(score)) + 1 and (points[-1]["fpr"], points[-1]["tpr"]) == (1.0, 1.0)


def test_one_class_only(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "label int, prediction int, score double")
    row = metrics.classification_metrics(df).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None and row["mcc"] == 0.0 and row["accuracy"] == 1.0
    assert metrics.roc_points(df).count() == 3


def cloud(spark, n=200, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 3
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "commit_id bigint, embedding array<double>")


def test_pca_equals_svd(spark, tmp_path):
    x, df = cloud(spark)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    model = pca.pca_fit_or_load(df, str(tmp_path / "m"), k=3, sample_rows=None)
    mean, components, shares = pca.pca_parts(pca.pca_fit_or_load(df, str(tmp_path / "m")))
    assert mean == pytest.approx(x.mean(axis=0)) and shares == pytest.approx((s**2 / (s**2).sum())[:3])
    assert np.abs(np.sum(components.T * vt[:3], axis=1)) == pytest.approx(np.ones(3))
    restored = pca.pca_inverse(pca.pca_transform(df, model), model).orderBy("commit_id").collect()
    expected = centred @ vt[:3].T @ vt[:3] + x.mean(axis=0)
    assert np.array([r["embedding"] for r in restored]) == pytest.approx(expected)


def test_sweep_and_recommendation(spark):
    x, df = cloud(spark)
    sweep = pca.pca_sweep(df, components=[8, 6, 4, 2])
    rows = {r["n_components"]: r for r in sweep.collect()}
    assert rows[8]["status"].startswith("skipped") and rows[8]["explained_variance_ratio"] is None
    assert rows[6]["train_reconstruction_mse"] == pytest.approx(0, abs=1e-12)
    assert rows[2]["test_reconstruction_mse"] > rows[4]["test_reconstruction_mse"] > 0
    from changerisk.operators.split import random_holdout

    train, test = (np.array([r["embedding"] for r in part.collect()]) for part in random_holdout(df, "commit_id"))
    _, _, vt = np.linalg.svd(train - train.mean(axis=0), full_matrices=False)
    lost = (test - train.mean(axis=0)) - (test - train.mean(axis=0)) @ vt[:2].T @ vt[:2]
    assert rows[2]["test_reconstruction_mse"] == pytest.approx((lost**2).mean())
    assert pca.pca_recommend(sweep, 0.0).first()["n_components"] == 2
    assert pca.pca_recommend(sweep, 2.0).first()["n_components"] == 6
    assert pca.pca_recommend(sweep.filter("status <> 'ok'")).first()["n_components"] is None


def test_vector_statistics(spark):
    x, df = cloud(spark)
    shares = vectors.variance_share(vectors.dimension_stats(df)).orderBy("rank").collect()
    v = x.var(axis=0)
    assert [r["dimension"] for r in shares] == list(np.argsort(-v)) and shares[-1]["cumulative_share"] == pytest.approx(1)
    p = v / v.sum()
    frame = vectors.variance_share(vectors.dimension_stats(df))
    assert vectors.effective_rank(frame).first()[0] == pytest.approx(math.exp(-(p * np.log(p)).sum()))
    corr = np.corrcoef(x, rowvar=False)
    for row in vectors.correlation_pairs(df).collect():
        assert row["correlation"] == pytest.approx(corr[row["dimension_a"], row["dimension_b"]])
    flat = df.select("commit_id", F.array(F.lit(1.0), F.col("embedding")[0]).alias("embedding"))
    assert vectors.correlation_pairs(flat).first()["correlation"] == 0.0


def test_embed_text(spark):
    df = spark.createDataFrame([(1, "One two  two"), (2, None)], "k int, input_text string")
    rows = {r["k"]: r["embedding"] for r in embedding.embed_text(df, size=16).collect()}
    assert sum(v * v for v in rows[1]) == pytest.approx(1, abs=1e-6) and set(rows[2]) == {0.0}


def plain_vector(words, size):
    counts = np.zeros(size)
    for word in words:
        digest = hashlib.md5(word.encode()).hexdigest()
        counts[int(digest[:8], 16) % size] += -1 if int(digest[8], 16) % 2 else 1
    return counts / (np.linalg.norm(counts) or 1.0)


@pytest.mark.parametrize("size, most", [(768, None), (16, None), (768, 256), (5, 1)])
def test_vectors_are_signed_word_counts(spark, size, most):
    """256 words are the bound of a transformer with short inputs."""
    texts = [None, "", " \n\t", "One two  two", "Ünï\u00a0cödé x\u0085y", "w " * 400 + "tail"] + [f"a b{i} c{i % 7} " * i for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, input_text string").repartition(3)
    found = {r["k"]: r["embedding"] for r in embedding.embed_text(df, size=size, max_tokens=most).collect()}
    for k, text in enumerate(texts):
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w][:most]
        assert np.asarray(found[k]) == pytest.approx(plain_vector(words, size), abs=1e-6)


@dataclass(frozen=True)
class Counting(embedding.TextEncoder):
    """Tells how often its worker was set up, how many texts came at once, and their bytes."""

    size: int = 4
    batch_rows: int = 8
    batch_bytes: int = 100

    def setup(self):
        return {"calls": 0, "id": np.random.default_rng().integers(1 << 20)}

    def encode(self, state, texts):
        state["calls"] += 1
        total = sum(len(t.encode()) for t in texts)
        return np.array([[len(texts), total, state["id"], state["calls"]]] * len(texts), "f4")


def test_encoder_is_set_up_once_a_worker_and_gets_bounded_batches(spark):
    cloudpickle.register_pickle_by_value(sys.modules[Counting.__module__])
    texts = ["x" * (i % 60) for i in range(400)] + ["y" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, input_text string").coalesce(1)
    rows = [r["embedding"] for r in embedding.embed_text(df, encoder=Counting()).collect()]
    assert all(n <= 8 and (total <= 100 or n == 1) for n, total, _, _ in rows)
    assert len({state for _, _, state, _ in rows}) == 1 and max(calls for *_, calls in rows) > 50


def test_texts_in_batches():
    texts = ["a" * n for n in (3, 4, 50, 1, 1, 1, 0)]
    assert list(embedding.text_batches(texts, 3, 10)) == [texts[:2], texts[2:3], texts[3:6], texts[6:]]


def test_encoding(spark):
    vocabulary = {"intent": ("bug_fix", "refactoring")}
    df = spark.createDataFrame([("a", "Bug_Fix ", "critical", 1.7), ("b", "other", "odd", 0.3)], "commit_id string, intent string, risk_level string, confidence_score double")
    rows = {r["commit_id"]: r for r in fusion.encode_reasoning(df, vocabulary=vocabulary).collect()}
    assert (rows["a"]["intent_bug_fix"], rows["a"]["risk_level"], rows["a"]["confidence_score"]) == (1, 3, 1.0)
    assert (rows["b"]["intent_bug_fix"], rows["b"]["intent_refactoring"], rows["b"]["risk_level"]) == (0, 0, None)


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "buggy int")
    assert {r["buggy"]: r["weight"] for r in models.class_weights(df).collect()} == {0: pytest.approx(8 / 12), 1: 2.0}
    assert models.scale_pos_weight(df) == 3.0 and models.scale_pos_weight(df.filter("buggy = 0")) == 1.0
    with pytest.raises(ChangeRiskError):
        models.model_factory("nope")


def test_experiment_learns_and_saves(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"c{i:04d}", "p" if i % 2 else "q", dt.datetime(2019, 1, 1) + dt.timedelta(hours=i), int(v > 0.6), float(v), float(rng.random())) for i, v in enumerate(rng.random(400))]
    commits = spark.createDataFrame(rows, "commit_id string, project string, author_date timestamp, buggy int, la double, ld double")
    vectors_table = commits.select("commit_id", F.array("la", "ld").alias("embedding"))
    sources = {"metrics": (None, ["la", "ld"]), "vectors": (vectors_table, ["embedding"])}
    params = {"random_forest": {"num_trees": 5, "max_depth": 4}, "boosted_trees": {"rounds": 2, "max_depth": 2}}
    outcome = run_experiment(4, commits, sources, target_rows=300, params=params)
    assert outcome.features == ["la", "ld", "embedding_1", "embedding_2"]
    comparison = {r["model"]: r for r in outcome.comparison.collect()}
    assert set(comparison) == {"random_forest", "boosted_trees"} and comparison["random_forest"]["roc_auc"] > 0.95
    joined = outcome.predictions["random_forest"].join(commits, "commit_id")
    assert joined.filter("y_true <> buggy").count() == 0 and joined.count() == 80
    outcome.save(str(tmp_path / "out"))
    assert models.load_model(str(tmp_path / "out/models/boosted_trees")).getNumTrees == 2
    wide = outcome.wide.join(outcome.predictions["boosted_trees"], "commit_id")
    assert wide.count() == 80 and wide.filter("boosted_trees_score <> y_score or boosted_trees_pred <> y_pred").count() == 0
    with pytest.raises(ChangeRiskError):
        run_experiment(3, commits, sources)


def test_experiment_fills_joined_sources_and_counts_lost_rows(spark):
    rows = [(f"c{i:03d}", "p", dt.datetime(2019, 1, 1) + dt.timedelta(hours=i), i % 2) for i in range(100)]
    commits = spark.createDataFrame(rows, "commit_id string, project string, author_date timestamp, buggy int")
    facts = [(f"c{i:03d}", None if i % 5 == 0 else float(i % 2), None if i % 7 == 0 else [float(i % 2), 1.0]) for i in range(95)]
    table = spark.createDataFrame(facts, "commit_id string, la double, embedding array<double>")
    sources = {"metrics": (table.drop("embedding"), ["la"]), "vectors": (table.drop("la"), ["embedding"])}
    params = {"random_forest": {"num_trees": 5, "max_depth": 4}, "boosted_trees": {"rounds": 2, "max_depth": 2}}
    outcome = run_experiment(4, commits, sources, params=params)
    assert outcome.lost_rows == 5 and outcome.wide.count() == 15


def test_experiment_makes_only_wanted_sources_for_the_commits_that_tables_have(spark):
    rows = [(f"c{i:03d}", "p", dt.datetime(2019, 1, 1) + dt.timedelta(hours=i), i % 2) for i in range(100)]
    commits = spark.createDataFrame(rows, "commit_id string, project string, author_date timestamp, buggy int")
    table = spark.createDataFrame([(f"c{i:03d}", [float(i % 2), 1.0]) for i in range(90)], "commit_id string, embedding array<double>")
    made = []

    def metrics_of(asked):
        made.append({r["commit_id"] for r in asked.collect()})
        return asked.selectExpr("commit_id", "1.0D AS la")

    sources = {"metrics": (metrics_of, ["la"]), "vectors": (table, ["embedding"])}
    params = {"random_forest": {"num_trees": 5, "max_depth": 4}, "boosted_trees": {"rounds": 2, "max_depth": 2}}
    assert run_experiment(2, commits, sources, params=params).wide.count() == 10 and made == []
    assert run_experiment(4, commits, sources, params=params).lost_rows == 10
    assert made == [{f"c{i:03d}" for i in range(90)}]


def test_an_experiment_trains_on_all_rows_unless_asked_for_a_sample(spark):
    number = F.col("id")
    commits = spark.range(13_000).select(
        F.format_string("c%05d", number).alias("commit_id"), F.lit("p").alias("project"),
        F.timestamp_seconds(1_550_000_000 + number * 60).alias("author_date"), (number % 2).cast("int").alias("buggy"), (number % 2).alias("la"),
    )
    params = {"random_forest": {"num_trees": 2, "max_depth": 2}, "boosted_trees": {"rounds": 1, "max_depth": 2}}
    for options, rows in (({}, 10_400), ({"target_rows": 500}, 500)):
        outcome = run_experiment(1, commits, {"metrics": (None, ["la"])}, params=params, **options)
        assert {r["side"]: r["rows"] for r in outcome.split.groupBy("side").agg(F.sum("rows").alias("rows")).collect()} == {"train": rows, "test": 2600}


def test_the_query_of_metrics_and_reasoning_trains_on_all_rows_at_full_size(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(learning, "run_experiment", lambda *args, **options: (asked.append(options), run_experiment)[1])
    with pytest.raises(AttributeError):  # no outcome
        learning.experiment_metrics_reasoning(Tables(spark, "/root/testdata/sf0.001"))
    assert asked == [{"first_year": 1995, "last_year": 2001}]


def test_the_leafwise_query_trains_at_full_size(spark):
    model, _ = learning.fitted(Tables(spark, "/root/testdata/sf0.001"), "boosted_trees_fine")
    assert len(model.trees) == LeafwiseBoosting().growth.rounds == 100
    # Both labels are frequent, so leaves of the first tree move by about twice the rate, 0.1.
    assert max(abs(value) for value in model.trees[0].value) < 0.4


def test_vectors_come_in_bounded_parts():
    """A task holds vectors of one encoder batch, not of all texts that it was sent."""
    texts = pa.array([f"w{i} x" if i % 7 else None for i in range(2500)])
    encoder = embedding.HashingEncoder(16)
    parts = list(embedding.encoded(encoder, texts))
    assert [len(part) for part in parts] == [1000, 1000, 500]
    whole = encoder.encode(encoder.setup(), [text or "" for text in texts.to_pylist()]).astype("f4")
    assert np.array_equal(np.concatenate([part.flatten().to_numpy() for part in parts]).reshape(2500, 16), whole)
    assert list(embedding.encoded(encoder, texts[:0])) == []


def test_a_memo_holds_few_words_at_a_time(monkeypatch):
    monkeypatch.setattr(embedding, "MEMO_WORDS", 10)
    encoder, state = embedding.HashingEncoder(16, scaled=False), {}
    text = " ".join(f"w{i % 37}" for i in range(200))
    expected = np.zeros(16)
    for word in text.encode().split():
        place, sign = encoder.place(word)
        expected[place] += sign
    assert np.array_equal(encoder.encode(state, [text])[0], expected) and len(state) <= 10


def test_incremental_append_resumes(spark, tmp_path):
    source, output, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    spark.range(0, 10).union(spark.range(5, 10)).withColumnRenamed("id", "commit_id").write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run(checkpoint):
        incremental.incremental_extract(incremental.file_stream(spark, source, schema), output, checkpoint)
        return sorted(r["commit_id"] for r in spark.read.parquet(output).collect())

    assert run(progress) == list(range(10))
    spark.range(8, 14).withColumnRenamed("id", "commit_id").write.mode("append").parquet(source)
    assert run(progress) == list(range(14))
    assert run(progress) == list(range(14))
    spark.range(20, 22).withColumnRenamed("id", "commit_id").write.mode("append").parquet(source)
    assert run(str(tmp_path / "other")) == [*range(14), 20, 21]  # a new checkpoint reads all again and loses nothing
    spark.range(30, 31).withColumnRenamed("id", "commit_id").write.mode("append").parquet(source)
    assert run(progress) == [*range(14), 20, 21, 30]


def test_incremental_append_ignores_progress_without_output(spark, tmp_path):
    source, output, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    spark.range(5).withColumnRenamed("id", "commit_id").write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run(**options):
        incremental.incremental_extract(incremental.file_stream(spark, source, schema), output, progress, **options)
        return sorted(r["commit_id"] for r in spark.read.parquet(output).collect())

    assert run() == list(range(5))
    remove_path(spark, output)
    assert run() == list(range(5))
    spark.createDataFrame([(99,)], "commit_id bigint").write.mode("overwrite").parquet(source)
    assert run() == [*range(5), 99]
    assert run(overwrite=True) == [99]


def test_incremental_append_chooses_one_row_per_key(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 3, "c"), (1, 1, None), (1, 1, "a"), (2, 5, "x")], "commit_id bigint, n int, t string").write.parquet(source)
    stream = incremental.file_stream(spark, source, spark.read.parquet(source).schema)
    incremental.incremental_extract(stream, output, str(tmp_path / "p"), order_by=["n"])
    assert {tuple(r) for r in spark.read.parquet(output).select("commit_id", "n", "t").collect()} == {(1, 1, "a"), (2, 5, "x")}


def test_batches_read_no_output(spark, tmp_path):
    """A start reads its rows and the keys written since the last one, however much was written before."""
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "commit_id bigint, n int"
    read = []
    for low in (0, 1000, 2000, 3000):
        spark.range(low - 5 if low else 0, low + 1000).selectExpr("id as commit_id", "1 as n").coalesce(1).write.mode("append").parquet(source)
        stream = incremental.file_stream(spark, source, schema)
        read.append(sum(incremental.incremental_extract(stream, output, str(tmp_path / "p"))))
    assert spark.read.parquet(output).count() == 4000 and read[3] <= 1.1 * read[1]
    stream = incremental.file_stream(spark, source, schema)
    again = incremental.incremental_extract(stream, output, str(tmp_path / "q"))
    assert spark.read.parquet(output).count() == 4000 and sum(again) >= 4000


def test_state_of_keys_counts_no_rows(spark):
    """A count of the rows in the store costs a look-up for each key that is written."""
    name = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    before = spark.conf.get(name, None)
    with incremental._keyed_state(spark):
        assert spark.conf.get(name) == "false"
    assert spark.conf.get(name, None) == before


def test_a_batch_that_fails_is_repeated_whole(spark, tmp_path):
    """The state of a failed batch is not kept, so the next run writes its keys."""
    source, output, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    spark.range(20).withColumnRenamed("id", "commit_id").write.parquet(source)
    schema = spark.read.parquet(source).schema

    def broken(rows):
        return rows.filter(F.raise_error(F.lit("stop")).isNull())

    with pytest.raises(Exception):
        incremental.incremental_append(incremental.file_stream(spark, source, schema), output, progress, "commit_id", broken)
    spark.createDataFrame([(-1,)], "commit_id bigint").write.parquet(f"{output}/run=other/batch=0")
    incremental.incremental_append(incremental.file_stream(spark, source, schema), output, progress, "commit_id")
    assert sorted(r["commit_id"] for r in spark.read.parquet(output).collect()) == [-1, *range(20)]


def test_null_keys_and_odd_columns(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(None, 2, "a"), (None, 1, "b"), (1, 1, "c")]
    spark.createDataFrame(rows, "key bigint, kind int, `row` string").write.parquet(source)
    for progress in ("p", "q"):
        stream = incremental.file_stream(spark, source, spark.read.parquet(source).schema)
        incremental.incremental_append(stream, output, str(tmp_path / progress), "key", order_by=["kind"])
    found = [tuple(r) for r in spark.read.parquet(output).select("key", "kind", "row").collect()]
    assert sorted(found, key=str) == [(1, 1, "c"), (None, 1, "b")]


def test_table_stream_reads_a_file_and_a_folder(spark, tmp_path):
    """A large table is a folder of files under the name that a small one has as a file."""
    folder, file = tmp_path / "a" / "rows.parquet", tmp_path / "b" / "rows.parquet"
    spark.range(100).repartition(3).write.parquet(str(folder))
    spark.range(900, 905).write.parquet(str(tmp_path / "a" / "others.parquet"))
    file.parent.mkdir()
    spark.range(100).toPandas().to_parquet(file)
    for path in (folder, file):
        output = str(tmp_path / f"out-{path.parent.name}")
        stream = incremental.table_stream(spark, str(path), "id bigint")
        incremental.run_available(stream, output, str(tmp_path / f"progress-{path.parent.name}"))
        assert sorted(r["id"] for r in spark.read.parquet(output).collect()) == list(range(100))


@pytest.mark.parametrize("name, most", [("random_forest", 12 * models.DRAWS), ("boosted_trees", 12)])
def test_training_costs_no_more_than_its_different_rows(spark, monkeypatch, name, most):
    rows = spark.range(6000).selectExpr("cast(id % 4 as double) as a", "array(cast(id % 3 as double), 0D) as v", "cast(id % 4 > 1 as int) as buggy")
    kind = type(models.model_factory(name))
    seen, fit = [], kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, df: (seen.append((df.count(), df.agg(F.sum("_weight")).first()[0])), fit(self, df))[1])
    options = {"random_forest": {"num_trees": 3, "max_depth": 3}, "boosted_trees": {"rounds": 3}}[name]
    model = models.train(name, rows, ["a", "v"], weight=F.when(F.col("buggy") == 1, 2.0).otherwise(1.0), **options)
    assert seen[0][0] <= most and seen[0][1] == pytest.approx(9000)
    scored = models.predictions(model, rows.withColumn("commit_id", F.lit(1)), ["a", "v"], ["commit_id"])
    assert scored.filter("y_true <> y_pred").count() == 0
    models.train(name, rows, ["a", "v"], minInstancesPerNode=2, **options)
    assert seen[1][0] == 6000  # rows are counted, so each is needed


def test_merged_rows_keep_every_row_where_few_are_equal(spark):
    rows = spark.range(1000).selectExpr("cast(id % 600 as double) as a", "1D as w")
    assert models.merged_rows(rows, "w").count() == 1000
    merged = models.merged_rows(rows.union(rows).union(rows), "w")
    assert merged.count() == 600 and merged.agg(F.sum("w")).first()[0] == 3000


def test_whole_numbers_far_apart_are_ranked_exactly(spark):
    for low, high in ((-(2**63), 2**63 - 1), (0, 2**62 - 1), (5, 5)):
        values = sorted({low, (low + high) // 2, high})
        df = spark.createDataFrame([(v,) for v in values], "v bigint")
        for rank, value in enumerate(values):
            found = selection.ranked_values(df, {"v": (F.col("v"), rank)}, {"v": (low, high)}, exact=True)["v"]
            assert (found.value, found.below, found.equal) == (value, rank, 1)
