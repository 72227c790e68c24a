"""Cleaning, sampling, splitting, order statistics, sources."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changerisk.errors import ChangeRiskError, EmptyInputError, MissingColumnsError, SchemaMismatchError
from changerisk.operators import clean, joins, ordering, profile, sampling, selection, split
from changerisk.operators.history import commit_time
from changerisk.plans.catalog import QUERIES
from changerisk.sources import sinks, tables


def numbers(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"k bigint, v {kind}")


def test_positions_and_running_sums(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 50) for _ in range(400)]
    df = numbers(spark, values, "bigint").repartition(5)
    placed, total = ordering.with_position(df, [F.col("v"), F.col("k")])
    expected = {k: i for i, (v, k) in enumerate(sorted((v, k) for k, v in enumerate(values)))}
    assert total == 400 and {r["k"]: r["pos"] for r in placed.collect()} == expected
    summed = ordering.running_sums(df, [F.desc("v"), F.col("k")], {"upto": "v"})
    running, want = 0, {}
    for v, k in sorted(((v, k) for k, v in enumerate(values)), key=lambda x: (-x[0], x[1])):
        running += v
        want[k] = running
    assert {r["k"]: r["upto"] for r in summed.collect()} == want


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [0.0] * 50 + [1e9, -1e9, 3.5], np.random.default_rng(0).normal(size=501).tolist() + [None] * 3])
def test_quantiles_are_exact(spark, values):
    df = numbers(spark, values)
    known = [v for v in values if v is not None]
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert selection.quantiles(df, {"v": F.col("v")}, p)["v"] == pytest.approx(np.quantile(known, p), abs=1e-12)


def test_quantile_of_nothing(spark):
    assert selection.quantiles(numbers(spark, [None, None]), {"v": F.col("v")}, 0.5) == {"v": None}


@pytest.mark.parametrize("k", [0, 1, 4, 5, 6, 9, 10, 12])
def test_first_rows_with_ties_and_nulls(spark, k):
    df = numbers(spark, [7, 3, 3, 3, 3, None, 1, None, 9, 3, 2, 8], "bigint")
    rows = sorted(df.collect(), key=lambda r: (r["v"] is None, r["v"] or 0, r["k"]))
    kept = df.filter(selection.first_rows(df, F.col("v"), ["k"], k)).collect()
    assert sorted(r["k"] for r in kept) == sorted(r["k"] for r in rows[:k])


@pytest.mark.parametrize("start", [2**60, -(2**63), 2**63 - 3001])
def test_first_rows_of_large_keys(spark, start):
    df = spark.range(start, start + 3000).withColumnRenamed("id", "k")
    assert sampling.head_sample(df, "k", 1500).agg(F.count("*"), F.max("k")).first() == (1500, start + 1499)
    ends = spark.createDataFrame([(-(2**63), 1), (0, 2), (2**63 - 1, 3)], "v bigint, k int")
    assert ends.filter(selection.first_rows(ends, F.col("v"), ["k"], 2)).count() == 2


def test_zoom_reads_small_bins_and_narrows_large_ones(spark, monkeypatch):
    values = [float(v) for v in np.random.default_rng(1).lognormal(3, 4, 500)] + [5.0] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for few in (0, 10, 65_536):
        monkeypatch.setattr(selection, "_READ_ROWS", few)
        assert selection.quantiles(df, {"v": F.col("v")}, 0.5)["v"] == pytest.approx(float(np.median(values)))


def test_known_values_win_over_missing_ones(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 9), ("b", None, 1), ("b", 4, 2)], "id string, buggy int, x int")
    assert {tuple(r) for r in clean.dedupe_by_key(df.select("id", "x"), "id").collect()} == {("a", 5), ("b", 1)}
    copies = spark.createDataFrame([("a", None, 1), ("a", 1, 2)], "commit_id string, buggy int, x int")
    cleaned, report = clean.clean_commits(copies, ["x"])
    assert [tuple(r) for r in cleaned.collect()] == [("a", 1, 2)] and report.first()["missing_after"] == {"x": 0}


def test_missing_after_is_counted(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 0, 1.0)], "commit_id string, buggy int, x double")
    _, report = clean.clean_commits(df, ["x"], explicit={"x": float("nan")})
    assert report.first()["missing_after"] == {"x": 1}


def test_dates_with_nan_texts(spark):
    df = spark.createDataFrame([("NaN",), ("2020-01-01",), ("2021-01-01",), ("inf",)], "author_date string")
    years = [r[0] for r in tables.parse_dates(df).select(F.year("author_date")).collect()]
    assert years == [None, 2020, 2021, None]
    numbers = spark.createDataFrame([("NaN",), ("86400",)], "author_date string")
    assert [r[0] for r in tables.parse_dates(numbers).select(F.unix_seconds("author_date")).collect()] == [None, 86400]


def test_years_are_utc_in_any_session(spark):
    df = spark.sql("SELECT timestamp_seconds(1577840400) AS author_date")  # 2020-01-01T01:00Z
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert commit_time(df).first()["year"] == 2020
        assert sampling.filter_years(df, first=2020, last=2020).count() == 1
        assert sampling.filter_years(df, first=2019, last=2019).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_both_ways_of_dedupe_agree(spark, monkeypatch, keep):
    dice = random.Random(8)
    pick = lambda *values: dice.choice(values)
    rows = [
        (pick(None, *range(12), *range(100, 400)), pick(None, 1, 2), pick(None, float("nan"), 0.5), pick(None, "x", "y"), pick(None, "m" * 99, "n"))
        for _ in range(900)
    ]
    df = spark.createDataFrame(rows, "id int, o int, x double, buggy string, message string").repartition(6)
    narrow = clean.dedupe_by_key(df, "id", ["o"], keep, prefer=["buggy"])
    monkeypatch.setattr(clean, "is_small", lambda frozen: False)
    monkeypatch.setattr(clean, "broadcast_if_small", lambda frozen: frozen)
    whole = clean.dedupe_by_key(df, "id", ["o"], keep, prefer=["buggy"])
    assert sorted(map(repr, narrow.collect())) == sorted(map(repr, whole.collect()))
    assert narrow.columns == df.columns and narrow.count() == len({r[0] for r in rows if keep or [q[0] for q in rows].count(r[0]) == 1})
    # Rows that share no key go through broadcast joins alone.
    single = df.dropDuplicates(["id"])
    assert clean.dedupe_by_key(single, "id", ["o"], keep).count() == single.count()
    assert clean.dedupe_by_key(df.limit(0), "id", ["o"], keep).collect() == []


def test_select_features(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, buggy int")
    assert clean.select_features(df, ["b"], keep=["a"]).columns == ["a", "b", "buggy"]
    with pytest.raises(MissingColumnsError):
        clean.select_features(df, ["c"])


def test_dedupe(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n"), (None, 2, "m")], "id string, o int, t string")

    def kept(how):
        return sorted(r["t"] for r in clean.dedupe_by_key(df, "id", ["o"], how).collect())

    assert kept("first") == ["n", "x", "z"] and kept("last") == ["m", "y", "z"] and kept(False) == ["z"]


@pytest.mark.parametrize("strategy, value", [("median", 2.5), ("mean", 2.75), ("mode", 2.0), ("zero", 0.0), ("other", 2.5)])
def test_impute(spark, strategy, value):
    df = spark.createDataFrame(
        [(3.0, None, 1), (2.0, None, 2), (None, None, 3), (4.0, None, 4), (2.0, None, 5), (float("nan"), None, 6)], "a double, b double, c int"
    )
    rows = clean.impute(df, ["a", "b", "c"], strategy).collect()
    assert sorted(r["a"] for r in rows) == sorted([3.0, 2.0, 4.0, 2.0, value, value])
    assert {r["b"] for r in rows} == {0.0} and sorted(r["c"] for r in rows) == [1, 2, 3, 4, 5, 6]
    assert {r["a"] for r in clean.impute(df, ["a"], explicit={"a": -1}).filter("a < 0").collect()} == {-1.0}


def test_clean_reports(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("b", None, 2.0), ("c", 0, None), ("d", 1, 5.0)], "commit_id string, buggy int, la double")
    cleaned, report = clean.clean_commits(df, ["la"])
    r = report.first()
    assert (r["initial_rows"], r["duplicates_removed"], r["rows_removed_missing_target"], r["final_rows"]) == (5, 1, 1, 3)
    assert r["missing_before"] == {"la": 1} and r["missing_after"] == {"la": 0} and r["imputed_values"] == {"la": 3.0}
    assert sorted((x["commit_id"], x["la"]) for x in cleaned.collect()) == [("a", 1.0), ("c", 3.0), ("d", 5.0)]
    with pytest.raises(MissingColumnsError):
        clean.clean_commits(df, ["nope"])


def test_strata(spark):
    rows = [(i, "big", 0) for i in range(70)] + [(100 + i, "big", 1) for i in range(25)] + [(200, "tiny", 1)] + [(300 + i, None, 0) for i in range(4)]
    df = spark.createDataFrame(rows, "commit_id bigint, project string, buggy int")
    quotas = {(r["project"], r["buggy"]): r["target_count"] for r in sampling.stratum_targets(df, target_rows=50).collect()}
    assert quotas == {("big", 0): 35, ("big", 1): 12, ("tiny", 1): 1}  # 12.5 rounds to even
    sample = sampling.stratified_sample(df, target_rows=50)
    assert {(r[0], r[1]): r[2] for r in sample.groupBy("project", "buggy").count().collect()} == quotas
    again = sampling.stratified_sample(df.repartition(7), target_rows=50)
    assert sorted(sample.collect()) == sorted(again.collect())
    assert sampling.stratified_sample(df, target_rows=10_000).count() == 96
    with pytest.raises(EmptyInputError):
        sampling.stratified_sample(df.filter("commit_id < 0"))


def test_years_and_split(spark):
    start = dt.datetime(2017, 12, 30)
    rows = [(i, start + dt.timedelta(days=i // 2), i % 3 == 0) for i in range(41)] + [(90, None, True), (91, None, False)]
    df = spark.createDataFrame(rows, "commit_id bigint, author_date timestamp, buggy boolean")
    assert sampling.filter_years(df).count() == 37
    train, test = split.temporal_split(df)
    assert (train.count(), test.count()) == (34, 9)
    assert train.agg(F.max("author_date")).first()[0] <= test.agg(F.min("author_date")).first()[0]
    assert {90, 91} <= {r["commit_id"] for r in test.collect()}
    for bad in (0.0, 1.0):
        with pytest.raises(ChangeRiskError):
            split.temporal_split(df, fraction=bad)
    a, b = split.random_holdout(df, "commit_id")
    assert (a.count(), b.count()) == (34, 9) and a.join(b, "commit_id").count() == 0


def test_split_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(500).selectExpr("id commit_id", "timestamp_seconds(id * 86400) author_date", "cast(id % 2 as int) buggy").write.parquet(path)
    train, _ = split.temporal_split(spark.read.parquet(path))
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "author_date" in plan.split("PushedFilters")[1]


def test_subset_sizes(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    assert sampling.random_subset(df, "k", 10).count() == 10
    assert sampling.random_subset(df, "k", 2000).count() == 2000
    assert sampling.random_subset(df, "k", 9999).count() == 3000
    assert [r["k"] for r in sampling.head_sample(df, "k", 1500).agg(F.max("k").alias("k")).collect()] == [1499]
    words = df.select(F.format_string("%05d", "k").alias("k"))
    assert sampling.head_sample(words, "k", 1200).agg(F.count("*"), F.max("k")).first() == (1200, "01199")
    assert sorted(r["k"] for r in sampling.skip_tail(df, "k").collect()) == list(range(1895, 1900))


@pytest.mark.parametrize("few", [0, 5, 65_536])
def test_head_of_texts(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "_READ_ROWS", few)
    texts = ["", "a", "ab", "aba", "abb", "b", "é", "é\u0301", "漢字", "😀", "zz" * 40, "zz" * 41] + [f"x{i:03d}" for i in range(60)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, None]], "k string")
    ordered = sorted(texts, key=str.encode)
    for n in (0, 1, 2, 3, 7, 40, len(texts), len(texts) + 1, len(texts) + 2, 500):
        found = [r["k"] for r in sampling.head_sample(df, "k", n).collect()]
        assert sorted((t for t in found if t is not None), key=str.encode) == ordered[:n] and len(found) == min(n, len(texts) + 2)
    numbers = spark.createDataFrame([(5,), (1,), (None,), (3,), (None,)], "k int")
    doubles = numbers.select(F.col("k").cast("double").alias("k"))
    for table in (numbers, doubles):
        sizes = [sampling.head_sample(table, "k", n).agg(F.count("*"), F.max("k")).first() for n in (0, 2, 3, 4, 9)]
        assert [tuple(s) for s in sizes] == [(0, None), (2, 3), (3, 5), (4, 5), (5, 5)]
    assert sampling.head_sample(df.limit(0), "k", 3).collect() == []


def test_joins(spark):
    a = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "project string, commit_id int")
    listed = spark.createDataFrame([("p", 1), ("p", 1)], "project string, commit_id int")
    assert joins.semi_commits(a, listed).count() == 1
    assert joins.pending_rows(a, listed).count() == 1
    assert joins.duplicate_rows(a.union(a).union(a)).first()[0] == 6
    times = spark.sql("SELECT timestamp_micros(1) AS t, null AS x UNION ALL SELECT timestamp_micros(2), null")
    assert joins.duplicate_rows(times).first()[0] == 0
    assert joins.union_datasets(a, a).count() == 6
    with pytest.raises(SchemaMismatchError):
        joins.union_datasets(a, a.select("commit_id", "project"))


def test_histogram_counts_all_values(spark):
    df = numbers(spark, [0.0, 1.0, 2.0, 10.0, None])
    bins = profile.histogram(df, F.col("v"), 5).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [2, 1, 0, 0, 1] and bins[-1]["high"] == 10.0
    assert sum(r["count"] for r in profile.histogram(numbers(spark, [3.0, 3.0]), F.col("v"), 5).collect()) == 2


@pytest.mark.parametrize("factor, text", [(1, "1600000000"), (10**3, "1600000000123"), (10**9, "1600000000123456789")])
def test_epoch_units(spark, factor, text):
    df = spark.createDataFrame([(text,), ("garbage",)], "author_date string")
    got = [r[0] for r in tables.parse_dates(df).select(F.unix_micros("author_date")).collect()]
    assert got == [int(text) * 10**6 // factor, None]


def test_mostly_text_dates_are_not_epochs(spark):
    df = spark.createDataFrame([("2020-01-02 03:04:05",)] * 30 + [("12",)], "author_date string")
    parsed = tables.parse_dates(df)
    assert parsed.filter("author_date is null").count() <= 1
    assert parsed.filter("year(author_date) = 2020").count() == 30


def test_csv_round_trips(spark, tmp_path):
    rows = [("a", 'say "hi"', "x,y\nz"), ("b", "back\\slash", "plain")]
    df = spark.createDataFrame(rows, "commit_id string, message string, diff string")
    sinks.write_dataset(df, str(tmp_path / "plain"))
    sinks.write_csv_quoted(df, str(tmp_path / "quoted"))
    plain = tables.load_commits(spark, str(tmp_path / "plain"), required=["commit_id"], schema=df.schema)
    assert sorted(map(tuple, plain.collect())) == sorted(rows)
    quoted = spark.read.options(header=True, multiLine=True, escape="\\").csv(str(tmp_path / "quoted"))
    assert sorted(r["commit_id"] for r in quoted.collect()) == ["a", "b"]
    with pytest.raises(MissingColumnsError) as error:
        tables.load_commits(spark, str(tmp_path / "plain"))
    assert error.value.missing == ["author_date", "buggy", "project"]
    assert tables.load_optional(spark, str(tmp_path / "none")) is None
    with pytest.raises(SchemaMismatchError):
        tables.validate_schema(df)


ODD_TEXTS = (
    ["", None, " ", " pad ", "\ttab\t", "\n", "\na\n", "a\rb", "\r", "end\r", "\r\n", "a\r\nb\n", "\\", 'a\\"b', '"', '""', 'say "hi"', '"\n"']
    + ["x,y", "\x00", '"\x00"', "\uffff", "\ue000b\uffff,\ue000a", "\ufeffbom", "\x1c x", "\u3000", "null", "'", "#", "word " * 1000]
)


def odd_documents(spark, folder):
    """What ``documents`` may hold, in one file, and the MD5 of each text."""
    langs = ["en", "", None, " fr ", '"d",e']
    rows = [(i, text, langs[i % 5], None if text is None else len(text)) for i, text in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint")
    df.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return {(i, lang, None if text is None else hashlib.md5(text.encode()).hexdigest(), size) for i, text, lang, size in rows}


def test_odd_texts_are_written_as_they_are(spark, tmp_path):
    expected = odd_documents(spark, tmp_path)
    assert {tuple(r) for r in QUERIES["write_dataset"](spark, str(tmp_path)).collect()} == {row[:3] for row in expected}


def test_odd_texts_are_read_as_they_are(spark, tmp_path):
    expected = odd_documents(spark, tmp_path)
    assert {tuple(r) for r in QUERIES["load_commits_csv"](spark, str(tmp_path)).collect()} == expected
    # The last column of lines that end with "\n" alone keeps its "\r"; quoted or not, empty is missing unless asked for.
    (tmp_path / "t.csv").write_bytes(b'k,text\n1,a\r\n2,""\n3,\n')
    for empty_texts, second in ((True, ""), (False, None)):
        df = tables.load_commits(spark, str(tmp_path / "t.csv"), schema="k int, text string", required=["k"], empty_texts=empty_texts)
        assert sorted(map(tuple, df.collect())) == [(1, "a\r"), (2, second), (3, None)]
