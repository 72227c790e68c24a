"""Messages, paths, blame lines and vectors."""

import pytest
from pyspark.sql import functions as F

from changerisk.functions import text
from changerisk.functions.vectors import expand_embedding, parse_vector, vector_norm, vector_text
from changerisk.operators import labels


def values(spark, items, build, kind="string"):
    df = spark.createDataFrame([(i, item) for i, item in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_fix_keywords_match_inside_words(spark):
    messages = ["prefix cleanup", "DEBUG", None, "", "add feature", "Resolved"]
    assert values(spark, messages, text.is_fix_commit) == [True, True, False, False, False, True]


def test_suffixes(spark):
    paths = ["a/b.PY", "Makefile", ".gitignore", "a/.x.h", "x.", "a.b/c", "a.tar.gz", None, "d.py/readme", "/.py"]
    expected = [".py", "", "", ".h", "", "", ".gz", None, "", ""]
    assert values(spark, paths, text.file_suffix) == expected
    wanted = [True, False, False, True, False, False, False, False, False, False]
    assert values(spark, paths, lambda c: text.file_is_relevant(c, (".py", ".h"))) == wanted
    as_column = F.array(F.lit(".py"), F.lit(".h"))
    assert values(spark, paths, lambda c: text.file_is_relevant(c, as_column)) == wanted


def test_path_parts(spark):
    paths = ["a/b/c.py", "top.py", "/abs/x.py", "a/b"]
    assert values(spark, paths, text.directory) == ["a/b", None, "/abs", "a"]
    assert values(spark, paths, text.subsystem) == ["a", "top.py", "/", "a"]
    assert values(spark, ["a\\B/C.PY"], text.normalize_path) == ["a/B/C.PY"]
    assert values(spark, ["a\\B/C.PY"], text.history_path) == ["a/b/c.py"]


def test_blame_lines(spark):
    sha, other = "a" * 40, "b" * 40
    lines = [f"{sha} 1 1 2", "author-mail <x@y>", f"previous {other} f.py", f"\t{other} code", "", f"{sha} 2 2"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    assert [r[0] for r in labels.szz_blamed(df).collect()] == [sha]
    commits = spark.createDataFrame([(sha, 9), (other, 9)], "commit_id string, buggy int")
    marked = labels.szz_label(commits, labels.szz_blamed(df)).collect()
    assert {r["commit_id"]: r["buggy"] for r in marked} == {sha: 1, other: 0}


def test_candidates_keep_first_21_relevant_files(spark):
    rows = [("f", i, f"s{i:02d}.py" if i % 2 else f"s{i:02d}.txt") for i in range(60)] + [("g", 1, "x.py")]
    df = spark.createDataFrame(rows, "fix_commit_id string, file_ordinal int, file_path string")
    kept = labels.szz_candidates(df, (".py",), 21).filter("fix_commit_id = 'f'").collect()
    assert sorted(r["file_ordinal"] for r in kept) == list(range(1, 42, 2))
    assert labels.szz_candidates(df, (".py",)).count() == 31


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None)], "k int, e array<float>")
    assert df.select(vector_norm(F.col("e"))).first()[0] == 5.0
    assert df.select(parse_vector(vector_text(F.col("e")))).first()[0] == [3.0, 4.0]
    wide = expand_embedding(df, "e", 2).orderBy("k").collect()
    assert [tuple(r) for r in wide] == [(1, 3.0, 4.0), (2, 0.0, 0.0)]
    with pytest.raises(Exception, match="expected 3 elements"):
        expand_embedding(df, "e", 3).collect()


def test_embedding_input(spark):
    df = spark.createDataFrame([("m", None), (None, "d")], "m string, d string")
    assert [r[0] for r in df.select(text.embedding_input(F.col("m"), F.col("d"))).collect()] == ["m [SEP] ", " [SEP] d"]
