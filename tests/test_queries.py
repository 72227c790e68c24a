"""Every query against its SQL on the smallest tables."""

import math
import os
import sys

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    return f"{float(value) + 0.0:.6f}" if hasattr(value, "__float__") else str(value)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in data)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    answer = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, df.collect()) == table(columns, answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_gives_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_queries_without_the_text_folder(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("corpus_pipeline", "changerisk.llm"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # as if it were not there
    assert "split_report" in queries() and "pipeline" not in queries() and "op5_exact_dedup" not in oracle_sql()


def test_entry(spark):
    assert entry(spark).count() > 0
