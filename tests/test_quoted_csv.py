"""Split reading of quoted CSV against Spark's reader of whole files."""

import random
from collections import Counter

import pytest

from changerisk.sources import quoted_csv
from changerisk.sources.quoted_csv import csv_records, read_quoted_csv

CELLS = ["", "a", "x,y", 'say "hi"', '""', "two\nlines", "\n", "win\r\ndows", "end\r", "\r", "é漢😀", " pad ", "a\n\n\nb", 'q"\n"q', "1", "-"]


def quoted(cell, dice):
    """As a careful writer does: quoted where it must be, and sometimes where it need not."""
    if any(c in cell for c in ',"\n\r') or dice.random() < 0.3:
        return '"' + cell.replace('"', '""') + '"'
    return cell


def table(dice, rows, end):
    lines = ["id,one,two"]
    for i in range(rows):
        cells = [dice.choice(CELLS) for _ in range(2)]
        if dice.random() < 0.02:
            cells[0] = "long\n" * dice.randrange(200)
        lines.append(",".join([str(i), *(quoted(c, dice) for c in cells)]))
        if dice.random() < 0.05:
            lines.append("")
    return end.join(lines) + dice.choice(["", end])


@pytest.mark.parametrize("end, split", [("\n", 512), ("\n", 64), ("\r\n", 100), ("\n", 1 << 20)])
def test_rows_equal_the_whole_file_reader(spark, tmp_path, end, split):
    dice = random.Random(split)
    for i in range(3):
        (tmp_path / f"part-{i}.csv").write_bytes(table(dice, 120, end).encode())
    (tmp_path / "part-3.csv").write_text("id,one,two\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        found = read_quoted_csv(spark, str(tmp_path), "id int, one string, two string")
        tasks, rows = quoted_csv._lines(spark, str(tmp_path)).rdd.getNumPartitions(), Counter(map(tuple, found.collect()))
        names = read_quoted_csv(spark, str(tmp_path)).columns
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert names == ["id", "one", "two"] and (split > 10_000 or tasks > 12)
    whole = spark.read.options(header=True, multiLine=True, escape='"').schema("id int, one string, two string")
    expected = Counter(map(tuple, whole.csv(str(tmp_path)).collect()))
    if end == "\r\n":  # there Spark's reader makes "\n" of "\r\n" in cells too, this one keeps cells as they are
        assert any("\r\n" in (cell or "") for _, *cells in rows for cell in cells)
        rows, expected = (Counter(tuple(c.replace("\r\n", "\n") if isinstance(c, str) else c for c in r) for r in x.elements()) for x in (rows, expected))
    assert rows == expected and sum(rows.values()) == 360


def test_a_cell_longer_than_many_splits(spark, tmp_path):
    cell = "line of text\n" * 5000
    (tmp_path / "one.csv").write_text(f'k,text\n1,"{cell}"\n2,"b"\n3,"{cell}x"')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = {r["k"]: r["text"] for r in read_quoted_csv(spark, str(tmp_path), "k int, text string").collect()}
        records = csv_records(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == {1: cell, 2: "b", 3: cell + "x"} and records == 4
