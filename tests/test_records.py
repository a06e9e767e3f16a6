"""CSV records that go over the ends of splits, against Spark's reader of whole files."""

import collections
import gzip
import random

import pytest

from argotlog.sources.records import cell, ends_inside, header_of, read_column


@pytest.fixture
def splits(spark):
    """Set the size of file splits for a test."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def use(size):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], "1")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("line,outside,inside", [("a,b", False, True), ('a,"b', True, False), ('a,"b"', False, False), ('"a""', True, False), ('x"y', False, False), ('","', False, True), ("", False, True), ('"a"b,"c', True, True), ('a","', True, True)])
def test_how_lines_end(line, outside, inside):
    assert ends_inside(line, False) is outside and ends_inside(line, True) is inside


def test_cells():
    assert [cell('a,"b ""c"", d",,e\r', i) for i in range(5)] == ["a", 'b "c", d', None, "e", None]
    assert cell('"a"b,c', 0) == '"a"b' and cell('""', 0) is None and cell('"a\nb"', 0) == "a\nb" and cell('x"y"', 0) == 'x"y"'
    assert header_of(iter(["﻿a,\"b", 'c",d'])) == ["a", "b\nc", "d"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_split_gives_the_rows_of_the_multiline_reader(spark, tmp_path, splits, end):
    rng = random.Random(len(end))
    signs = ["a", "b", " ", ",", '"', "\n", "\n", "é", "\\", "x" * 30]
    path = str(tmp_path / "in.csv")
    with open(path, "w", newline="", encoding="utf-8") as file:
        file.write(f'id,"cmd"{end}')
        for i in range(1200):
            value = 'q"\n' * 900 if i == 600 else "".join(rng.choices(signs, k=rng.randint(0, 12)))
            quoted = '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n') or rng.random() < 0.2 else value
            file.write(f"{i},{'"bad"tail' if rng.random() < 0.01 else quoted}{',extra' if rng.random() < 0.1 else ''}{end}{end if rng.random() < 0.02 else ''}")
    expected = spark.read.schema("c0 string, c1 string").csv(path, header=True, quote='"', escape='"', multiLine=True)
    expected = collections.Counter(r.c1 for r in expected.collect())
    for size in ("128m", "3k", "700"):
        splits(size)
        found = read_column(spark, [path], "cmd")
        assert collections.Counter(r.value for r in found.collect()) == expected, size
    assert found.rdd.getNumPartitions() > 10


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("x,cmd\n")
    (tmp_path / "open.csv").write_text('cmd,x\n"never closed\nto the end')
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as file:
        file.write('y,cmd\n1,"two\nlines"\n')
    assert sorted(r.value for r in read_column(spark, [str(tmp_path)], "cmd").collect()) == ['"never closed\nto the end', "two\nlines"]
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(KeyError, match=r"other.csv. Available columns: a, b"):
        read_column(spark, [str(tmp_path)], "cmd")
    assert read_column(spark, [str(tmp_path / "empty.csv")], "cmd").count() == 0
