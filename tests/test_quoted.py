"""Quoted files over many blocks against Python's own reader, and hashes of files against hashlib."""

from __future__ import annotations

import csv
import hashlib
import random

import pytest

from sievework.sources import delimited, quoted


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def some_rows(seed: int) -> list[list[str]]:
    r = random.Random(seed)
    part = lambda: r.choice(["a", "", "b,c", 'say "x"', "line\nfeed", "\n\n", "two\r\nlines", "é" * 5, "long\n" * 60, '"', "  ", "\t"])
    return [["k" + str(k), part(), part(), str(k)] for k in range(120)]


def write(path, rows, end="\n", last=True) -> None:
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL).writerows([["id", "x", "y", "n"], *rows])
    if not last:
        path.write_bytes(path.read_bytes()[: -len(end)])


@pytest.mark.parametrize(("end", "last"), [("\n", True), ("\n", False), ("\r\n", True)])
def test_records_over_blocks(spark, small_blocks, tmp_path, end, last):
    rows, path = some_rows(1), tmp_path / "a.csv"
    write(path, rows, end, last)
    found = quoted.read_quoted(spark, str(path), ",")
    assert quoted._lines(spark, str(path)).select("block").distinct().count() > 20
    assert [list(r)[1:] for r in found.orderBy("_row_id").collect()] == rows
    assert [r._row_id for r in found.orderBy("_row_id").collect()] == list(range(len(rows)))
    assert quoted.read_quoted(spark, str(path), ",", max_rows=7).count() == 7


def test_several_files_and_ragged_rows(spark, small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,2\n\n3\n4,5,6\n"7\n7",8\n')
    (tmp_path / "b.csv").write_text('x,y\n"9\n",10\n11,12')
    found = quoted.read_quoted(spark, str(tmp_path), ",").orderBy("_row_id").collect()
    assert [tuple(r) for r in found] == [(0, "1", "2"), (1, "3", ""), (2, "4", "5"), (3, "7\n7", "8"), (4, "9\n", "10"), (5, "11", "12")]
    assert [r._row_id for r in quoted.read_quoted(spark, str(tmp_path), ",", max_rows=5).collect()] and quoted.read_quoted(spark, str(tmp_path), ",", max_rows=5).count() == 5
    assert quoted.read_quoted(spark, str(tmp_path / "a.csv"), ",", header=False).columns == ["_row_id", "column_1", "column_2"]


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        quoted.read_quoted(spark, str(tmp_path / "e.csv"), ",")
    with pytest.raises(ValueError):
        delimited.sniff(spark, str(tmp_path / "e.csv"))


def test_row_caps_over_several_files(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.csv").write_text("x\n" + "".join(f"{name}{k}\n" for k in range(5)))
    for feeds in (True, False):
        found = delimited.read_delimited(spark, str(tmp_path), ",", max_rows=7, line_feeds=feeds)
        assert sorted(r._row_id for r in found.collect()) == list(range(7))


@pytest.mark.parametrize("data", [b"a", b"a\n", b"\n", b"\n\n", b"x\r\ny", b"\xff\xfe bytes \x00\n" * 300, ("é\n" * 500).encode()])
def test_hashes(spark, small_blocks, tmp_path, data):
    (tmp_path / "f.bin").write_bytes(data)
    (tmp_path / "g.bin").write_bytes(data + b"more\nlines")
    found = {r.path.rpartition("/")[2]: (r.hash, r.size) for r in quoted.file_hashes(spark, str(tmp_path)).collect()}
    assert found == {n: ("sha256:" + hashlib.sha256(d).hexdigest(), len(d)) for n, d in (("f.bin", data), ("g.bin", data + b"more\nlines"))}
