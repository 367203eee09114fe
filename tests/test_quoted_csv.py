"""Task files whose quoted fields have line breaks, cut into splits anywhere."""

import csv
import io
import random

import pandas as pd
import pytest

from shotweave.sources.quoted import logical_records
from shotweave.sources.tables import read_task


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few bytes, so that records, quotes and line ends lie across them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def cut(size):
        for name in before:
            spark.conf.set(name, str(size))

    yield cut
    for name, value in before.items():
        spark.conf.set(name, value)


def rows_of(df, *columns):
    rows = sorted(df.collect(), key=lambda r: r["row_id"])
    assert [r["row_id"] for r in rows] == list(range(len(rows)))
    return [tuple(r[c] for c in columns) for r in rows]


PIECES = ["a", "x,y", 'say "hi"', "line\nbreak", "\n", "\n\n", '"', '",', "é中", "end\r\nof", " pad ", '"\n"', "long " * 9]


@pytest.mark.parametrize("seed, size", [(0, 16), (1, 40), (2, 100), (3, 1 << 20)])
def test_records_are_those_of_a_sequential_reader(spark, tmp_path, tiny_splits, seed, size):
    rng = random.Random(seed)
    expected = []
    for name in ("a", "b", "c"):
        rows = [["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 3))) for _ in range(2)] + ["z"] for _ in range(6)]
        out = io.StringIO()
        csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows([["text", "label", "last"], *rows])
        (tmp_path / f"{name}.csv").write_text(out.getvalue(), newline="")
        read = pd.read_csv(tmp_path / f"{name}.csv", dtype=str, keep_default_na=False)
        assert read.values.tolist() == rows
        expected += [tuple(row) for row in rows]
    tiny_splits(size)
    assert rows_of(read_task(spark, str(tmp_path), "text", "label"), "text", "label", "last") == expected


LOOSE = 'text,label\n5" pipe,1\n"a"b"c,2\n\n  \na"b""c,3\n"x\ny"tail "q",4\n"",5\n"open\n\n\nstill, open",6\n'


@pytest.mark.parametrize("size", [8, 1 << 20])
def test_loose_quotes_and_blank_lines(spark, tmp_path, tiny_splits, size):
    (tmp_path / "t.csv").write_text(LOOSE)
    tiny_splits(size)
    found = [r["text"] for r in logical_records(spark, str(tmp_path)).orderBy("row").collect()]
    assert found == [
        '5" pipe,1', '"a"b"c,2', 'a"b""c,3', '"x\ny"tail "q",4', '"",5', '"open\n\n\nstill, open",6',
    ]
    numbers = [r[1] for r in rows_of(read_task(spark, str(tmp_path), "text", "label"), "text", "label")]
    assert numbers == [str(i) for i in range(1, 7)]


def test_one_file_is_read_by_many_tasks(spark, tmp_path, tiny_splits):
    body = "".join(f'"text {i}\nof two lines",{i}\n' for i in range(2000))
    (tmp_path / "t.csv").write_text("text,label\n" + body)
    tiny_splits(4096)
    df = read_task(spark, str(tmp_path), "text", "label")
    assert rows_of(df, "text", "label") == [(f"text {i}\nof two lines", str(i)) for i in range(2000)]
    assert len(logical_records(spark, str(tmp_path)).inputFiles()) > 8


def test_a_field_longer_than_many_splits(spark, tmp_path, tiny_splits):
    long = "\n".join(["some words"] * 500)
    (tmp_path / "t.csv").write_text(f'text,label\nfirst,0\n"{long}",1\nlast,2\n')
    tiny_splits(400)
    df = read_task(spark, str(tmp_path), "text", "label")
    assert rows_of(df, "text", "label") == [("first", "0"), (long, "1"), ("last", "2")]


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label\n")
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("﻿text,label\nx,1")
    assert rows_of(read_task(spark, str(tmp_path), "text", "label"), "text", "label") == [("x", "1")]


def test_one_line_records_refuse_an_open_quote(spark, tmp_path):
    (tmp_path / "t.csv").write_text('text,label\n"two\nlines",1\n')
    with pytest.raises(Exception, match="a quote is left open"):
        read_task(spark, str(tmp_path), "text", "label", multiline=False).collect()
    (tmp_path / "t.csv").write_text('text,label\n"one, line",1\n\nplain "q",2\n')
    df = read_task(spark, str(tmp_path), "text", "label", multiline=False)
    assert rows_of(df, "text", "label") == [("one, line", "1"), ('plain "q"', "2")]
