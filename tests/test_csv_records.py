from __future__ import annotations

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semtab.sources import readers
from semtab.sources.csv_records import MISSING_WORDS, after_line, records
from tests.conftest import rows


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(rows_, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows_)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_that_cross_splits(spark, tmp_path, small_splits, end):
    draw = random.Random(4)
    cell = lambda: "".join(draw.choice(['a', '"', ",", "\n", "é", " ", "x" * 9]) for _ in range(draw.randrange(14)))
    table = [[str(k), cell(), cell()] for k in range(150)] + [["150", "line\n" * 120, 'a "long" one']] + [["151", "", "\n"]]
    for name, part in (("a", table[:90]), ("b", table[90:])):
        (tmp_path / f"{name}.csv").write_text(written([["id", "s", "two words"], *part], end), newline="")
    lines = spark.read.text(str(tmp_path), lineSep="\n")
    assert lines.rdd.getNumPartitions() > 20
    df = readers.scan_csv(spark, str(tmp_path))
    assert df.columns == ["id", "s", "two words"] and [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "string"]
    missing = lambda s: None if s in MISSING_WORDS else s
    want = [(int(i), missing(a), missing(b)) for i, a, b in csv.reader(io.StringIO(written(table), newline=""))]
    assert rows(df) == sorted(want, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab",\n', max_size=6), min_size=2, max_size=3), min_size=1, max_size=5))
def test_state_behind_a_line(table):
    text = written(table)
    inside, found = False, []
    held: list[str] = []
    for line in text.split("\n")[:-1]:
        held.append(line)
        inside = after_line(line, inside)
        if not inside:
            found.append("\n".join(held))
            held = []
    assert not held and [next(csv.reader(io.StringIO(r, newline=""))) for r in found if r] == [r for r in table if written([r]) != "\n"]


def test_quotes_inside_plain_fields(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n5" pipe,x\n6" pipe,"y\nz"\n')
    assert rows(readers.scan_csv(spark, str(tmp_path / "t.csv"))) == [('5" pipe', "x"), ('6" pipe', "y\nz")]


def test_types_and_missing_words(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿i,d,b,s,day,gone,mixed\n1,1.5,True,x,2024-01-02,NA,1\nNA,nan,False,null,None,,x\n\n-3,2,NULL,N/A,2023-12-31,NaN,2\n")
    df = readers.scan_csv(spark, str(tmp_path / "t.csv"))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("i", "bigint"), ("d", "double"), ("b", "boolean"), ("s", "string"), ("day", "string"), ("gone", "string"), ("mixed", "string")]
    assert rows(df) == sorted([(1, 1.5, True, "x", "2024-01-02", None, "1"), (None, None, False, None, None, None, "x"), (-3, 2.0, None, None, "2023-12-31", None, "2")], key=repr)
    assert rows(df) == rows(readers.scan_csv(spark, str(tmp_path / "t.csv"), multiline=False).toDF(*df.columns))
    typed = readers.scan_csv(spark, str(tmp_path / "t.csv"), "i int, d string, b string, s string, day date, gone double, mixed int")
    assert sorted((r["mixed"] or 0, str(r["day"])) for r in typed.collect()) == [(0, "None"), (1, "2024-01-02"), (2, "2023-12-31")]
    with pytest.raises(ValueError, match="7 columns"):
        readers.scan_csv(spark, str(tmp_path / "t.csv"), "a int, b int")


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    assert readers.scan_csv(spark, str(tmp_path / "t.csv")).collect() == []
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        readers.scan_csv(spark, str(tmp_path / "e.csv"))
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\nat all')
    assert [r["record"] for r in records(spark, str(tmp_path / "open.csv")).where("start > 0 OR nth IS NULL OR nth > 0").collect()] == ['1,"never closed\nat all']
