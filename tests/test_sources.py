"""Quoted records over byte ranges, guessed types, and stored datasets."""

import csv
import datetime as dt
import io
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldloom.sources import guess, records, tables


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of a few dozen bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_to
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, table, end="\n", quoting=csv.QUOTE_MINIMAL):
    text = io.StringIO()
    csv.writer(text, lineterminator=end, quoting=quoting).writerows(table)
    path.write_bytes(text.getvalue().encode())


ODD_CELLS = ["plain", "", 'say ""hi"" now', "two\nlines", "\n", "a,b", '"', '""\n""', " lead", "é\r\nü", "x" * 90, ("long\n" * 40), "\n\n\n", "end\r"]


@pytest.mark.parametrize("size,end", [(40, "\n"), (300, "\r\n"), (1 << 20, "\r\n")])
def test_records_across_ranges(spark, tmp_path, small_ranges, size, end):
    rng = random.Random(size)
    want = []
    for f in range(2):
        body = [[str(f * 1000 + i), rng.choice(ODD_CELLS), rng.choice(ODD_CELLS)] for i in range(10)]
        write(tmp_path / f"part{f}.csv", [["id", "first", "second"], *body], end)
        want += body
    small_ranges(size)
    lines = records._lines(spark, str(tmp_path))
    if size < 1000:
        assert records.range_parity(lines).where("open = 1").count() > 0  # some ranges do start inside a cell
    got = tables.read_delimited(spark, str(tmp_path), line_breaks=True)
    assert got.columns == ["id", "first", "second"]
    assert sorted(map(tuple, got.collect())) == sorted((a, b or None, c or None) for a, b, c in want)


def test_records_with_schema_header_breaks_and_blank_lines(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('\n"the\nid",note,note\n\n1,"x\n\ny",2.5\n\n2,NA,\n')
    small_ranges(7)
    got = tables.read_delimited(spark, str(tmp_path / "a.csv"), line_breaks=True)
    assert got.columns == ["the\nid", "note1", "note2"]
    typed = tables.read_delimited(spark, str(tmp_path / "a.csv"), "id int, note string, v double", line_breaks=True)
    assert rows(typed) == [(1, "x\n\ny", 2.5), (2, None, None)]


def test_bad_records_are_errors(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,x\n')
    with pytest.raises(ValueError, match="not closed"):
        tables.read_delimited(spark, str(tmp_path / "open.csv"), line_breaks=True)
    (tmp_path / "other.csv").write_text("a,c\n1,2\n")
    (tmp_path / "this.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="different lines"):
        tables.read_delimited(spark, [str(tmp_path / n) for n in ("other.csv", "this.csv")], line_breaks=True)
    (tmp_path / "short.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception, match="MALFORMED"):
        tables.read_delimited(spark, str(tmp_path / "short.csv"), line_breaks=True).collect()
    (tmp_path / "empty.csv").write_text("")
    assert tables.read_delimited(spark, str(tmp_path / "empty.csv"), "a int", line_breaks=True).count() == 0


def test_doubled_quotes_without_breaks(spark, tmp_path):
    write(tmp_path / "q.csv", [["a", "b"], ['say "hi" now', "1"], ['""', "2"]])
    want = [('""', "2"), ('say "hi" now', "1")]
    assert rows(tables.read_delimited(spark, str(tmp_path / "q.csv"))) == want
    df = tables.read_delimited(spark, str(tmp_path / "q.csv"))
    tables.write_delimited(df, str(tmp_path / "out"))
    assert rows(tables.read_delimited(spark, str(tmp_path / "out"))) == want


@pytest.mark.parametrize("cells,kind", [
    (["1", "-20", "+3"], "int"), (["1", "3000000000"], "bigint"), (["1", "2.5"], "double"), (["1", "99999999999999999999"], "double"), ([".5", "1e9", "Inf", "NaN"], "double"), (["007", "1"], "string"),
    (["2019-02-28"], "date"), (["2019-02-30"], "string"), (["2019-02-28", "2019-02-28 10:00"], "timestamp"), (["2019-02-28T10:00:01.5"], "timestamp"),
    (["2019-02-28", "1"], "string"), (["TRUE", "f"], "string"), (["TRUE", "false", "T"], "boolean"), ([None, None], "string"), ([], "string"), (["1", " 2"], "string"), (["T", "1"], "string")])
def test_guessed_kind(spark, cells, kind):
    df = spark.createDataFrame([(c,) for c in [None, *cells]], "`a.b` string")
    assert guess.guess_types(df) == {"a.b": kind}
    assert guess.guess_types(df.repartition(3)) == {"a.b": kind}
    assert guess.cast_guessed(df, {"a.b": kind}).dtypes == [("a.b", kind)]


def test_guessed_values(spark, tmp_path):
    write(tmp_path / "g.csv", [["n", "x", "d", "t", "s", "note"], ["1", "Inf", "2020-02-29", "2020-02-29 01:02", "NA", "two\nlines"], ["NA", "-0.5", "", "2020-03-01", "", "3"]])
    got = tables.read_guessed(spark, str(tmp_path / "g.csv"), line_breaks=True)
    assert dict(got.dtypes) == {"n": "int", "x": "double", "d": "date", "t": "timestamp", "s": "string", "note": "string"}
    assert {tuple(r) for r in got.collect()} == {(1, float("inf"), dt.date(2020, 2, 29), dt.datetime(2020, 2, 29, 1, 2), None, "two\nlines"),
                                                (None, -0.5, None, dt.datetime(2020, 3, 1), None, "3")}
    plan = guess.kinds_seen(tables.read_delimited(spark, str(tmp_path / "g.csv"), "n string, x string"))._jdf.queryExecution().toString()
    assert plan.count("Scan csv") <= 1
