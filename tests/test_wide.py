from datetime import date

import pytest
from pyspark.sql import functions as F

from idloom.operators import wide

SCHEMA = "id long, file_id long, metadata_type string, name string, value string, entity long, attr int"


def _df(spark, rows):
    return spark.createDataFrame([(i, f, "text", n, v, 0, 0) for i, (f, n, v) in enumerate(rows)], SCHEMA)


NUMBERS = {"12": 12, " 1023 ": 1023, "+16": 16, "-3": -3, "007": 7, "0.36e2": 36, "1E+3": 1000, "3,229": 3229, "1 228": 1228, "198'059": 198059, "2 550 490": 2550490, "1,234.50": 1234.5, ".5": 0.5, "\uff15\uff19": 59, "\uff11\uff0c\uff10\uff11\uff17\uff0e\uff15": 1017.5, "\u0661\u0662": 12, "5.": 5, "−7": -7}
NO_NUMBERS = ["70x23", "null", "50..9", "59 / 82", "<37", "13-48", "9?", "3 or 4", "1.2.3", "#REF", "5 46", "1,23", "12,5", "", "l7", "1_0_0", "0x1F", "NaN", "Infinity", "1e", "e5", "--", "1,234 567", ".", "12 kB"]
DATES = {"1995-11-11": date(1995, 11, 11), "20001015": date(2000, 10, 15), "17 Mar 2006": date(2006, 3, 17), "1984-04-10T13:19:43Z": date(1984, 4, 10), " 1993-04-01 09:55": date(1993, 4, 1), "December 2, 2001": date(2001, 12, 2), "2013/06/08": date(2013, 6, 8), "20.04.1997": date(1997, 4, 20), "10-SEP-1992": date(1992, 9, 10), "\uff11\uff19\uff19\uff15-11-11": date(1995, 11, 11), "May 1, 2010": date(2010, 5, 1), "25/12/1999": date(1999, 12, 25), "12/25/1999": date(1999, 12, 25), "2024-02-29": date(2024, 2, 29)}
NO_DATES = ["2023-02-29", "summer 1988", "2008-06-??", "2020-03", "19??", "199x-05-01", "n/a", "-", "", "next spring", "03/04/2015", "31 Foo 2000", "20011301", "5"]


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([(v,) for v in [*NUMBERS, *NO_NUMBERS, *DATES, *NO_DATES, None]], "v string")
    got = {r.v: (r.n, r.d) for r in df.select("v", wide.read_number(F.col("v")).alias("n"), wide.read_date(F.col("v")).alias("d")).collect()}
    for v, n in NUMBERS.items():
        assert got[v][0] == n, v
    for v in NO_NUMBERS:
        assert got[v][0] is None, v
    for v, d in DATES.items():
        assert got[v][1] == d, v
    for v in NO_DATES:
        assert got[v][1] is None, v


COLS = [("when", "date"), ("size_px", "number"), ("title", "text"), ("issues", "text")]


@pytest.mark.parametrize("chunk", [1, 3, 10_000])
def test_pivot(spark, chunk):
    rows = [(1, "Size-PX", "10"), (1, " size  px ", "10.0"), (1, "title", " A "), (1, "title", "A"), (2, "size_px", "1"), (2, "size_px", "2"), (2, "size_px", "bad"), (3, "when", "never"), (3, "title", None), (3, "issues", "kept"), (4, "other", "x"), (None, "title", "lost"), (5, None, "x"), (6, "WHEN", "2001-02-03"), (6, "when", "3 Feb 2001"), (6, "title", "x" * 200_000)]
    rows += [(9, "size_px", "7")] * 500 + [(9, "title", f"t{i % 2}") for i in range(300)]
    got = {r.file_id: r for r in wide.pivot_wide(_df(spark, rows), COLS, chunk).collect()}
    assert set(got) == {1, 2, 3, 6, 9}
    assert (got[1].size_px, got[1].title, got[1].when, got[1].issues) == (10.0, "A", None, [])
    assert got[2].size_px is None and [tuple(i) for i in got[2].issues] == [("size_px", "conflict")]
    assert {tuple(i) for i in got[3].issues} == {("when", "unreadable"), ("title", "unreadable")} and got[3].issues_ == "kept"
    assert got[6].when == date(2001, 2, 3) and len(got[6].title) == 200_000
    assert got[9].size_px == 7 and [tuple(i) for i in got[9].issues] == [("title", "conflict")]


def test_empty(spark):
    out = wide.pivot_wide(_df(spark, []), COLS)
    assert out.collect() == [] and out.columns == ["file_id", "when", "size_px", "title", "issues_", "issues"]
    assert wide.cell_issues(out).collect() == []
    assert wide.wide_columns(spark.createDataFrame([], "attribute string, value_type string")) == []
