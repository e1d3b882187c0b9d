import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallymill.functions import expr as E


def python_float(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


CELLS = ["1d", "1f", "1_000", " 12 ", "nan", "+nan", "inf", "-inf", "Infinity", "", "  ", "1e5", "1E-3", "0x10", "abc", "1,5", "+3", ".5", "5.", ".", "1__0", "\t7\n", "--1", None]


def test_py_float(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "i int, c string").select("i", E.py_float("c").alias("v")).orderBy("i").collect()
    for row, cell in zip(rows, CELLS):
        want = python_float(cell)
        if want is not None and math.isnan(want):
            assert row["v"] is not None and math.isnan(row["v"]), cell
        else:
            assert row["v"] == want, cell


@pytest.mark.parametrize(
    "cell,want",
    [
        ("08-AUG-11", dt.date(2011, 8, 8)), ("8-AUG-11", dt.date(2011, 8, 8)), ("08-aug-69", dt.date(1969, 8, 8)), ("08-aug-68", dt.date(2068, 8, 8)), ("2011-08-08", dt.date(2011, 8, 8)),
        ("2011", None), ("2011-8-8", None), ("31-FEB-11", None), ("", None), (None, None), (" 08-AUG-11 ", dt.date(2011, 8, 8)),
    ],
)
def test_parse_date(spark, cell, want):
    assert spark.createDataFrame([(cell,)], "c string").select(E.parse_date("c")).first()[0] == want


def test_missing_kinds(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("a",)], "c string")
    got = [tuple(r) for r in df.select(E.missing_exact("c"), E.missing_trimmed("c")).collect()]
    assert got == [(True, True), (True, True), (False, True), (False, False)]


def test_derived_and_target(spark):
    df = spark.createDataFrame([("4", "2"), ("-1", "0"), ("x", "1"), (None, "1"), ("inf", "1")], "a string, b string")
    rows = df.select(E.log1p_of("a"), E.ratio("a", "b", 0.0), E.difference("a", "b"), E.scalar_target("a", 9.0)).collect()
    assert rows[0][0] == pytest.approx(math.log(5)) and rows[0][1] == 2.0 and rows[0][2] == 2.0 and rows[0][3] == 4.0
    assert rows[1][0] == 0.0 and rows[1][1] == 0.0
    assert rows[2][0] is None and rows[2][3] == 9.0 and rows[3][3] == 9.0 and rows[4][3] == 9.0


def test_row_json_keeps_nulls(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string").select(E.encode_row(["x", "y"]).alias("j"))
    assert df.first()[0] == '{"x":"a","y":null}'
    assert df.select(E.decode_row("j").alias("m")).first()[0] == {"x": "a", "y": None}
    assert df.select(F.lit(1)).count() == 1
