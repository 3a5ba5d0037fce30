"""Edges of each cleaning rule on literal tables."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from visitwise.functions import text as X
from visitwise.sources import extracts as E
from visitwise.sources import schema as S


def apply(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_split(spark):
    lines = ["a,b,c", "a,b,,", ",,", "", ",a", "a,,b", "a, ,"]
    want = [["a", "b", "c"], ["a", "b"], [], [""], ["", "a"], ["a", "", "b"], ["a", " "]]
    assert apply(spark, X.split_fields, lines) == want


def test_trim(spark):
    values = ["  a b ", "\t\na\r\n", "\x00x\x1f", " a ", " \t ", "", None]
    want = ["a b", "a", "x", " a ", "", "", None]
    assert apply(spark, X.trim_blanks, values) == want
    assert apply(spark, lambda v: X.trim_blanks(v, X.has_controls(v)), values) == want


def test_null_words(spark):
    values = ["na", "NA", "nA", "None", "NONE", "", "nan", "null", "n/a", "none of it"]
    assert apply(spark, X.null_words, values) == [None] * 6 + ["nan", "null", "n/a", "none of it"]


def test_capitalize(spark):
    values = ["abc", "aBC dE", "Abc", "1a", "é", "ßa", "a", None]
    assert apply(spark, X.capitalize, values) == ["Abc", "ABC dE", "Abc", "1a", "É", "ßa", "A", None]


def test_abbreviations_keep_their_case(spark):
    def rule(name):
        return lambda v: X.convert(v, name, "string")

    assert apply(spark, rule("state_abbr"), ["ma"]) == ["ma"]
    assert apply(spark, rule("StateAbbr"), ["ma"]) == ["Ma"]


def test_int(spark):
    values = ["1", "+5", "-7", "1.0", "x", "2147483647", "2147483648", "1 2", "007"]
    assert apply(spark, X.to_int, values) == [1, 5, -7, None, None, 2147483647, None, None, 7]


def test_float(spark):
    values = ["1", "1.5", "1e3", "-.5", "x", "1f", "NaN", "nan", "Infinity", "inf", "-Infinity", "+INF"]
    got = apply(spark, X.to_float, values)
    assert got[:6] == [1.0, 1.5, 1000.0, -0.5, None, 1.0]
    assert math.isnan(got[6]) and got[7] is None
    assert got[8:] == [math.inf, None, -math.inf, None]


def test_geo_zero(spark):
    def rule(name):
        return lambda v: X.convert(v, name, "float")

    assert apply(spark, rule("Latitude"), ["0", "0.0", "00", "1"]) == [None, 0.0, 0.0, 1.0]
    assert apply(spark, rule("Other"), ["0"]) == [0.0]


DATES = {
    "2015-01-02": dt.date(2015, 1, 2),
    "2015-1-2": dt.date(2015, 1, 2),
    '"2015-01-02"': dt.date(2015, 1, 2),
    "2015-02-30": dt.date(2015, 3, 2),
    "2015-02-29": dt.date(2015, 3, 1),
    "2016-02-29": dt.date(2016, 2, 29),
    "2015-04-31": dt.date(2015, 5, 1),
    "2015-02-32": None,
    "2015-13-01": None,
    "2015-00-01": None,
    "2015-01-00": None,
    "2015-01-02 10:00": None,
    "2015-01": None,
    "15-01-02": None,
    "20150102": None,
    "0000-01-01": None,
    "2015/01/02": dt.date(2015, 1, 2),
    "2015/1/2": dt.date(2015, 1, 2),
    '"2015/01/02"': dt.date(2015, 1, 2),
    "2015/13/45": dt.date(2016, 2, 14),
    "2015/00/01": dt.date(2014, 12, 1),
    "2015/01/00": dt.date(2014, 12, 31),
    "2015/01/02 10:00": dt.date(2015, 1, 2),
    "2015/01/02 10-00": None,
    "2015/ 1/ 2": dt.date(2015, 1, 2),
    "2015/01": None,
    "a/b/c": None,
    "0/1/1": None,
    "15/01/02": dt.date(15, 1, 2),
}


def test_dates(spark):
    assert dict(zip(DATES, apply(spark, X.to_day, list(DATES)))) == DATES


def test_strict_dates_refuse_rollover(spark):
    rolled = ["2015-02-30", "2015/13/45", "2015/02/30", "2015/00/01"]
    assert apply(spark, lambda v: X.to_day(v, strict=True), rolled) == [None] * 4
    assert apply(spark, lambda v: X.to_day(v, strict=True), ["2015-02-28", "2015/12/31"]) == [
        dt.date(2015, 2, 28),
        dt.date(2015, 12, 31),
    ]


def test_bool_and_unknown_types(spark):
    assert apply(spark, X.to_bool, ["true", "false", "x"]) == [True, False, None]
    with pytest.raises(ValueError):
        X.convert(F.lit("x"), "f", "decimal")


FIELDS = [("id", "string"), ("day", "date"), ("n", "integer")]


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_clean_routes_rejects(spark):
    out = E.clean(lines(spark, "a,2015-01-01,1", "b,2015-01-01", " NA ,2015-01-01,2", "c,x,y"), FIELDS, ("id",))
    assert sorted(map(tuple, out.rows.collect()), key=str) == [("A", dt.date(2015, 1, 1), 1), ("C", None, None)]
    rejects = {(r["value"], r["reject_reason"]) for r in out.rejects.collect()}
    assert rejects == {("b,2015-01-01", "arity"), (" NA ,2015-01-01,2", "missing id")}


def test_failfast(spark):
    good = lines(spark, "a,2015-01-01,1")
    assert E.clean(good, FIELDS, mode="failfast").rows.count() == 1
    with pytest.raises(PySparkException, match="expected 3 fields, found 2"):
        E.clean(lines(spark, "b,2015-01-01"), FIELDS, mode="failfast").rows.collect()
    with pytest.raises(ValueError):
        E.clean(good, FIELDS, mode="ignore")


def test_schema_document(spark, tmp_path):
    path = tmp_path / "schema.json"
    path.write_text('{"fields": [{"name": "id", "type": "string"},\n {"name": "day", "type": "date"}]}')
    fields = S.load_fields(spark, str(path))
    assert fields == [("id", "string"), ("day", "date")]
    assert S.struct_type(fields).simpleString() == "struct<id:string,day:date>"
    with pytest.raises(ValueError, match="money"):
        S.check([("x", "money")])


def test_header_of_concatenated_extracts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,day\n1,2\nid,day\n3,4\n")
    (tmp_path / "b.csv").write_text("id,day\n5,6\n")
    header = E.header_line(spark, str(tmp_path))
    assert header == "id,day"
    left = E.drop_header(E.read_lines(spark, str(tmp_path)), header)
    assert {r["value"] for r in left.collect()} == {"1,2", "3,4", "5,6"}


def test_generated_code_compiles_for_a_wide_schema(spark):
    wide = [(f"c{i}", ("string", "date", "integer", "float")[i % 4]) for i in range(60)]
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        line = ",".join(("a", "2015-02-30", "7", "1.5")[i % 4] for i in range(60))
        row = E.clean(lines(spark, line), wide).rows.first()
        assert row["c0"] == "A" and row["c57"] == dt.date(2015, 3, 2) and row["c58"] == 7
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_header_of_folder_with_odd_name(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "a0.csv").write_text("")
    (folder / "x%1[2].csv").write_text("head,er\n1,2\n")
    (folder / "z.csv").write_text("other\n")
    assert E.header_line(spark, str(folder)) == "head,er"
    assert E.header_line(spark, str(folder / "a0.csv")) is None


def test_every_digit_of_a_date_counts(spark):
    texts = ["2015/01/1234567", "20150/01/01", "2015/123456/01", "2015/01/99999999999", "2015/13/45", "0/1/1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["d"] for r in df.select("i", X.to_day(F.col("t")).cast("string").alias("d")).orderBy("i").collect()]
    assert got == ["5395-02-16", None, None, None, "2016-02-14", None]
