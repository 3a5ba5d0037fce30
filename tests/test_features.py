"""Feature rules at their edges."""

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from visitwise.functions import features as X
from visitwise.operators import profiling as P
from visitwise.operators import sampling as M


def apply(spark, rule, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]


def test_age_bucket(spark):
    ages = [-0.5, 0.0, 0.49, 0.5, 15.49, 15.5, 18.49, 18.5, 22.5, 25.5, 30.5, 40.49, 40.5, -3.0]
    want = [
        "Unknown", "Unknown", "Unknown", "invalid", "invalid", "High School", "High School", "College",
        "Post-College", "late 20s", "30s", "30s", "old", "invalid",
    ]
    assert apply(spark, X.age_bucket, ages, "float") == want


def test_age_category(spark):
    ages = [0, 17, 18, 22, 23, 30, 31, 35, 36, None]
    want = ["<18", "<18", "18-22", "18-22", "23-30", "23-30", "31-35", "31-35", ">35", None]
    assert apply(spark, X.age_category, ages, "int") == want


def test_ages(spark):
    rows = [
        (dt.date(2001, 2, 28), dt.date(2000, 2, 29)),
        (dt.date(2001, 3, 1), dt.date(2000, 2, 29)),
        (dt.date(2020, 6, 1), dt.date(1980, 6, 2)),
        (dt.date(2020, 6, 2), dt.date(1980, 6, 2)),
        (dt.date(2020, 6, 2), None),
    ]
    df = spark.createDataFrame(rows, "d date, b date")
    got = df.select(
        X.age_calendar_years(F.col("d"), F.col("b")).alias("years"), X.age_years_365(F.col("d"), F.col("b")).alias("x")
    ).collect()
    assert [r["years"] for r in got][1:] == [1, 39, 40, None]
    assert got[4]["x"] == 0.0
    assert got[3]["x"] == pytest.approx((rows[3][0] - rows[3][1]).days / 365)


def test_zip3(spark):
    values = ["1", "12", "123", "1234", "12345", "123456", "12345-6789", "", None]
    want = ["000", "000", "001", "012", "123", "invalid", "invalid", "000", "invalid"]
    assert apply(spark, X.zip3, values, "string") == want


def test_season(spark):
    days = [dt.date(2001, m, 1) for m in range(1, 13)] + [None]
    want = ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Fall"] * 3 + ["Winter", "Unknown"]
    assert apply(spark, X.season, days, "date") == want


def test_visit_counts(spark):
    counts = [0, 1, 2, 5, 6, 10, 11, None]
    assert apply(spark, X.visits_bucket, counts, "int") == [
        "invalid", "One-Time", "2-5", "2-5", "6-10", "6-10", ">10", "invalid",
    ]
    assert apply(spark, X.is_repeat, counts, "int") == [0, 0, 1, 1, 1, 1, 1, 0]


def test_activity(spark):
    assert apply(spark, X.activity, [0.0, 0.5, 365.0, 365.5, None], "double") == [
        "Not Applicable", "1", "1", "0", None,
    ]


def test_left_pad(spark):
    assert apply(spark, X.left_pad, ["1", "12345", "123456"], "string") == ["00001", "12345", "123456"]


def test_strict_parse(spark):
    def births(v):
        return X.parse_day(v, X.BIRTH_DAY_FORMAT)

    assert apply(spark, births, ["2001/02/03", "2001/2/3", None], "string") == [dt.date(2001, 2, 3)] * 2 + [None]
    with pytest.raises(PySparkException):
        apply(spark, births, ["2001-02-03"], "string")


@pytest.mark.parametrize("bins", [1, 7, 300])
def test_histogram_is_numpys(spark, bins):
    values = [0.0, 1.0, 1.0, 2.5, 9.75, 10.0, 3.3]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    counts, edges = np.histogram(values, bins)
    got = P.histogram(df, "x", bins).orderBy("bin").collect()
    assert [r["n"] for r in got] == list(counts)
    assert np.allclose([r["lo"] for r in got], edges[:-1]) and np.allclose([r["hi"] for r in got], edges[1:])


def test_histogram_of_one_value_and_of_nothing(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    counts, _ = np.histogram([4.0, 4.0], 4)
    assert [r["n"] for r in P.histogram(df, "x", 4).orderBy("bin").collect()] == list(counts)
    assert P.histogram(df.where("x > 9"), "x", 4).count() == 0


def test_missing_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (2.0, None)], "x double, s string")
    got = {r["column"]: (r["count"], r["percentage"]) for r in P.missing_values(df).collect()}
    assert got == {"x": (2, 0.5), "s": (2, 0.5)}


def test_sorted_lines_with_many_copies(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("value"))
    got = [r["value"] for r in P.sort_lines(df).collect()]
    assert got == sorted(got) and len(got) == 2000


def test_sample_fraction_guard(spark):
    df = spark.createDataFrame([("a", dt.date(2001, 1, 1), 1)], "donor_id string, donation_dt date, txn_id int")
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            M.sample_persons(df, bad, 1)
    assert M.sample_persons(df, 1, 1).count() == 1
    assert M.sample_persons(df, 0, 1).count() == 0


def test_sample_keeps_whole_persons_and_its_rate(spark):
    df = spark.range(20000).select(
        (F.col("id") % 5000).cast("string").alias("donor_id"),
        F.lit("2001-01-01").cast("date").alias("donation_dt"),
        F.col("id").alias("txn_id"),
    )
    sample = M.sample_persons(df, 0.3, 7)
    per_person = sample.groupBy("donor_id").count()
    assert per_person.where("count <> 4").count() == 0
    assert 0.27 < per_person.count() / 5000 < 0.33
    again = {r["donor_id"] for r in M.sample_persons(df.repartition(13), 0.3, 7).select("donor_id").collect()}
    assert again == {r["donor_id"] for r in per_person.collect()}
