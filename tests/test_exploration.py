"""Histograms of several series, merges with hot keys, and the report's previews."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitwise.operators import profiling as P
from visitwise.plans.exploration import explore, merge_left


def test_histograms_of_several_series(spark):
    rng = random.Random(6)
    values = {"a": [rng.gauss(0, 3) for _ in range(400)], "b": [7.0] * 50, None: [float(i % 11) for i in range(99)], "e": []}
    rows = [(name, v) for name, found in values.items() for v in found] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "series string, x double").repartition(5)
    got = P.histograms(df, "series", "x", 11).orderBy("series", "bin").collect()
    for name in ("a", "b", None):
        bars = [r for r in got if r["series"] == name]
        n, edges = np.histogram(values[name], bins=11)
        assert [r["n"] for r in bars] == n.tolist()
        assert [r["lo"] for r in bars] == pytest.approx(edges[:-1]) and [r["hi"] for r in bars] == pytest.approx(edges[1:])
        single = P.histogram(df.where(F.col("series").eqNullSafe(F.lit(name))), "x", 11).orderBy("bin").collect()
        assert [tuple(r) for r in single] == [tuple(r)[1:] for r in bars]
    assert not [r for r in got if r["series"] == "e"] and P.histograms(df.limit(0), "series", "x", 3).count() == 0


def test_series_are_read_once(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_totalprice")
    bars = P.histograms(df, "o_orderpriority", "o_totalprice", 10)
    bars.collect()
    final = bars._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= 1


def merged_plainly(left, right, match_nulls):
    out = []
    for row in left:
        found = [r for r in right if r[0] == row[0] and (match_nulls or row[0] is not None)]
        out += [(*row, *r[1:]) for r in found] or [(*row, None, None)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("match_nulls", [True, False])
@pytest.mark.parametrize("per_slice", [None, 40])
def test_merge_with_hot_and_null_keys(spark, match_nulls, per_slice):
    left = [(None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i % 50}", i, "l") for i in range(600)]
    right = [(None, 1, "r"), (None, 2, "r"), ("hot", 3, "r"), *[(f"k{i}", i, None) for i in range(0, 60, 2)], ("k4", 9, "twice")]
    a = spark.createDataFrame(left, "id string, _slice int, zip string")
    b = spark.createDataFrame(right, "id string, _on int, zip string")
    got = merge_left(a, b, "id", match_nulls=match_nulls, per_slice=per_slice)
    assert got.columns == ["id", "_slice", "zip_x", "_on", "zip_y"]
    assert sorted(map(tuple, got.collect()), key=repr) == merged_plainly(left, right, match_nulls)


def test_null_rows_are_spread_over_tasks(spark):
    """100,000 null rows against a few null rows: no task of the join holds more than a slice of them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(120_000).select(F.when(F.col("id") % 6 == 0, F.col("id")).alias("key"), "id")
        right = spark.createDataFrame([(None, "n"), (6, "six")], "key long, v string")
        got = merge_left(left, right, "key", per_slice=5_000)
        parts = got.where("key IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in parts) == 100_000
        assert len(parts) >= 5 and max(r["count"] for r in parts) <= 40_000
        assert got.where("v = 'n'").count() == 100_000 and got.where("v = 'six'").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_previews_keep_rows_without_a_day_and_repeated_rows(spark):
    day = dt.date(2001, 1, 1)
    rows = [("p", day + dt.timedelta(20 * i), i, "w", 1, 0, 0) for i in range(4)]
    rows += [("p", None, 90, "w", 1, 0, 0), ("p", None, None, "w", 1, 0, 0), rows[0], rows[0], rows[1], rows[1]]
    visits = spark.createDataFrame(
        rows, "donor_id string, donation_dt date, txn_id long, donation_type string, donation_ind int, deferral_ind int, first_donat_ind int"
    )
    persons = spark.createDataFrame([("p", dt.date(1970, 1, 1))], "donor_id string, birth_dt date")
    top = explore(visits, persons, "w")["early_return_preview"].collect()
    assert len(top) == 8 and [r["txn_id"] for r in top] == [0, 0, 0, 1, 1, 1, 2, 3]
