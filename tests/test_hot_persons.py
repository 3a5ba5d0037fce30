"""Sliced plans give what plain windows give, with one person holding a third of the rows."""

import pytest
from pyspark.sql import functions as F

from tests import oracle
from visitwise.functions import features as X
from visitwise.operators import lapses as L
from visitwise.operators import sampling as M
from visitwise.operators import slices as S
from visitwise.operators.histories import Histories, Keys
from visitwise.plans import enrich as E

PER_SLICE = 40


@pytest.fixture(scope="module")
def visits(spark):
    """3,000 visits: one hot person, one person all on one day, a null person, ordinary ones, missing days."""
    n = F.col("id")
    person = (
        F.when(n % 3 == 0, "hot").when(n % 10 == 1, "oneday").when(n % 50 == 2, None)
        .otherwise(F.concat(F.lit("p"), (F.xxhash64("id") % 97).cast("string")))
    )
    day = F.when(person == "oneday", F.lit("2001-05-05").cast("date")).when(
        n % 41 != 0, F.date_add(F.lit("1999-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(900)).cast("int"))
    )
    df = spark.range(3000).select(
        person.alias("donor_id"), day.alias("donation_dt"), n.alias("txn_id"),
        F.when(n % 4 == 0, "whole").otherwise("other").alias("donation_type"),
        F.when(n % 7 == 0, 1).when(n % 7 == 1, None).otherwise(0).cast("int").alias("first_donat_ind"),
        F.lit("12345").alias("site_zip"), F.lit(1).alias("donation_ind"),
        F.when(n % 5 != 0, F.lit("1970-03-04").cast("date")).alias("own_birth"),
    )
    return df.repartition(7, "txn_id")


@pytest.fixture(scope="module")
def persons(visits):
    return visits.select("donor_id").distinct().where(~F.col("donor_id").endswith("7")).select(
        "donor_id", F.lit("1960-02-29").cast("date").alias("birth_dt"), F.lit("r").alias("race"),
        F.lit("F").alias("gender"), F.col("donor_id").alias("zip5c"),
    )


def same(sliced, plain):
    assert sorted(sliced.columns) == sorted(plain.columns)
    assert oracle.spark_result(sliced) == oracle.spark_result(plain)


def test_slices_are_bounded_and_ordered(visits):
    rows = Histories.of(visits, Keys(), PER_SLICE).rows
    sizes = {(r["donor_id"], r["_slice"]): r["count"] for r in rows.groupBy("donor_id", "_slice").count().collect()}
    hot = {k: v for k, v in sizes.items() if k[1] > 0}
    assert {p for p, _ in hot} == {"hot", "oneday"} | {p for (p, s), v in sizes.items() if s > 0}
    assert max(hot.values()) <= PER_SLICE
    assert sum(sizes.values()) == 3000
    # Each slice ends before the next one starts.
    key = S.order_key("donation_dt", "txn_id")
    ranges = (
        rows.where("_slice > 0").groupBy("donor_id", "_slice").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    )
    a, b = ranges.alias("a"), ranges.alias("b")
    overlap = a.join(b, F.expr("a.donor_id <=> b.donor_id AND a._slice < b._slice AND a.hi >= b.lo"))
    assert overlap.count() == 0


def both(visits, build):
    hot = Histories.of(visits, Keys(), PER_SLICE)
    assert hot.base is not None
    same(build(hot).frame(), build(Histories(visits, Keys())).frame())


def test_ordinal_and_gap(visits):
    both(visits, lambda h: h.number("ordinal", "gap"))


def test_ordinal_and_gap_of_one_type(visits):
    both(visits, lambda h: h.number("ordinal", "gap", only=F.col("donation_type") == "whole"))


def test_totals(visits):
    both(visits, lambda h: h.span("n", "first_day", "last_day"))


def test_repeat_indicator_after_lapse(visits):
    both(visits, lambda h: L.repeat_indicator(L.with_lapse(h)))


def test_attach_then_ages(visits, persons):
    births = persons.select("donor_id", "birth_dt")
    both(visits, lambda h: L.with_ages(h.attach(births)))


def test_ages_from_the_rows_own_birth_dates(visits):
    both(visits, lambda h: L.with_ages(h, birth="own_birth"))


def test_duplicate_person_entries_multiply_rows(visits, persons):
    twice = persons.select("donor_id", "birth_dt")
    twice = twice.union(twice)
    both(visits, lambda h: h.number("ordinal").attach(twice))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_attach_kinds(visits, persons, how):
    both(visits, lambda h: h.attach(persons.select("donor_id", "birth_dt") if "left_" not in how else persons.select("donor_id"), how))


def test_persons_with(visits):
    both(visits, lambda h: h.number(gap="gap").persons_with(F.col("gap") == 3))


def test_early_returns(visits):
    whole = F.col("donation_type") == "whole"
    same(
        L.early_return_histories(visits, whole, per_slice=PER_SLICE),
        L.early_return_histories(visits, whole),
    )
    # The same persons as an id list would give.
    ids = L.early_return_visits(visits, whole).select("donor_id").distinct()
    plain = L.with_lapse(Histories(visits, Keys())).frame()
    want = plain.alias("v").join(ids.alias("i"), F.expr("v.donor_id <=> i.donor_id"), "left_semi")
    same(L.early_return_histories(visits, whole), want)


def test_enrich(visits, persons):
    same(E.enrich(visits, persons, per_slice=PER_SLICE), E.enrich(visits, persons))


def test_sample(visits):
    ids = visits.where("donor_id is not null")
    same(M.sample_persons(ids, 0.5, 3, per_slice=PER_SLICE), M.sample_persons(ids, 0.5, 3))


def test_ordinals_by_brute_force(visits):
    """Plain Python replay of the rule over the collected fixture."""
    rows = visits.where("donor_id is not null").collect()
    rows.sort(key=lambda r: (r["donor_id"], r["donation_dt"] is None, r["donation_dt"] or 0, r["txn_id"]))
    want, last = {}, None
    for r in rows:
        if last is None or last["donor_id"] != r["donor_id"]:
            want[r["txn_id"]] = (1, 0)
        else:
            a, b = last["donation_dt"], r["donation_dt"]
            want[r["txn_id"]] = (want[last["txn_id"]][0] + 1, (b - a).days if a and b else 0)
        last = r
    got = Histories.of(visits, Keys(), PER_SLICE).number("ordinal", "gap").frame().where("donor_id is not null")
    assert {r["txn_id"]: (r["ordinal"], r["gap"]) for r in got.collect()} == want


def test_sum_of_gaps_is_the_span(visits):
    h = Histories.of(visits, Keys(), PER_SLICE).number(gap="gap").span("n", "a", "b")
    span = F.coalesce(X.days_between(F.col("b"), F.col("a")), F.lit(0))
    bad = h.frame().groupBy("donor_id").agg(F.sum("gap").alias("s"), F.max(span).alias("d")).where("s <> d")
    assert bad.count() == 0


def test_results_do_not_depend_on_partitioning(spark, visits):
    one = Histories.of(visits.repartition(3), Keys(), PER_SLICE).number("ordinal", "gap").frame()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = oracle.spark_result(one)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        two = Histories.of(visits.repartition(11), Keys(), PER_SLICE).number("ordinal", "gap").frame()
        assert oracle.spark_result(two) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
