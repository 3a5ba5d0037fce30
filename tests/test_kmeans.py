"""Fits that depend on the data only, settled fits against their own definition, and all k at once."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from visitwise.operators import clustering as C
from visitwise.operators import kmeans as M


def vectors(spark, rows, partitions):
    df = spark.createDataFrame(rows, "features array<double>, weight double")
    return df.repartition(partitions) if partitions else df


def scattered(n=600, dim=3, seed=1):
    """Fractions, tiny and large components, weights and repeated vectors."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        center = rng.choice([(0.1, 1e-6, 900.0), (7.3, 2e-6, 1000.0), (3.0, -5e-6, 10.0), (-4.0, 0.0, 500.0)])
        rows.append(([c * rng.uniform(0.9, 1.1) + rng.gauss(0, 0.3) * (abs(c) > 1e-3) for c in center[:dim]], float(rng.randrange(1, 9))))
    return rows + rows[:20]


def state(found):
    return found.points, found.cost, found.members, found.passes


def test_fits_are_the_same_bit_for_bit(spark):
    rows = scattered()
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    first = state(C.fit(vectors(spark, rows, None), 5, 10))
    for partitions, data in ((1, rows), (7, shuffled), (211, rows)):
        assert state(C.fit(vectors(spark, data, partitions), 5, 10)) == first


@pytest.mark.parametrize("n", [1, 7, 211])
def test_encoded_fits_are_the_same_bit_for_bit(spark, n):
    df = spark.range(3000).select((F.col("id") % 97).cast("int").alias("a"), (F.col("id") % 31).cast("string").alias("b"))
    want = state(C.fit(C.encode(df, ["a", "b"])[1], 5, 10))
    for partitions in (None, 3):
        assert state(C.fit(C.encode(df.repartition(n), ["a", "b"], partitions=partitions)[1], 5, 10)) == want


def test_seed_and_k_choose_the_start(spark):
    table = vectors(spark, scattered(), 3)
    points = [C.fit(table, 4, 0, seed).points for seed in (1, 2)]
    assert points[0] != points[1]


@pytest.mark.parametrize("k", [2, 5, 9])
def test_settled_fit_is_a_fixed_point(spark, k):
    rows = scattered()
    found = C.fit(vectors(spark, rows, 4), k, 1000, tolerance=0.0)
    assert found.settled and found.n_centers == k
    sums = [[0.0] * 4 for _ in range(k)]
    cost = 0.0
    for x, w in rows:
        near = min(range(k), key=lambda i: (math.dist(x, found.points[i]) ** 2, i))
        cost += w * math.dist(x, found.points[near]) ** 2
        sums[near] = [s + w * v for s, v in zip(sums[near], [*x, 1.0])]
    assert found.cost == pytest.approx(cost) and found.members == pytest.approx([s[3] for s in sums])
    for point, s in zip(found.points, sums):
        assert point == pytest.approx([v / s[3] for v in s[:3]], rel=1e-9, abs=1e-9)


def test_all_k_at_once_equal_single_fits(spark):
    table = vectors(spark, scattered(200), 3)
    ks = [1, 2, 6, 13, 500]
    together = M.fit_all(C._distinct(table), ks, 6, 52)
    assert list(together) == ks
    for k in ks:
        single = C.fit(table, k, 6)
        assert together[k] == single
    assert together[500].n_centers == 200 and together[500].cost == 0.0
    assert together[2].cost >= together[6].cost >= together[13].cost


def test_start_spreads_over_groups(spark):
    """Far groups, one with most of the weight: each gets a center."""
    rows = [([100.0 * g + d / 100, 0.0], 1000.0 if g == 0 else 1.0) for g in range(4) for d in range(25)]
    found = C.fit(vectors(spark, rows, 2), 4, 20)
    assert sorted(round(p[0] / 100) for p in found.points) == [0, 1, 2, 3]


def test_assign_rows(spark):
    table = spark.createDataFrame([(i, [float(i), 0.0], "x") for i in range(5)], "cluster int, features array<double>, x string")
    got = M.assign(table, [[0.0, 0.0], [4.0, 0.0], [4.0, 0.0]]).orderBy("features").collect()
    assert got[0].asDict() == {"features": [0.0, 0.0], "x": "x", "cluster": 0, "distance": 0.0}
    # Equal distances and equal centers go to the lowest number.
    assert [(r["cluster"], r["distance"]) for r in got] == [(0, 0.0), (0, 1.0), (0, 4.0), (1, 1.0), (1, 0.0)]


def test_assign_visits_by_their_labels(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 9), (None, 9)], "s string, n int")
    encoder, table = C.encode(df, ["s", "n"])
    found = C.fit(table, 2, 20)
    got = C.assign(df, encoder, found)
    assert got.columns == ["s", "n", "cluster", "distance"]
    by_n = {r["n"]: r["cluster"] for r in got.collect()}
    assert by_n[1] != by_n[9] and got.count() == 4


def test_not_finite_and_nothing(spark):
    with pytest.raises(ValueError):
        C.fit(vectors(spark, [([1.0], 1.0), ([float("inf")], 1.0)], 1), 1, 5)
    with pytest.raises(ValueError):
        C.fit(vectors(spark, [([1.0], 1.0)], 1), 0, 5)


def test_exact_sums_hold_their_digits():
    for largest in (1e-300, 0.1, 1.0, 3.0, 2.0**53, 1e200):
        unit = M.quantum(largest)
        assert 2**52 <= largest / unit <= 2**53 and math.frexp(unit)[0] == 0.5
    assert M.quantum(0.0) == 1.0


def test_ranks_of_a_free_text_feature(spark):
    """Many labels in one feature are ranked over several tasks, without a window over the feature."""
    df = spark.range(50_000).select((F.col("id") % 20_011).cast("string").alias("free"), (F.col("id") % 3).cast("string").alias("few"))
    counts = C.label_counts(C.combinations(df, ["free", "few"]), ["free", "few"])
    ranks = C.ranked_labels(counts)
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(feature" not in plan and "Window [row_number" not in plan
    rows = {(r["feature"], r["label"]): r["rank"] for r in ranks.collect()}
    want = {}
    for feature, labels in itertools.groupby(sorted(counts.collect(), key=lambda r: (r["feature"], -r["n"], r["label"])), key=lambda r: r["feature"]):
        want |= {(feature, r["label"]): float(i) for i, r in enumerate(labels)}
    assert rows == want and len(rows) == 20_014


def test_passes_add_in_batches_what_sql_adds(spark):
    """Sums of a pass equal those of ``NEAREST`` in decimals, ties and all; a task emits one row per cluster, not per vector."""
    rows = scattered(300) + [([1.0, 0.0, 4.0], 2.0), ([3.0, 0.0, 4.0], 0.5)]
    table = C._distinct(vectors(spark, rows, 5))
    lo, hi = table.select(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    units = M.Units.of(3, table.agg(F.max("w")).first()[0], lo, hi)
    centers = {2: [[0.0, 0.0, 0.0], [2.0, 0.0, 4.0]], 4: [[2.0, 0.0, 4.0], [2.0, 0.0, 4.0], [7.0, 0.0, 1000.0], [1e9, 0.0, 0.0]]}

    def exact(value, unit):
        return F.expr(f"sum(cast(rint({value} / {unit!r}D) AS decimal(20, 0)))")

    near = M.keyed(table, centers).select("k", "x", "w", F.expr(M.NEAREST).alias("near"))
    terms = [("w", units.weight), *[(f"w * x[{j}]", units.part) for j in range(3)], ("w * near.distance", units.cost)]
    want = {}
    for k, i, *sums in near.groupBy("k", "near.cluster").agg(*[exact(*t) for t in terms]).collect():
        weight, *parts, cost = [float(v) * unit for v, (_, unit) in zip(sums, terms)]
        want.setdefault(k, {})[i] = (weight, parts, cost)
    assert M.totals(table, centers, units) == want


def test_vectors_are_dealt_over_the_cores(spark, monkeypatch):
    seen = []
    old = M.totals
    monkeypatch.setattr(M, "totals", lambda v, c, u: seen.append(v.rdd.getNumPartitions()) or old(v, c, u))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        C.fit(vectors(spark, scattered(100), 2), 2, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(seen) <= spark.sparkContext.defaultParallelism
