"""Mixing against iterated resharing, and the coin's rates."""

import pytest

from visitwise.llm import mixing


def reshared(sizes, weights=(5, 2, 1), budget=1.5, cap=2):
    """Targets by cutting at the cap and sharing the excess again until nothing is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, free = {}, set(names)
    while free:
        left = budget * sum(sizes.values()) - sum(full.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        above = {s for s in free if share[s] > cap * sizes[s]}
        if not above:
            return full | share
        full |= {s: cap * sizes[s] for s in above}
        free -= above
    return full


CASES = [
    {"a": 100, "b": 100, "c": 100, "d": 100},
    {"a": 1000, "b": 10, "c": 10, None: 10},
    {"a": 1, "b": 1, "c": 1000},
    {"a": 0, "b": 50, "c": 70, "é": 30, "z": 0},
    {"only": 7},
    {None: 9},
    {f"s{i}": (i * 37) % 101 for i in range(40)},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["_source"]: r["target"] for r in mixing.source_targets(table).collect()}
    want = reshared(sizes)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_and_plan_agree(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}", "x") for i in range(300)] + [(None, None, None, "x"), (5, "w", "s1", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    plan = {}
    for r in mixing.mixing_plan(docs).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    got = {}
    for r in mixing.mix(docs).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in plan.items() if v}
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixing_plan(docs.limit(0)).count() == 0


def test_taken_words_come_near_targets(spark, sf_dir):
    rows = mixing.op6_mixing(spark, sf_dir).groupBy("source_size", "target").sum("taken", "size").collect()
    taken, target = sum(r["sum(taken)"] for r in rows), sum(r["target"] for r in rows)
    assert taken == pytest.approx(target, rel=0.15)


def test_columns_named_like_the_helpers(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}", i, "x") for i in range(60)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, a int, b string")
    clash = plain.withColumnsRenamed({"a": "_mix_rate", "b": "_mix_source"})
    got = mixing.mix(clash)
    assert got.columns == clash.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(plain).collect()))
