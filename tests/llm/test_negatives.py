"""Angular bounds against exact scores, and mined negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import oracle
from visitwise.llm import negatives as N

SCHEMA = "vec_id long, label int, embedding array<double>, _id string, _label string, _ints string, _number string"


def plain(rows, s, every=50):
    """The result by scoring every anchor with every row."""
    usable = []
    for vec_id, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((vec_id, label, tuple(math.floor(s.scale * x) for x in vector)))
    last = float("inf")
    out = []
    for own, label, v in {r for r in usable if r[0] is not None and r[0] % every == 0}:
        found = [(sum(map(int.__mul__, v, w)), i, m == label) for i, m, w in usable if len(w) == len(v)]
        found.sort(key=lambda r: (-r[0], last if r[1] is None else r[1]))
        for score, i, _ in [r for r in found if r[2] and r[1] != own][: s.positives]:
            low, high = s.low_percent * score, s.high_percent * score
            hard = [r for r in found if not r[2] and low <= 100 * r[0] <= high][: s.negatives]
            out += [(own, i, rank, j, score, other) for rank, (other, j, _) in enumerate(hard, 1)]
    return sorted(out, key=repr)


def got(spark, rows, s, every=50):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, N.hard_negatives(df, F.col("vec_id") % every == 0, s).collect()), key=repr)


def awkward(seed, n=300, values=(-0.5, 0.0, 0.25, 1.0, 0.7)):
    """Few values, so scores tie; missing parts, other lengths, repeated rows and ids, a hot label."""
    rng = random.Random(seed)
    rows = [(i, 0 if i % 3 else rng.randrange(4), [rng.choice(values) for _ in range(4)]) for i in range(n)]
    rows += [(n + i, i % 2, [rng.choice(values) for _ in range(i % 3)]) for i in range(40)]
    rows += [(n + 50, None, [1.0] * 4), (n + 51, 1, None), (n + 52, 1, [1.0, None, 1.0, 1.0]), (n + 53, 1, [0.0] * 4)]
    rows += [(n + 54, 1, [float("nan")] * 4), (n + 55, 1, [1.0, float("inf"), 0.0, 0.0]), (None, 1, [1.0] * 4)]
    rows += [(None, 2, [1.0] * 4), (0, rows[0][1], rows[0][2]), (50, 1, [1.0] * 4), (5, rows[5][1], rows[5][2])]
    return rows


@pytest.mark.parametrize(
    "settings",
    [
        N.Settings(),
        N.Settings(block_bytes=1500, task_rows=20, tile_anchors=2, tile_bytes=600, directions=3, pair_directions=1),
        N.Settings(positives=2, negatives=4, low_percent=10, high_percent=100, scale=10, directions=1),
    ],
)
def test_awkward_rows(spark, settings):
    rows = awkward(settings.directions)
    want = plain(rows, settings, every=20)
    assert want and got(spark, rows, settings, every=20) == want


def test_large_components_are_exact(spark):
    """Scores above 2 ** 53, where doubles would round."""
    rng = random.Random(4)
    rows = [(i, i % 2, [float(rng.randrange(1, 2**20)) for _ in range(5)]) for i in range(120)]
    settings = N.Settings(scale=2**9)
    want = plain(rows, settings, every=10)
    assert max(r[4] for r in want) > 2**53 and got(spark, rows, settings, every=10) == want


def clustered(n, dim, spread, seed):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, dim))
    return centers[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, dim))


@pytest.mark.parametrize("dim", [1, 2, 16, 64])
@pytest.mark.parametrize("spread", [0.0, 1e-7, 0.1, 3.0])
def test_bounds_hold(dim, spread):
    ints = np.floor(1000 * clustered(300, dim, spread, dim)).astype(np.int64)
    ints[::40] = 0
    ints[1::40] = -ints[2::40][: len(ints[1::40])]
    known = N.directions([list(map(int, v)) for v in ints[:5]], dim, N.Settings())
    norms = np.sqrt((ints.astype(float) ** 2).sum(axis=1))
    angles = np.arccos(np.clip(ints @ known.T / np.where(norms > 0, norms, 1)[:, None], -1, 1))
    ids, no = np.arange(300), np.zeros(300, dtype=bool)
    rows = N.Rows(ids, no, ids, ints, norms, angles)
    scores = N.products(ints, ints)
    below, above = N.batch_bounds(rows, rows)
    assert (below <= scores.min(axis=1)).all() and (scores.max(axis=1) <= above).all()
    bounds = N.PairBounds(rows, 3)
    for i in range(300):
        least, most = bounds.of(angles[i], norms[i])
        assert (least <= scores[i]).all() and (scores[i] <= most).all()


def test_only_overlapping_pairs_are_scored():
    """In clustered vectors most pairs are ruled out by their bounds."""
    ints = np.floor(1000 * clustered(2000, 32, 0.02, 9)).astype(np.int64)
    s = N.Settings()
    known = N.directions([list(map(int, v)) for v in ints[: s.directions]], 32, s)
    norms = np.sqrt((ints.astype(float) ** 2).sum(axis=1))
    angles = np.arccos(np.clip(ints @ known.T / norms[:, None], -1, 1))
    rows = N.Rows(np.arange(2000), np.zeros(2000, dtype=bool), np.zeros(2000), ints, norms, angles)
    anchors = rows.take(slice(0, 20))
    exact = N.products(anchors.ints, ints)
    low, high = 0.99 * np.sort(exact, axis=1)[:, -20:-19], np.full((20, 1), np.inf)
    scored = 0
    for i, found, scores in N.overlapping(anchors, rows, low, high, s):
        scored += len(found)
        assert set(np.flatnonzero(exact[i] >= low[i])) <= set(found) and (exact[i, found] == scores).all()
    assert scored < 0.5 * exact.size


def test_empty_tables(spark):
    assert got(spark, [], N.Settings()) == []
    assert got(spark, [(1, 1, [1.0]), (2, 2, [1.0])], N.Settings()) == []
    assert got(spark, [(0, 1, [1.0]), (2, 2, [1.0])], N.Settings()) == []


def test_sql(spark, sf_dir):
    con = oracle.connect(sf_dir)
    assert oracle.spark_result(N.op13_hard_negatives(spark, sf_dir)) == oracle.duck_result(con, N.ORACLE)
