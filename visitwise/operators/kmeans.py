"""Weighted k-means over a table of distinct vectors, for one number of clusters or many at once.

A fit depends on the seed and the set of (vector, weight) only, bit for bit: not on partitions, files,
cores or the order in which tasks end. Three things make it so. Random choices are races between hashes
of (seed, k, round, vector). Distances and nearest centers are taken per row. Sums over rows
are exact: each term is rounded to a multiple of a power of two 53 binary digits below the largest
possible term, and the multiples are added as whole numbers, which is the same in any order.

All fits share each pass: centers are keyed by (k, cluster), and one aggregate over the vectors gives
the sums of every fit that has not settled. What reaches the driver is one row per center.

The start takes ``start_steps`` rounds; each adds the ``PICKS`` k vectors that win a race weighted by their
share of the cost (weighted sampling without replacement), so more than k candidates are found in the first
round wherever there are that many distinct vectors. The candidates, weighted by the vectors nearest to them,
are then reduced to k by the same race, one at a time, and moved over the candidates until they rest; the
better they stand for all vectors, the fewer passes over the vectors follow.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitwise.operators.names import fresh

Centers = list[list[float]]
# Vectors that a round of the start adds for each center asked for.
PICKS = 20
# Sums of whole numbers are kept in halves of this base.
HALF = 1 << 26
# Distances that a task holds at a time.
BLOCK = 1 << 15


@dataclass(frozen=True)
class Fit:
    """Centers of a fit: asked number, centers found, members' weight per center, cost, passes, and whether it settled."""

    k: int
    points: Centers
    cost: float
    members: list[float]
    passes: int = 0
    settled: bool = True

    @property
    def n_centers(self) -> int:
        return len(self.points)


# Struct (distance, cluster) of the center in ``centers`` nearest to ``x``, the lowest number among equals;
# the distance is squared. One text, as building it call by call takes longer than a pass over few vectors.
NEAREST = """array_min(transform(centers, (center, i) -> named_struct(
    'distance', aggregate(zip_with(x, center, (a, b) -> (a - b) * (a - b)), 0D, (total, s) -> total + s),
    'cluster', cast(i AS int))))"""


def assign(df: DataFrame, points: Centers, features: str = "features") -> DataFrame:
    """Add ``cluster`` and ``distance`` (squared) of each row's vector, an array column."""
    taken = [c for c in df.columns if c not in ("cluster", "distance")]
    row, centers = fresh(["x", "centers"], "_row", "_centers")
    # JSON keeps doubles exactly and is folded to one literal before the job starts.
    table = F.from_json(F.lit(json.dumps(points)), "array<array<double>>")
    inner = df.select(F.struct(*taken).alias(row), F.col(features).alias("x"), table.alias("centers"))
    found = inner.withColumn(centers, F.expr(NEAREST))
    return found.select(f"{row}.*", f"{centers}.cluster", f"{centers}.distance")


# -- exact sums ------------------------------------------------------------


def quantum(largest: float) -> float:
    """The power of two whose multiples hold terms of up to ``largest`` with 53 binary digits."""
    return 2.0 ** (math.frexp(largest)[1] - 53) if largest > 0 else 1.0


@dataclass(frozen=True)
class Units:
    """Units of the sums of weights, weighted components and weighted squared distances, and the sums."""

    weight: float
    part: float
    cost: float
    dim: int

    @classmethod
    def of(cls, dim: int, weight: float, lowest: float, highest: float) -> Units:
        """From the largest weight and the range of all components."""
        if not all(map(math.isfinite, (weight, lowest, highest))):
            raise ValueError("feature vectors must be finite")
        part = quantum(weight * max(abs(lowest), abs(highest)))
        return cls(quantum(weight), part, quantum(weight * dim * (highest - lowest) ** 2), dim)


# -- passes over the vectors -----------------------------------------------


def keyed(vectors: DataFrame, centers: dict[int, Centers]) -> DataFrame:
    """Every vector with ``k`` and ``centers`` of each fit."""
    fits = json.dumps([{"k": k, "centers": c} for k, c in centers.items()])
    return vectors.select("x", "w", F.inline(F.from_json(F.lit(fits), "array<struct<k: int, centers: array<array<double>>>>")))


def time_of(share: str, seed: int, turn: int, k: str = "k") -> str:
    """A vector's time in a race with ``share`` as odds, by a number in (0, 1) from the hash of seed, turn, k and vector."""
    bits = f"shiftrightunsigned(xxhash64({int(seed)}L, {turn}, {k}, x), 11)"
    return f"-ln((cast({bits} AS double) + 0.5D) / {float(2**53)!r}D) / ({share})"


def winners(rows: DataFrame, share: str, seed: int, turn: int, most: int) -> dict[int, Centers]:
    """The ``PICKS`` k vectors of each fit that win the race; ``most`` is the largest such number."""
    order = Window.partitionBy("k").orderBy("time", "x")
    raced = rows.select("k", "x", F.expr(time_of(share, seed, turn)).alias("time"))
    first = raced.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).where(F.col("place") <= PICKS * F.col("k"))
    found: dict[int, list] = {}
    for row in first.select("k", "place", "x").collect():
        found.setdefault(row["k"], []).append((row["place"], list(row["x"])))
    return {k: [x for _, x in sorted(rows)] for k, rows in found.items()}


def reduced(candidates: Centers, weights: list[float], k: int, seed: int) -> Centers:
    """k of the candidates, one by one, each the winner of a race by weight times distance to those chosen."""
    points = np.array(candidates)
    share = np.array(weights, dtype=np.float64)
    distance = np.full(len(points), np.inf)
    chosen: list[int] = []
    for turn in range(k):
        odds = share if not chosen else share * distance
        keys = [struct.pack(f"<3q{points.shape[1]}d", seed, k, turn, *p) for p in points]
        bits = [int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little") >> 11 for key in keys]
        times = [-math.log((b + 0.5) / 2**53) / o if o > 0 else math.inf for b, o in zip(bits, odds.tolist())]
        best = min((i for i in range(len(points)) if i not in chosen), key=lambda i: (times[i], candidates[i]))
        chosen.append(best)
        away = np.zeros(len(points))
        for j in range(points.shape[1]):
            away += (points[:, j] - points[best, j]) ** 2
        distance = np.minimum(distance, away)
    return [candidates[i] for i in chosen]


def polished(centers: Centers, candidates: Centers, weights: list[float], turns: int = 30) -> Centers:
    """Centers moved over the weighted candidates, a small table that stands in for all vectors."""
    points = np.array(candidates)
    for _ in range(turns):
        near, distance = np.zeros(len(points), dtype=np.int64), np.full(len(points), np.inf)
        for i, center in enumerate(centers):
            away = np.zeros(len(points))
            for j, c in enumerate(center):
                away += (points[:, j] - c) ** 2
            closer = away < distance
            near[closer], distance[closer] = i, away[closer]
        sums = {}
        for i in set(near.tolist()):
            own = [(candidates[p], weights[p]) for p in np.flatnonzero(near == i).tolist()]
            parts = [math.fsum(w * x[j] for x, w in own) for j in range(points.shape[1])]
            sums[i] = (math.fsum(w for _, w in own), parts)
        new = moved(centers, sums)
        if new == centers:
            break
        centers = new
    return centers


def start(vectors: DataFrame, first: dict[int, Centers], seed: int, steps: int, units: Units) -> dict[int, Centers]:
    """The first centers of each fit, from a first candidate of each."""
    candidates = dict(first)
    for turn in range(1, steps + 1):
        rows = keyed(vectors, candidates).select("k", "x", "w", F.expr(NEAREST).alias("nearest"))
        away = rows.where("nearest.distance > 0")
        more = winners(away, "w * nearest.distance", seed, turn, PICKS * max(candidates))
        candidates = {k: held + more.get(k, []) for k, held in candidates.items()}
    out = {}
    for k, sums in totals(vectors, candidates, units).items():
        weights = [sums[i][0] if i in sums else 0.0 for i in range(len(candidates[k]))]
        out[k] = polished(reduced(candidates[k], weights, k, seed), candidates[k], weights)
    return out


def _halves(values: np.ndarray) -> list[np.ndarray]:
    """Whole numbers of up to 53 binary digits as two numbers whose sums over many rows stay exact."""
    high = np.floor(values / HALF)
    return [high, values - high * HALF]


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``NEAREST`` of many vectors: cluster and distance, with the components added in the same order."""
    cluster, distance = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    rows = max(1, BLOCK // len(centers))
    for at in range(0, len(x), rows):
        away = np.zeros((len(x[at : at + rows]), len(centers)))
        for j in range(x.shape[1]):
            apart = x[at : at + rows, j, None] - centers[None, :, j]
            apart *= apart
            away += apart
        own = away.argmin(axis=1)
        cluster[at : at + rows], distance[at : at + rows] = own, away[np.arange(len(own)), own]
    return cluster, distance


def totals(vectors: DataFrame, centers: dict[int, Centers], units: Units) -> dict[int, dict[int, tuple]]:
    """Per fit and cluster with members: weight, weighted component sums and cost. One pass for all fits.

    A task adds its vectors up in Arrow batches and emits one row for each cluster it met; sums are in
    multiples of the units, as two halves of whole numbers, so they are exact in any order.
    """
    points = {k: np.array(c, dtype=np.float64) for k, c in centers.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros((len(c), 2 * units.dim + 5), dtype=np.int64) for k, c in points.items()}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, units.dim)
            w = batch.column(1).to_numpy(zero_copy_only=False)
            own = _halves(np.rint(w / units.weight))
            for j in range(units.dim):
                own += _halves(np.rint(w * x[:, j] / units.part))
            for k, c in points.items():
                cluster, distance = nearest(x, c)
                found = [*own, *_halves(np.rint(w * distance / units.cost))]
                held[k][:, 0] += np.bincount(cluster, minlength=len(c))
                for place, part in enumerate(found, 1):
                    held[k][:, place] += np.bincount(cluster, part, len(c)).astype(np.int64)
        rows = [(k, i, own.tolist()) for k, sums in held.items() for i, own in enumerate(sums) if own[0]]
        columns = [list(column) for column in zip(*rows)] or [[], [], []]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["k", "cluster", "s"])

    summed = vectors.select("x", "w").mapInArrow(add, "k int, cluster int, s array<bigint>")
    sums = [F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(1, 2 * units.dim + 5)]
    out: dict[int, dict[int, tuple]] = {k: {} for k in centers}
    for k, cluster, *halves in summed.groupBy("k", "cluster").agg(*sums).collect():
        weight, *parts, cost = [float(high * HALF + low) for high, low in zip(halves[::2], halves[1::2])]
        out[k][cluster] = (weight * units.weight, [p * units.part for p in parts], cost * units.cost)
    return out


def moved(centers: Centers, sums: dict[int, tuple]) -> Centers:
    """Each center at the mean of its members; one without members stays."""
    return [
        [part / sums[i][0] for part in sums[i][1]] if i in sums and sums[i][0] > 0 else center
        for i, center in enumerate(centers)
    ]


def fit_all(
    vectors: DataFrame, ks: Iterable[int], iterations: int, seed: int, start_steps: int = 1, tolerance: float = 1e-4
) -> dict[int, Fit]:
    """A fit for each k over (x array<double>, w double) with distinct x, kept in memory meanwhile.

    With at least as many clusters as vectors the vectors are the centers, in the order of their
    components, and the cost is zero. A fit settles when no center moves by more than ``tolerance``.
    """
    ks = sorted(set(ks))
    if not ks or ks[0] < 1:
        raise ValueError("the number of clusters must be 1 or more")
    # As many tasks as cores: a pass takes a task little more than its start.
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    vectors = vectors.select("x", "w").coalesce(cores).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # One pass: size, dimension, ranges, and the winner of each fit's first race.
        firsts = [F.expr(f"min(named_struct('time', {time_of('w', seed, 0, str(k))}, 'x', x)).x") for k in ks]
        size = vectors.agg(
            F.expr("count(*)").alias("n"),
            F.expr("max(size(x))").alias("dim"),
            F.expr("max(w)").alias("w"),
            F.expr("min(array_min(x))").alias("lo"),
            F.expr("max(array_max(x))").alias("hi"),
            F.array(*firsts).alias("firsts"),
        ).first()
        if not size["n"]:
            raise ValueError("there are no feature vectors to cluster")
        units = Units.of(size["dim"], size["w"], size["lo"], size["hi"])
        found: dict[int, Fit] = {}
        first = {k: [list(x)] for k, x in zip(ks, size["firsts"]) if size["n"] > k}
        for k in set(ks) - set(first):
            rows = sorted((list(row["x"]), row["w"]) for row in vectors.collect())
            found[k] = Fit(k, [x for x, _ in rows], 0.0, [w for _, w in rows])
        active = start(vectors, first, seed, start_steps, units) if first else {}
        for step in range(iterations + 1):
            settled, sums_of = [], totals(vectors, active, units) if active else {}
            for k, sums in sums_of.items():
                new = moved(active[k], sums)
                far = max(math.dist(a, b) for a, b in zip(active[k], new))
                # The sums belong to the centers of this pass, so cost and members are known where nothing moves on.
                if far == 0 or step == iterations or k in found:
                    held = [sums[i][0] if i in sums else 0.0 for i in range(k)]
                    cost = math.fsum(s[2] for s in sums.values())
                    found[k] = Fit(k, active[k], cost, held, step, far == 0 or k in found)
                    settled.append(k)
                elif far <= tolerance:
                    # One more pass for the cost of the centers that it settles on.
                    found[k] = Fit(k, new, math.nan, [], step + 1)
                active[k] = new
            for k in settled:
                del active[k]
        return {k: found[k] for k in ks}
    finally:
        vectors.unpersist()
