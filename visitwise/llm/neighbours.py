"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Inner products become distances by one more component: with M the largest norm, a vector x is
hashed as (x, sqrt(M^2 - |x|^2)) and a query q as (q * M / |q|, 0); the nearest of these are
the largest inner products. Vectors are hashed in bands of norms within a factor of two, each
with its own M, so a long vector does not set the slots of the others; a query's slots are the
same in every band, and it probes each band of its length. Every table cuts ``projections`` random directions into slots of
``width`` times M. A query visits, besides its own bucket, buckets with some slots moved by
one, in the order of the summed squared distances to the slot borders, least first.

Index rows and probes meet by bucket in blocks of numpy products, where the exact scores are
taken in double precision; the tables' best are merged and ranked again. Equal vectors are one
index row, of which only the smallest k + 1 ids can ever be returned. A bucket with more than
``bucket_rows`` vectors is split by a hash of the vector's id and its probes visit every part,
so no bucket is capped. Recall depends on the parameters and is measured in the tests.
Queries that meet too few vectors for k rows are answered by a scan of all vectors of their
length, in the same blocks, so every query gets k rows wherever there are as many candidates.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without an id; of rows that share an id the least vector counts; vectors
of different lengths are never compared; with fewer candidates than k all of them are given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitwise.llm.common import table
from visitwise.llm.registry import query
from visitwise.llm.repetition import mix
from visitwise.sources.workspace import stage


@dataclass(frozen=True)
class Settings:
    tables: int = 8
    projections: int = 5
    width: float = 1.5
    probes: int = 64
    bucket_rows: int = 20_000
    region_rows: int = 40_000
    seed: int = 5


def moves(projections: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of positions in a query's sorted list of border distances, in estimated success order.

    The order follows the expected squared distances of sorted uniform draws, so it is worked
    out once for all queries. A set may not hold both borders of one slot: positions j and
    2 * projections - 1 - j.
    """
    last = 2 * projections
    expected = []
    for j in range(1, last + 1):
        if j <= projections:
            expected.append(j * (j + 1) / (4 * (projections + 1) * (projections + 2)))
        else:
            k = last + 1 - j
            expected.append(1 - k / (projections + 1) + k * (k + 1) / (4 * (projections + 1) * (projections + 2)))
    sets: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for j in range(last):
        sets += [(cost + expected[j], chosen + (j,)) for cost, chosen in sets if last - 1 - j not in chosen]
    return [chosen for _, chosen in sorted(sets)[:probes]]


class Hasher:
    """Slot numbers of vectors and probe sequences of queries, for one vector length, in units of the band's M."""

    def __init__(self, dim: int, settings: Settings):
        rng = np.random.default_rng([settings.seed, dim])
        shape = (settings.tables, settings.projections, dim + 1)
        self.settings = settings
        self.dim = dim
        self.width = settings.width
        self.directions = rng.normal(size=shape).reshape(-1, dim + 1)
        self.offsets = rng.uniform(0, self.width, settings.tables * settings.projections)
        self.moves = moves(settings.projections, settings.probes)

    def _slots(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        flat = (np.hstack([x, extra[:, None]]) @ self.directions.T + self.offsets) / self.width
        return flat.reshape(len(x), self.settings.tables, self.settings.projections)

    def _codes(self, slots: np.ndarray, band: int) -> np.ndarray:
        """One number for (length, band, table, slots); slots: ... x tables x projections."""
        tables = np.arange(self.settings.tables, dtype=np.uint64)
        start = mix(mix(np.uint64(self.dim) * np.uint64(1_000_003) + tables) ^ np.array(band, np.int64).view(np.uint64))
        code = start * np.ones(slots.shape[:-1], dtype=np.uint64)
        for j in range(slots.shape[-1]):
            code = mix(code ^ slots[..., j].astype(np.int64).view(np.uint64))
        return code.view(np.int64)

    def index(self, x: np.ndarray, top: float, band: int) -> np.ndarray:
        x = x / top
        extra = np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))
        return self._codes(np.floor(self._slots(x, extra)), band)

    def probe(self, q: np.ndarray, bands: list[int]) -> np.ndarray:
        """queries x (bands * tables * probes) bucket codes."""
        q = q / np.abs(q).max(axis=1)[:, None]
        q = q / np.sqrt((q * q).sum(axis=1))[:, None]
        place = self._slots(q, np.zeros(len(q)))
        home = np.floor(place)
        inside = place - home
        m = self.settings.projections
        # Positions 0..m-1 move a slot down, m..2m-1 up; sorted, position p and 2m-1-p are the two borders of a slot.
        order = np.argsort(np.concatenate([inside, 1 - inside], axis=-1), axis=-1, kind="stable")
        out = []
        for chosen in self.moves:
            slots = home.copy()
            for position in chosen:
                border = order[..., position]
                step = np.where(border < m, -1.0, 1.0)
                at = (border % m)[..., None]
                np.put_along_axis(slots, at, np.take_along_axis(slots, at, -1) + step[..., None], -1)
            out += [self._codes(slots, band) for band in bands]
        return np.concatenate(out, axis=1)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        yield int(dim), np.flatnonzero(sizes == dim)


def coded(vectors: DataFrame, tops: dict[int, dict[int, float]], settings: Settings, probing: bool) -> DataFrame:
    """class_id, codes: the bucket of each table, or all buckets a query visits. ``tops``: M by length and band."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            for dim, rows in by_length(batch.column(1)):
                hasher = hashers.setdefault(dim, Hasher(dim, settings))
                bands = batch.column(2).to_numpy()[rows]
                groups = [(None, rows)] if probing else [(int(b), rows[bands == b]) for b in np.unique(bands)]
                for band, members in groups:
                    part = batch.take(pa.array(members))
                    x = matrix(part.column(1), dim)
                    codes = hasher.probe(x, list(tops[dim])) if probing else hasher.index(x, tops[dim][band], band)
                    flat = pa.array(codes.ravel())
                    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.ListArray.from_arrays(ends, flat)], ["class_id", "codes"]
                    )

    return vectors.select("class_id", "embedding", "band").mapInArrow(apply, "class_id bigint, codes array<bigint>")


def best(scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each row's ``keep`` largest scores, with all that rounding could bring up to them."""
    if scores.shape[1] > keep:
        least = np.partition(scores, scores.shape[1] - keep, axis=1)[:, -keep]
        slack = 1e-9 * np.maximum(np.abs(scores).max(axis=1), 1e-300)
        return np.nonzero(scores >= (least - slack)[:, None])
    return np.nonzero(np.ones_like(scores, dtype=bool))


def reduce_best(q: np.ndarray, v: np.ndarray, s: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``keep`` largest (score, smaller class id first), each class once."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    fresh = np.ones(len(q), dtype=bool)
    fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    q, v, s = q[fresh], v[fresh], s[fresh]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[rank < keep], v[rank < keep], s[rank < keep]


def takes_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(finite & some, F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, settings: Settings = Settings()
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of (vec_id, embedding) that ``is_query`` selects."""
    keep = k + 1
    usable = vectors.where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    one = usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # Smallest ids of equal vectors, in two steps so that a frequent vector is spread over tasks.
    salted = Window.partitionBy("embedding", "_salt").orderBy("vec_id")
    few = (
        one.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
        .withColumn("_r", F.row_number().over(salted))
        .where(F.col("_r") <= keep)
    )
    classes = few.groupBy("embedding").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep).alias("members"))
    # Scaled by the largest component, so that no square overflows or vanishes.
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x.cast("double") / F.col("_largest")) ** 2)
    classes = classes.withColumn("class_id", F.get("members", F.lit(0))).withColumn("_largest", largest)
    classes = classes.withColumn("norm", F.col("_largest") * F.sqrt(norm)).drop("_largest")
    # Borders lie at odd powers of the square root of two, away from the norm 1 of unit vectors.
    classes = stage(classes.withColumn("band", F.floor(F.log2("norm") + 0.5).cast("long")), "ann-classes")
    length = F.size("embedding").alias("length")
    sizes = classes.groupBy(length, "band").agg(
        F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.sum(F.size("members")).alias("rows")
    )
    n, tops, wanted = 0, {}, {}
    for r in sizes.orderBy("length", "band").collect():
        n += r["n"]
        tops.setdefault(r["length"], {})[r["band"]] = r["top"]
        wanted[r["length"]] = min(keep, wanted.get(r["length"], 0) + r["rows"])
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = one.where(is_query).withColumnRenamed("vec_id", "query_id")
    asked = stage(asked.join(classes.select("embedding", "class_id"), "embedding").select("query_id", "class_id"), "ann-asked")
    query_classes = classes.join(asked.select("class_id").distinct(), "class_id", "left_semi")

    def search(index: DataFrame, probes: DataFrame, copies: int, name: str) -> DataFrame:
        """qid, vec_id, score: the best ``keep`` where (class_id, code) of index and probes meet."""
        crowded = index.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > settings.bucket_rows)
        parts = F.ceil(F.col("n") / settings.bucket_rows).cast("int")
        crowded = stage(crowded.select(F.col("code").alias("_code"), parts.alias("_parts")), f"{name}-crowded")
        regions = max(1, math.ceil(n * copies / settings.region_rows))
        region = F.pmod(F.xxhash64("bucket"), F.lit(regions)).cast("int").alias("region")

        def placed(rows: DataFrame, part: Column) -> DataFrame:
            joined = rows.join(crowded, F.col("code") == F.col("_code"), "left")
            salted_ = joined.withColumn("_part", part)
            return salted_.select("class_id", F.xxhash64("code", "_part").alias("bucket")).select("class_id", "bucket", region)

        last = F.coalesce("_parts", F.lit(1))
        index = placed(index, F.pmod(F.xxhash64("class_id"), last).cast("int"))
        probes = placed(probes, F.explode(F.sequence(F.lit(0), last - 1)))
        index = index.join(classes.select("class_id", "embedding"), "class_id")
        visits = probes.groupBy("class_id", "region").agg(F.collect_list("bucket").alias("buckets"))
        visits = visits.join(classes.select("class_id", "embedding"), "class_id")
        met = index.groupBy("region").cogroup(visits.groupBy("region"))
        met = met.applyInArrow(meet, "qid bigint, class_id bigint, score double")
        by_class = Window.partitionBy("qid").orderBy(F.col("score").desc(), "class_id")
        top = met.distinct().withColumn("_r", F.row_number().over(by_class)).where(F.col("_r") <= keep)
        members = classes.select("class_id", F.explode("members").alias("vec_id"))
        by_id = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
        ranked = top.join(members, "class_id").withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= keep)
        return stage(ranked.select("qid", "vec_id", "score"), name)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qid", "class_id", "score"]
        kinds = pa.schema([("qid", pa.int64()), ("class_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        bucket = left.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        ids = left.column("class_id").to_numpy()[order]
        lists = right.column("buckets").combine_chunks()
        visited = lists.flatten().to_numpy(zero_copy_only=False)
        visitor = np.repeat(np.arange(right.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        qids = right.column("class_id").to_numpy()
        sequence = np.argsort(visited, kind="stable")
        visited, visitor = visited[sequence], visitor[sequence]
        index_vectors = left.column("embedding").combine_chunks().take(pa.array(order))
        query_vectors = right.column("embedding").combine_chunks()
        found: list[tuple] = []
        held = 0
        for code in np.unique(visited):
            a, b = np.searchsorted(bucket, [code, code + 1]) if code < np.iinfo(np.int64).max else (0, 0)
            if code == np.iinfo(np.int64).max:
                a, b = np.searchsorted(bucket, code), len(bucket)
            if a == b:
                continue
            dim = len(index_vectors[int(a)])
            v = matrix(index_vectors.slice(a, b - a), dim)
            who = visitor[np.searchsorted(visited, code, "left") : np.searchsorted(visited, code, "right")]
            for begin in range(0, len(who), 256):
                rows = who[begin : begin + 256]
                q = matrix(query_vectors.take(pa.array(rows)), dim)
                r, c = best(q @ v.T, keep)
                # Scores are summed anew per pair, so equal vectors score alike wherever they lie.
                found.append((qids[rows[r]], ids[a + c], (q[r] * v[c]).sum(axis=1)))
                held += len(r)
                if held > 2_000_000:
                    found = [reduce_best(*map(np.concatenate, zip(*found)), keep)]
                    held = len(found[0][0])
        if not found:
            return kinds.empty_table()
        return pa.table(dict(zip(names, reduce_best(*map(np.concatenate, zip(*found)), keep))))

    index = coded(classes, tops, settings, probing=False).select("class_id", F.explode("codes").alias("code"))
    probes = coded(query_classes, tops, settings, probing=True)
    probes = probes.select("class_id", F.explode(F.array_distinct("codes")).alias("code"))
    ranked = search(index, probes, settings.tables, "ann-ranked")
    found = ranked.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"))
    need = F.element_at(F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]), F.size("embedding"))
    short = query_classes.join(found, F.col("class_id") == F.col("qid"), "left")
    short = stage(short.where(F.coalesce("_n", F.lit(0)) < need).select("class_id", "embedding"), "ann-short")
    if short.count():
        # One bucket for each length; it is cut into parts like any crowded one.
        code = F.xxhash64(F.size("embedding")).alias("code")
        scanned = search(classes.select("class_id", code), short.select("class_id", code), 1, "ann-scanned")
        whole = ranked.join(short.select("class_id"), F.col("qid") == F.col("class_id"), "left_anti")
        ranked = whole.union(scanned)
    answers = asked.join(ranked, F.col("class_id") == F.col("qid")).where(F.col("vec_id") != F.col("query_id"))
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        answers.withColumn("rank", F.row_number().over(by_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


@query("op5_neighbours")
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0, 20)
