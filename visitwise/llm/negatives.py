"""Hard negatives by angular triangle filtering.

For each anchor the rows of its own label with the highest scores are its positives; for each positive
the highest-scoring rows of other labels whose score lies in a window below the positive's are its hard
negatives. A score is the inner product of two vectors of integers, floor(scale * component).

Every row keeps its norm and its angles to a few reference directions. By the triangle inequality for
angles, rows at angles u and v from one direction are between |u - v| and u + v apart, so the cosine of
an anchor and a row lies between cos(u + v) and cos(u - v), for every direction (beyond a half turn
cos(u + v) still is the lower bound). Times both norms, and widened by what rounding can do, these are
bounds of the score. Only a pair whose bounds overlap what is still sought (a score not below the worst
positive held, or one of the windows above the worst negative held) is scored, in integers.

Rows are laid out by label, nearest direction and angle to it, so the rows of an Arrow batch have narrow
ranges of angles; bounds are taken for (anchor, batch) first and for (anchor, row) after that. Anchors
are the stated query set: they go to the tasks in blocks of ``block_bytes``, in the layout's order, and
for each block every task reads its rows twice, once for positives and once for negatives. A task hands
on its best rows per anchor and window only, so no label, cell or bucket is gathered anywhere. The number of blocks grows
with the anchors; the data sent for a block does not.

Directions are a hash-chosen sample of ``directions`` rows, filled up by seeded ones for vectors of
other lengths; they decide how many pairs are scored and never the result.

Defined results: rows with a null label or vector, or with a null or non-finite component take no part;
vectors of different lengths never meet; zero vectors score 0. Scores tie by the smaller id, a missing id
last. A row without an id is never an anchor. No row that has the anchor's id is its positive. Repeated
rows are positives and negatives as often as they occur; a repeated anchor counts once. An empty table
gives no rows. Extra columns are ignored. Integer scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitwise.llm.common import hash_order, table
from visitwise.llm.registry import query
from visitwise.operators.ordering import numbered
from visitwise.sources.workspace import new_path, stage


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low_percent: int = 50
    high_percent: int = 95
    directions: int = 8
    # Directions used for (anchor, row) bounds: those that lie closest along the anchor's line.
    pair_directions: int = 3
    block_bytes: int = 16 * 1024 * 1024
    task_rows: int = 100_000
    tile_anchors: int = 64
    tile_bytes: int = 8 * 1024 * 1024
    seed: int = 13


LOWEST = np.iinfo(np.int64).min
EXACT_DOUBLE = 2**53
ROW = "_id bigint, _label bigint, _ints array<bigint>, _norm double, _angles array<double>"


def finite(vector: str) -> Column:
    """The vector is there and all its components are finite numbers."""
    x = F.transform(vector, lambda c: c.cast("double"))
    return F.coalesce(F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))), F.lit(False))


def directions(sample: list[list[int]], dim: int, settings: Settings) -> np.ndarray:
    """Unit vectors of one length: those of the sample that have it, filled up by seeded ones."""
    rng = np.random.default_rng([settings.seed, dim])
    out = rng.standard_normal((settings.directions, dim))
    for place, vector in enumerate([v for v in sample if len(v) == dim and any(v)][: settings.directions]):
        out[place] = vector
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def slack(dim: int) -> float:
    """What rounding can add to a cosine bound.

    A computed cosine is off by less than (dim + 16) half units, so near 0 or a half turn its angle is off
    by up to the square root of twice that; both angles of a bound may be.
    """
    return 4.0 * float(np.sqrt(2.0 * (dim + 16) * np.finfo(np.float64).eps))


def of_one_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the lists of each length."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[offsets[rows][:, None] + np.arange(size)]


def with_angles(rows: DataFrame, sample: list[list[int]], settings: Settings) -> DataFrame:
    """Add norm, angles to the directions, the nearest direction and the angle to it."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            norm = np.zeros(batch.num_rows)
            angles = np.zeros((batch.num_rows, settings.directions))
            for at, ints in of_one_length(batch.column(2)):
                dim = ints.shape[1]
                if dim not in known:
                    known[dim] = directions(sample, dim, settings)
                x = ints.astype(np.float64)
                norm[at] = np.sqrt((x * x).sum(axis=1))
                # A zero vector gets right angles; its bounds are zero whatever they are.
                cosines = (x @ known[dim].T) / np.where(norm[at] > 0, norm[at], 1.0)[:, None]
                angles[at] = np.arccos(np.clip(cosines, -1.0, 1.0))
            cell = angles.argmin(axis=1)
            listed = pa.ListArray.from_arrays(
                np.arange(batch.num_rows + 1, dtype=np.int32) * settings.directions, angles.ravel()
            )
            nearest = angles[np.arange(batch.num_rows), cell]
            columns = [*batch.columns[:3], pa.array(norm), listed, pa.array(cell.astype(np.int32)), pa.array(nearest)]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_label", "_ints", "_norm", "_angles", "_cell", "_near"])

    return rows.mapInArrow(measure, f"{ROW}, _cell int, _near double")


@dataclass
class Rows:
    """Rows of one vector length as arrays; a missing id is flagged, as every integer is a possible id."""

    ids: np.ndarray
    missing: np.ndarray
    labels: np.ndarray
    ints: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Rows]]:
        """(places in the batch, rows) by length."""
        missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy()
        labels, norms = batch.column(1).to_numpy(), batch.column(3).to_numpy()
        _, angles = next(of_one_length(batch.column(4)), (None, None))
        for at, ints in of_one_length(batch.column(2)):
            yield at, cls(ids[at], missing[at], labels[at], ints, norms[at], angles[at])

    def take(self, at) -> Rows:
        return Rows(self.ids[at], self.missing[at], self.labels[at], self.ints[at], self.norms[at], self.angles[at])

    def __len__(self) -> int:
        return len(self.ids)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where every partial sum is an exact double."""
    largest = [float(np.abs(m.astype(np.float64)).max(initial=0.0)) for m in (a, b)]
    if largest[0] * largest[1] * max(1, a.shape[1]) < EXACT_DOUBLE:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def scaled(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, extra: float) -> tuple:
    """Cosine bounds times products of norms between ``least`` and ``most``, widened by the rounding."""
    above = np.where(high >= 0, high * most, high * least) + extra * most + 1.0
    below = np.where(low >= 0, low * least, low * most) - extra * most - 1.0
    return below, above


def batch_bounds(anchors: Rows, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of every anchor's scores with any of the rows, from the rows' ranges of angles and norms."""
    first, last = rows.angles.min(axis=0), rows.angles.max(axis=0)
    u = anchors.angles
    apart = np.maximum(np.maximum(first - u, u - last), 0.0).max(axis=1)
    reach = np.where(u + last <= np.pi, u + last, np.where(u + first >= np.pi, 2 * np.pi - u - first, np.pi)).min(axis=1)
    norms = anchors.norms
    return scaled(
        np.cos(reach), np.cos(apart), norms * rows.norms.min(), norms * rows.norms.max(), slack(rows.ints.shape[1])
    )


class PairBounds:
    """Bounds of one anchor's scores with each of the rows."""

    def __init__(self, rows: Rows, keep: int):
        self.cos, self.sin = np.cos(rows.angles.T), np.sin(rows.angles.T)
        self.norms, self.extra, self.keep = rows.norms, slack(rows.ints.shape[1]), keep

    def of(self, angles: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        # cos(u - v) and cos(u + v) without their angles: the smaller sin(u), the closer they are.
        cos, sin = np.cos(angles), np.sin(angles)
        low, high = -1.0, 1.0
        for j in np.argsort(sin)[: self.keep]:
            along, across = cos[j] * self.cos[j], sin[j] * self.sin[j]
            low, high = np.maximum(low, along - across), np.minimum(high, along + across)
        both = norm * self.norms
        return low * both - self.extra * both - 1.0, high * both + self.extra * both + 1.0


class Best:
    """The best few (score, id) of a number of lists, highest score first, then the smallest id, a missing one last."""

    def __init__(self, lists: int, keep: int):
        self.scores = np.full((lists, keep), LOWEST, dtype=np.int64)
        self.ids = np.zeros((lists, keep), dtype=np.int64)
        self.missing = np.zeros((lists, keep), dtype=bool)
        self.held = np.zeros(lists, dtype=np.int64)

    def least(self, i) -> np.ndarray:
        """What a score must reach to change list i."""
        return self.scores[i, -1]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        n, keep = self.held[i], self.scores.shape[1]
        scores = np.concatenate([self.scores[i, :n], scores])
        ids = np.concatenate([self.ids[i, :n], ids])
        missing = np.concatenate([self.missing[i, :n], missing])
        order = np.lexsort((ids, missing, ~scores))[:keep]
        self.held[i] = len(order)
        for mine, new in ((self.scores, scores), (self.ids, ids), (self.missing, missing)):
            mine[i, : len(order)] = new[order]

    def batch(self, numbers: np.ndarray, lists_per_number: int) -> pa.RecordBatch:
        """_anchor, _window, _row, _score of everything held."""
        place = np.arange(self.scores.shape[1]) < self.held[:, None]
        lists = np.nonzero(place)[0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(numbers[lists // lists_per_number]),
                pa.array((lists % lists_per_number).astype(np.int64)),
                pa.array(self.ids[place], mask=self.missing[place]),
                pa.array(self.scores[place]),
            ],
            ["_anchor", "_window", "_row", "_score"],
        )


FOUND = "_anchor bigint, _window bigint, _row bigint, _score bigint"


def overlapping(
    anchors: Rows, rows: Rows, low: np.ndarray, high: np.ndarray, settings: Settings
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores) of the pairs whose bounds overlap a window of the anchor.

    ``low`` and ``high`` hold the ends of the windows, one line per anchor.
    """
    below, above = batch_bounds(anchors, rows)
    windows = (above[:, None] >= low) & (below[:, None] <= high) & (low <= high)
    possible = np.flatnonzero(windows.any(axis=1))
    bounds = None
    for start in range(0, len(possible), settings.tile_anchors):
        masks = []
        for i in possible[start : start + settings.tile_anchors]:
            sought = windows[i]
            bounds = bounds or PairBounds(rows, settings.pair_directions)
            least, most = bounds.of(anchors.angles[i], anchors.norms[i])
            mask = np.zeros(len(rows), dtype=bool)
            for lower, upper in zip(low[i, sought], high[i, sought]):
                mask |= (most >= lower) & (least <= upper)
            if mask.any():
                masks.append((i, mask))
        if masks:
            used = np.flatnonzero(np.logical_or.reduce([m for _, m in masks]))
            scores = products(anchors.ints[[i for i, _ in masks]], rows.ints[used])
            for (i, mask), line in zip(masks, scores):
                mine = mask[used]
                yield i, used[mine], line[mine]


def tiles(rows: Rows, settings: Settings) -> Iterator[Rows]:
    step = max(1, settings.tile_bytes // (8 * (rows.ints.shape[1] + 4 * settings.directions)))
    for start in range(0, len(rows), step):
        yield rows.take(slice(start, start + step))


def scan(rows: DataFrame, block: Block, visit: Callable, keep: int, settings: Settings) -> DataFrame:
    """Every task's best rows for every anchor and window of the block: ``visit`` sees each tile of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        best = Best(len(held.numbers) * held.windows, keep)
        for batch in batches:
            for _, same_length in Rows.of(batch):
                at = held.of_length(same_length.ints.shape[1])
                for tile in tiles(same_length, settings) if len(at) else ():
                    visit(held, at, tile, best, settings)
        yield best.batch(held.numbers, held.windows)

    return rows.select("_id", "_label", "_ints", "_norm", "_angles").mapInArrow(search, FOUND)


@dataclass
class Block:
    """Anchors of one block by vector length, with their numbers and, for negatives, their windows."""

    numbers: np.ndarray
    anchors: list[tuple[np.ndarray, Rows]]
    windows: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def of_length(self, dim: int) -> np.ndarray:
        """Places of the anchors with vectors of that length."""
        return next((at for at, rows in self.anchors if rows.ints.shape[1] == dim), np.zeros(0, dtype=np.int64))

    def rows_of_length(self, dim: int) -> Rows:
        return next(rows for _, rows in self.anchors if rows.ints.shape[1] == dim)


def visit_positives(block: Block, at: np.ndarray, rows: Rows, best: Best, settings: Settings) -> None:
    """Rows of the anchor's own label, each a candidate until better ones are held."""
    anchors = block.rows_of_length(rows.ints.shape[1])
    for label in np.unique(rows.labels):
        mine = np.flatnonzero(anchors.labels == label)
        if not len(mine):
            continue
        some, held = rows.take(rows.labels == label), anchors.take(mine)
        least = np.where(best.held[at[mine]] < settings.positives, -np.inf, best.least(at[mine]).astype(float))
        for i, found, scores in overlapping(held, some, least[:, None], np.full((len(mine), 1), np.inf), settings):
            place = at[mine[i]]
            good = some.missing[found] | (some.ids[found] != held.ids[i])
            if best.held[place] == settings.positives:
                good &= scores >= best.least(place)
            if good.any():
                best.add(place, scores[good], some.ids[found][good], some.missing[found][good])


def visit_negatives(block: Block, at: np.ndarray, rows: Rows, best: Best, settings: Settings) -> None:
    """Rows of other labels in the windows below the anchor's positives."""
    anchors = block.rows_of_length(rows.ints.shape[1])
    lists = at[:, None] * block.windows + np.arange(block.windows)
    full = best.held[lists] == settings.negatives
    low, high = block.low[at], block.high[at]
    floor = np.where(full, np.maximum(low, best.least(lists)), low)
    for i, found, scores in overlapping(anchors, rows, floor, high, settings):
        other = rows.labels[found] != anchors.labels[i]
        found, scores = found[other], scores[other]
        for w in range(block.windows):
            good = (scores >= floor[i, w]) & (scores <= high[i, w])
            if good.any():
                best.add(lists[i, w], scores[good], rows.ids[found][good], rows.missing[found][good])


def top(found: DataFrame, keep: int) -> DataFrame:
    """The best rows of each anchor and window over all tasks, with their rank from 1."""
    best = Window.partitionBy("_anchor", "_window").orderBy(F.desc("_score"), F.col("_row").asc_nulls_last())
    return found.withColumn("_rank", F.row_number().over(best).cast("int")).where(F.col("_rank") <= keep)


def window_ends(score: int, settings: Settings) -> tuple[int, int]:
    """Least and greatest integer s with low * score <= 100 * s <= high * score."""
    return -((-settings.low_percent * score) // 100), settings.high_percent * score // 100


def mine_block(rows: DataFrame, anchors: DataFrame, settings: Settings) -> DataFrame:
    """Negatives of one block of anchors; what reaches the driver is bounded by the block."""
    batch = anchors.select("_id", "_label", "_ints", "_norm", "_angles", "_number").toArrow().combine_chunks()
    batch = batch.to_batches()[0]
    numbers = batch.column(5).to_numpy()
    block = Block(numbers, list(Rows.of(batch)), 1)
    positives = stage(top(scan(rows, block, visit_positives, settings.positives, settings), settings.positives), "positives")
    low = np.full((len(numbers), settings.positives), 1, dtype=np.int64)
    high = np.zeros((len(numbers), settings.positives), dtype=np.int64)
    place = {number: i for i, number in enumerate(numbers.tolist())}
    for row in positives.select("_anchor", "_rank", "_score").collect():
        ends = window_ends(row["_score"], settings)
        low[place[row["_anchor"]], row["_rank"] - 1], high[place[row["_anchor"]], row["_rank"] - 1] = ends
    block = Block(numbers, block.anchors, settings.positives, low, high)
    negatives = top(scan(rows, block, visit_negatives, settings.negatives, settings), settings.negatives)
    pairs = positives.select(
        F.col("_anchor").alias("_of"),
        (F.col("_rank") - 1).cast("long").alias("_nth"),
        F.col("_row").alias("positive_id"),
        F.col("_score").alias("positive_score"),
    )
    found = negatives.join(pairs, (F.col("_anchor") == F.col("_of")) & (F.col("_window") == F.col("_nth")))
    ids = anchors.select(F.col("_number").alias("_own"), F.col("_id").alias("anchor_id"))
    return found.join(ids, F.col("_anchor") == F.col("_own")).select(
        "anchor_id",
        "positive_id",
        F.col("_rank").alias("rank"),
        F.col("_row").alias("negative_id"),
        "positive_score",
        F.col("_score").alias("negative_score"),
    )


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, settings: Settings = Settings(), vector: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, an integer label and the vector; ``is_anchor`` says which rows are anchors.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col("label").isNotNull() & finite(vector))
    integers = F.transform(vector, lambda c: F.floor(F.lit(float(settings.scale)) * c.cast("double")).cast("long"))
    rows = usable.select(
        F.col("vec_id").cast("long").alias("_id"),
        F.col("label").cast("long").alias("_label"),
        integers.alias("_ints"),
        F.coalesce(is_anchor & F.col("vec_id").isNotNull(), F.lit(False)).alias("_is_anchor"),
    )
    plain = rows.select("_id", "_label", "_ints")
    sample = plain.orderBy(hash_order("_id", "_label", "_ints", seed=settings.seed)).limit(settings.directions)
    sample = [list(r["_ints"]) for r in sample.collect()]
    layout = ["_label", "_cell", "_near", "_id"]
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_ints")).alias("dim")).first()
    tasks = max(spark.sparkContext.defaultParallelism, size["n"] // settings.task_rows + 1)
    measured = with_angles(plain, sample, settings).repartitionByRange(tasks, *layout).sortWithinPartitions(*layout)
    laid = stage(measured, "laid-out")
    anchors = with_angles(rows.where("_is_anchor").select("_id", "_label", "_ints").distinct(), sample, settings)
    anchors = stage(numbered(anchors, *layout, "_ints", name="_number"), "anchors")
    per_block = max(1, settings.block_bytes // (8 * ((size["dim"] or 0) + settings.directions + 8)))
    path = new_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for first in range(1, anchors.count() + 1, per_block):
        block = anchors.where(F.col("_number").between(first, first + per_block - 1))
        mine_block(laid, block, settings).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


ORACLE = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


@query("op13_hard_negatives", ORACLE)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)
