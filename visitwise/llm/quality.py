"""Quality score by a byte-level convolutional network in numpy.

A text's bytes are cut into chunks that overlap by the filter width, so no position is
missed. Filters are tables (position, byte, filter); a chunk's outputs are max-pooled, and
the largest and the mean of the chunk maxima are combined into one probability.

The network is fitted by Adam on a sample of labelled documents with the bounds of
``Settings``; scoring is one narrow Arrow pass over all documents and whole texts.

Defined results: null and empty texts have zero features and get the score of the bias; with
no labelled document every score is 0.5. Repeated rows are scored once each; labels, lang,
source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitwise.llm.common import hash_order, held_out, map_batches, table
from visitwise.llm.registry import query


@dataclass(frozen=True)
class Settings:
    filters: int = 16
    width: int = 6
    chunk: int = 4096
    # Bounds of the labelled sample: documents of each label, and the longest text used.
    sample_per_label: int = 1200
    sample_text_bytes: int = 65_536
    epochs: int = 8
    batch: int = 32
    rate: float = 0.02
    # Share of training steps that see a short random piece of the text, so that few words suffice to judge.
    piece_share: float = 0.3
    piece_bytes: int = 256
    threshold: float = 0.7
    seed: int = 11


class Network:
    """Filter tables, filter biases, and weights of the largest and the mean chunk maxima."""

    def __init__(self, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.settings = settings
        self.table = rng.normal(0, 0.1, (settings.width, 256, settings.filters)).astype(np.float32)
        self.bias = np.zeros(settings.filters, dtype=np.float32)
        self.top = rng.normal(0, 0.3, settings.filters).astype(np.float32)
        self.mean = rng.normal(0, 0.3, settings.filters).astype(np.float32)
        self.offset = np.zeros(1, dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.top, self.mean, self.offset]

    def chunks(self, raw: np.ndarray) -> Iterator[np.ndarray]:
        """Overlapping byte chunks; texts shorter than the filters are filled up with zero bytes."""
        width, size = self.settings.width, self.settings.chunk
        if len(raw) and len(raw) < width:
            raw = np.concatenate([raw, np.zeros(width - len(raw), dtype=np.uint8)])
        for start in range(0, len(raw) - width + 1, size):
            yield raw[start : start + size + width - 1]

    def pool(self, raw: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Chunk maxima (chunks x filters), and the bytes under each maximum."""
        width = self.settings.width
        best, windows = [], []
        for part in self.chunks(raw):
            count = len(part) - width + 1
            out = self.table[0].take(part[:count], axis=0)
            for j in range(1, width):
                out += self.table[j].take(part[j : j + count], axis=0)
            if places:
                at = out.argmax(axis=0)
                best.append(out[at, np.arange(out.shape[1])])
                windows.append(part[at[:, None] + np.arange(width)])
            else:
                best.append(out.max(axis=0))
        if not best:
            return np.zeros((0, self.settings.filters), np.float32), None
        pooled = np.maximum(np.stack(best) + self.bias, 0)
        return pooled, np.stack(windows) if places else None

    def logit(self, pooled: np.ndarray) -> float:
        if not len(pooled):
            return float(self.offset[0])
        return float(pooled.max(axis=0) @ self.top + pooled.mean(axis=0) @ self.mean + self.offset[0])

    def score(self, text: str | None) -> float:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        pooled, _ = self.pool(raw)
        return float(1 / (1 + np.exp(-np.clip(self.logit(pooled), -40, 40))))

    def add_gradient(self, raw: np.ndarray, label: int, weight: float, grads: list[np.ndarray]) -> None:
        pooled, windows = self.pool(raw, places=True)
        error = weight * (1 / (1 + np.exp(-np.clip(self.logit(pooled), -40, 40))) - label)
        g_table, g_bias, g_top, g_mean, g_offset = grads
        g_offset += error
        if not len(pooled):
            return
        g_top += error * pooled.max(axis=0)
        g_mean += error * pooled.mean(axis=0)
        filters = np.arange(pooled.shape[1])
        back = np.broadcast_to(error * self.mean / len(pooled), pooled.shape).copy()
        back[pooled.argmax(axis=0), filters] += error * self.top
        back *= pooled > 0
        g_bias += back.sum(axis=0)
        for j in range(self.settings.width):
            np.add.at(g_table[j], (windows[:, :, j], filters), back)


def fit(
    texts: list[str], labels: list[int], settings: Settings = Settings(), shares: dict[int, float] | None = None
) -> Network | None:
    """Adam over mini-batches. The sample's labels weigh as ``shares`` says, or as they occur in it."""
    if not texts:
        return None
    net = Network(settings)
    raws = [np.frombuffer((t or "").encode("utf-8", "surrogatepass"), dtype=np.uint8) for t in texts]
    weight = {y: (shares[y] * len(labels) / labels.count(y) if shares else 1.0) for y in set(labels)}
    rng = np.random.default_rng(settings.seed)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    step = 0
    total = settings.epochs * -(-len(texts) // settings.batch)
    for _ in range(settings.epochs):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), settings.batch):
            step += 1
            grads = [np.zeros_like(w) for w in net.weights()]
            batch = order[begin : begin + settings.batch]
            for i in batch:
                raw = raws[i]
                if len(raw) > 8 and rng.random() < settings.piece_share:
                    size = int(rng.integers(8, settings.piece_bytes))
                    start = int(rng.integers(0, max(1, len(raw) - size)))
                    raw = raw[start : start + size]
                net.add_gradient(raw, labels[i], weight[labels[i]], grads)
            rate = settings.rate * (1 - (step - 1) / total)
            for w, g, m, v in zip(net.weights(), grads, first, second):
                g /= len(batch)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def sample(
    docs: DataFrame, labels: DataFrame, settings: Settings
) -> tuple[list[str], list[int], dict[int, float]]:
    """At most ``sample_per_label`` documents of each label by a hash of the id; the labels' true shares."""
    usable = labels.where(~held_out()).select("doc_id", "quality")
    order = hash_order("doc_id", seed=settings.seed)
    counts = usable.where(F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    chosen = None
    for value in (0, 1):
        part = usable.where(F.col("quality") == value).distinct()
        part = part.orderBy(order, "doc_id").limit(settings.sample_per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most two times the sample size of (doc_id, quality) rows are broadcast.
    rows = (
        docs.select("doc_id", "text")
        .where(F.octet_length(F.coalesce("text", F.lit(""))) <= settings.sample_text_bytes)
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    return [r["text"] for r in rows], [r["quality"] for r in rows], {r["quality"]: r["n"] / total for r in counts}


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    schema = "doc_id bigint, held_out boolean, score double, predicted int"
    threshold = net.settings.threshold if net else Settings().threshold

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [net.score(t.as_py()) if net else 0.5 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), apply, schema)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network | None:
    texts, marks, shares = sample(docs, labels, settings)
    return fit(texts, marks, settings, shares)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return score(docs, train(docs, labels, settings))


def keep_accepted(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows whose score reaches the threshold, columns unchanged; all rows if nothing could be learned."""
    if net is None:
        return docs
    threshold, place = net.settings.threshold, docs.columns.index("text")

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([net.score(t.as_py()) >= threshold for t in batch.column(place)], pa.bool_()))

    return map_batches(docs, accepted, docs.schema)


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
