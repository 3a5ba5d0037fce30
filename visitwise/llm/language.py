"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword. One linear classifier per code bit reads hashed n-gram
frequencies of the whole text; decoding picks the codeword with the least weighted loss,
where each bit weighs as much as its accuracy on texts kept out of its fit.

The classifiers are fitted on a sample with the documented bounds of ``Settings``; scoring
is one narrow Arrow pass over all documents.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every
text when there is nothing to learn from. With one learned language every text gets it, with
score 1. Repeated rows are scored once each; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitwise.llm.common import hash_order, held_out, table
from visitwise.llm.registry import query

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 8192
    grams: tuple[int, ...] = (2, 3, 4)
    # Bounds of the sample that the classifiers are fitted on.
    sample_per_language: int = 350
    sample_text_bytes: int = 65_536
    ridge: float = 0.02
    # Margins are scaled to the logistic loss by this factor.
    sharpness: float = 4.0
    ambiguous_below: float = 0.2
    seed: int = 17


def features(text: str, settings: Settings) -> np.ndarray:
    """Square roots of hashed n-gram frequencies, and a constant."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    shift = np.uint32(32 - int(settings.buckets).bit_length() + 1)
    hashed = []
    for n in settings.grams:
        count = len(raw) - n + 1
        if count < 1:
            continue
        code = np.full(count, n, dtype=np.uint32)
        for j in range(n):
            code = code * np.uint32(0x01000193) ^ raw[j : j + count]
        hashed.append((code * np.uint32(0x9E3779B1)) >> shift)
    counts = np.bincount(np.concatenate(hashed), minlength=settings.buckets).astype(np.float32)
    out = np.empty(settings.buckets + 1, dtype=np.float32)
    np.sqrt(counts / counts.sum(), out=out[:-1])
    out[-1] = 1.0
    return out


def codewords(classes: int, seed: int) -> np.ndarray:
    """A row of -1 and 1 per class: all splits up to 7 classes, well separated random ones beyond."""
    if classes <= 7:
        bits = 2 ** (classes - 1) - 1
        table_ = [[(number >> bit) & 1 for number in range(1, bits + 1)] for bit in range(classes)]
        return np.array(table_, dtype=np.float64).reshape(classes, bits) * 2 - 1
    bits = int(np.ceil(10 * np.log2(classes)))
    best, best_distance = None, -1
    for attempt in range(50):
        code = np.random.default_rng(seed + attempt).choice([-1.0, 1.0], (classes, bits))
        agree = code @ code.T
        np.fill_diagonal(agree, -bits)
        distance = int((bits - agree.max()) / 2)
        if distance > best_distance and (np.abs(code.sum(axis=0)) < classes).all():
            best, best_distance = code, distance
    return best


@dataclass(frozen=True)
class Codes:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    trust: np.ndarray  # bits
    settings: Settings

    def decode(self, text: str) -> tuple[str, float, bool]:
        """(language, score, ambiguous)"""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = features(text, self.settings).astype(np.float64) @ self.weights * self.settings.sharpness
        losses = np.logaddexp(0.0, -self.code * margins) @ self.trust
        order = np.argsort(losses, kind="stable")
        odds = np.exp(losses.min() - losses)
        odds /= odds.sum()
        best = int(order[0])
        # Ambiguous: the runner-up is close, or more bits are wrong than the code can correct.
        wrong = int((np.sign(margins) != self.code[best]).sum())
        apart = min(int((self.code[best] != row).sum()) for i, row in enumerate(self.code) if i != best)
        unclear = odds[best] - odds[order[1]] < self.settings.ambiguous_below or 2 * wrong >= apart
        return self.languages[best], float(odds[best]), bool(unclear)


def _ridge(x: np.ndarray, y: np.ndarray, strength: float) -> np.ndarray:
    gram = x @ x.T
    gram[np.diag_indices_from(gram)] += strength
    return x.T @ np.linalg.solve(gram, y)


def fit(texts: list[str], labels: list[str], settings: Settings = Settings()) -> Codes | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    code = codewords(len(languages), settings.seed)
    if len(languages) == 1:
        return Codes(languages, code, np.zeros((0, 0)), np.zeros(0), settings)
    x = np.stack([features(t, settings) for t in texts]).astype(np.float64)
    place = {name: i for i, name in enumerate(languages)}
    y = code[[place[name] for name in labels]]
    # Each bit's trust comes from the fifth of the sample that its trial fit has not seen.
    unseen = np.arange(len(texts)) % 5 == 4
    trust = np.ones(code.shape[1])
    if unseen.any():
        trial = _ridge(x[~unseen], y[~unseen], settings.ridge)
        right = (np.sign(x[unseen] @ trial) == y[unseen]).sum(axis=0)
        accuracy = (right + 1.0) / (unseen.sum() + 2.0)
        trust = np.clip(np.log(accuracy / (1 - accuracy)), 0.05, None)
        trust *= len(trust) / trust.sum()
    return Codes(languages, code, _ridge(x, y, settings.ridge), trust, settings)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, settings: Settings) -> tuple[list[str], list[str]]:
    """Texts and labels to learn from: at most ``sample_per_language`` of each language, by hash."""
    usable = docs.where(
        ~held_out()
        & F.col("lang").isNotNull()
        & has_letter(F.col("text"))
        & (F.octet_length("text") <= settings.sample_text_bytes)
    )
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    # A hash thins each language to about three times the need, so that ranking it stays small.
    order = hash_order("doc_id", "text", seed=settings.seed)
    steps = 1 << 20
    most = {lang: int(min(1.0, 3.0 * settings.sample_per_language / n) * steps) + 1 for lang, n in counts.items()}
    limits = F.create_map(*[F.lit(x) for pair in sorted(most.items()) for x in pair])
    thin = usable.select("lang", "text", order.alias("o")).where(F.pmod("o", F.lit(steps)) < limits[F.col("lang")])
    ranked = thin.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "text")))
    rows = ranked.where(F.col("r") <= settings.sample_per_language).select("lang", "r", "text").collect()
    rows.sort(key=lambda row: (row["lang"], row["r"]))
    texts, labels = [row["text"] for row in rows], [row["lang"] for row in rows]
    mixed = np.random.default_rng(settings.seed).permutation(len(texts))
    return [texts[i] for i in mixed], [labels[i] for i in mixed]


def identify(docs: DataFrame, model: Codes | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: one row per document."""
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, letter in zip(batch.column(2), batch.column(3)):
                if model is None or not letter.as_py():
                    found.append((UNKNOWN, 0.0, True))
                else:
                    found.append(model.decode(text.as_py()))
            columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *columns],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    text = F.col("text")
    ready = docs.select("doc_id", held_out().alias("held_out"), "text", has_letter(text).alias("letter"))
    return ready.mapInArrow(decode, schema)


def language_codes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    texts, labels = sample(docs, settings)
    return identify(docs, fit(texts, labels, settings))


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_codes(table(spark, sf_dir, "documents"))
