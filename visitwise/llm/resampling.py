"""Importance resampling towards a target: hashed feature gains and the Gumbel top of the documents.

Features are runs of one to ``ngram`` words. A feature's bucket is the CRC-32 of its bytes modulo the
number of buckets. From the feature counts per bucket of the raw documents and of the target texts
comes a gain per bucket; a document's weight is the sum of its features' gains, and the documents with
the highest weight plus Gumbel noise are drawn, which samples by importance without replacement.

Two narrow Arrow passes read the texts, one for the counts and one for the weights. In both, a block's
feature bytes are made distinct and grouped by equal length, each group is a two-dimensional array of
bytes, and all CRCs of a group advance together, one column at a time; the buckets are then scattered
back to the features in text order. Features above ``CHUNK`` bytes are rows of chunks of equal length:
the chunks advance together like any group, and a row's chunks are joined by the linear step that moves
a CRC over ``CHUNK`` bytes, so no feature is hashed in another way.

A task hands on one count per bucket however many rows it reads, so the counting exchange is bounded
by tasks times buckets and no feature or source can be hot. The gains (one integer per bucket) go to the tasks
with the function. The drawn documents are ranked by a distributed sort of (score, id).

Defined results: a null or empty text, or one without words, has no features and weight 0; repeated
rows count and are drawn like any others; a null id draws its noise from the word ``null`` and comes
after other ids where scores tie; no documents give no rows, and no target texts give T = 0. Extra
columns are ignored and may have any name. Memory grows with the longest text of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitwise.llm.common import table
from visitwise.llm.registry import query
from visitwise.operators.ordering import numbered
from visitwise.sources.workspace import stage


@dataclass(frozen=True)
class Settings:
    ngram: int = 1
    buckets: int = 10_000
    scale: int = 1000
    min_words: int = 20
    percent: int = 10
    seed: str = "2024"


BLOCK_BYTES = 1 << 21
CHUNK = 256
POLYNOMIAL = np.uint32(0xEDB88320)
ALL_ONES = np.uint32(0xFFFFFFFF)


def _byte_steps() -> np.ndarray:
    """What one byte does to an otherwise empty CRC register: eight shifts by one bit."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ POLYNOMIAL, steps >> 1)
    return steps


STEPS = _byte_steps()


def advance(registers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All registers moved over the bytes of their rows, column by column."""
    for column in np.ascontiguousarray(rows.T):
        registers = STEPS[(registers ^ column) & 0xFF] ^ (registers >> 8)
    return registers


def _chunk_shift() -> np.ndarray:
    """Images of each register byte's values under CHUNK zero bytes, by byte: a register's image is their xor."""
    values = np.arange(256, dtype=np.uint32)
    zeros = np.zeros((1, CHUNK), dtype=np.uint8)
    return np.stack([advance(values << np.uint32(8 * k), zeros) for k in range(4)])


SHIFT = _chunk_shift()


def crc32_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional array of bytes."""
    count, length = rows.shape
    head = length % CHUNK if length > CHUNK else length
    registers = advance(np.full(count, ALL_ONES, dtype=np.uint32), rows[:, :head])
    if head < length:
        chunks = rows[:, head:].reshape(-1, CHUNK)
        alone = advance(np.zeros(len(chunks), dtype=np.uint32), chunks).reshape(count, -1)
        for part in alone.T:
            moved = SHIFT[0][registers & 0xFF]
            for k in range(1, 4):
                moved = moved ^ SHIFT[k][(registers >> np.uint32(8 * k)) & 0xFF]
            registers = moved ^ part
    return registers ^ ALL_ONES


def _class_of_bytes() -> np.ndarray:
    """Each byte as words see it: A-Z in lower case, digits, a-z and all non-ASCII as they are, else a space."""
    kinds = np.arange(256, dtype=np.uint8)
    kinds[ord("A") : ord("Z") + 1] += ord("a") - ord("A")
    solid = (kinds >= 0x80) | ((kinds >= ord("0")) & (kinds <= ord("9"))) | ((kinds >= ord("a")) & (kinds <= ord("z")))
    return np.where(solid, kinds, np.uint8(ord(" ")))


KINDS = _class_of_bytes()
SPACE = ord(" ")


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The given runs of ``data`` as an array of binary values."""
    ends = np.cumsum(lengths)
    places = np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    offsets[1:] = ends
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[places])]
    )


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of ``data``: distinct runs are grouped by length and hashed as matrices."""
    out = np.zeros(len(starts), dtype=np.uint32)
    before = np.cumsum(lengths) - lengths
    for block in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(before // BLOCK_BYTES)) + 1):
        if not len(block):
            continue
        coded = gathered(data, starts[block], lengths[block]).dictionary_encode()
        distinct = coded.dictionary
        at = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[: len(distinct) + 1]
        held = np.frombuffer(distinct.buffers()[2], dtype=np.uint8)
        sizes = np.diff(at)
        hashed = np.zeros(len(distinct), dtype=np.uint32)
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            matrix = held[at[group][:, None] + np.arange(sizes[group[0]])]
            hashed[group] = crc32_rows(matrix)
        out[block] = hashed[coded.indices.to_numpy()]
    return out


def word_runs(low: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of the texts that end at ``ends``; no word crosses from text to text."""
    solid = low != SPACE
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = ends[(ends > 0) & (ends < len(low))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def features(raw: np.ndarray, ends: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and the text number and bucket of every feature, for texts laid end to end in ``raw``."""
    low = KINDS[raw]
    starts, stops = word_runs(low, ends)
    owner = np.searchsorted(ends, starts, side="right")
    n_words = np.bincount(owner, minlength=len(ends))
    if settings.ngram > 1:
        # Words of one text with a single space between them; what lies behind a word is its space.
        wanted = low != SPACE
        behind = stops[stops < len(low)]
        wanted[behind] = True
        place = np.cumsum(wanted)
        starts, stops, low = place[starts] - 1, place[stops - 1], low[wanted]
    owners, buckets = [], []
    for n in range(1, settings.ngram + 1):
        if len(starts) < n:
            break
        whole = owner[: len(owner) - n + 1] == owner[n - 1 :]
        begin = starts[: len(starts) - n + 1][whole]
        owners.append(owner[: len(owner) - n + 1][whole])
        buckets.append(crcs(low, begin, stops[n - 1 :][whole] - begin) % np.uint32(settings.buckets))
    if not owners:
        none = np.zeros(0, dtype=np.int64)
        return n_words, none, none
    return n_words, np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends) of runs of texts of some ``BLOCK_BYTES``; a null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right"))
        stop = min(max(stop - 1, row + 1), len(texts))
        yield row, data[offsets[row] : offsets[stop]], offsets[row + 1 : stop + 1] - offsets[row]
        row = stop


def bucket_counts(texts: DataFrame, settings: Settings, text: str = "text") -> DataFrame:
    """(bucket, n): features of all texts per bucket; each task adds up its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, dtype=np.int64)
        for batch in batches:
            for _, raw, ends in text_blocks(batch.column(0)):
                total += np.bincount(features(raw, ends, settings)[2], minlength=settings.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = texts.select(text).mapInArrow(count, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, gain) for every bucket, from two tables of (bucket, n)."""
    spark = raw.sparkSession
    sides = spark.range(settings.buckets).withColumnRenamed("id", "bucket")
    for name, counts in (("s", raw), ("t", target)):
        sides = sides.join(counts.withColumnRenamed("n", name), "bucket", "left")
    sides = sides.fillna(0, ["s", "t"])
    sums = sides.agg(F.struct(F.sum("s").alias("s"), F.sum("t").alias("t")).alias("all"))
    sides = sides.withColumn("_all", sums.scalar())
    number = {name: F.col(c).cast("double") for name, c in (("s", "s"), ("t", "t"), ("all_s", "_all.s"), ("all_t", "_all.t"))}
    ratio = ((number["t"] + 1) * (number["all_s"] + settings.buckets)) / (
        (number["s"] + 1) * (number["all_t"] + settings.buckets)
    )
    return sides.select("bucket", F.floor(settings.scale * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gains: np.ndarray, settings: Settings) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), dtype=np.int64)
            for row, raw, ends in text_blocks(batch.column(1)):
                n_words, owner, buckets = features(raw, ends, settings)
                here = slice(row, row + len(ends))
                sums[0, here] = n_words
                sums[1, here] = np.bincount(owner, minlength=len(ends))
                np.add.at(sums[2, here], owner, gains[buckets])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], schema.replace(" bigint", "").split(", "))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(add_up, schema)


def noise(doc_id: str, settings: Settings) -> Column:
    """Gumbel noise in units of the gains, from a digest of the id."""
    key = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    digits = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-settings.scale * F.log(-F.log((digits + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row per document, rank null where it is not drawn."""
    counts = [bucket_counts(t, settings) for t in (docs, target)]
    # As many rows as there are buckets.
    gains = np.zeros(settings.buckets, dtype=np.int64)
    for row in bucket_gains(*counts, settings).collect():
        gains[row["bucket"]] = row["gain"]
    score = F.col("weight") + noise("doc_id", settings)
    scored = stage(weigh(docs, gains, settings).withColumn("score", score), "scored")
    enough = F.col("n_words") >= settings.min_words
    eligible = scored.where(enough)
    drawn = F.lit(eligible.count() * settings.percent // 100)
    ranked = numbered(eligible, F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS by_byte),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
docs AS (SELECT doc_id, coalesce(words, []) AS words FROM doc_words),
raw_words AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM docs) GROUP BY word),
target_words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(
    translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark) GROUP BY word),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM raw_words UNION SELECT word FROM target_words)),
hashed AS (SELECT word, xor(list_reduce(
    list_transform(range(CAST(len(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(by_byte[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM hexed, steps),
counted AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM (
  SELECT bucket, n AS s, 0 AS t FROM raw_words JOIN hashed USING (word)
  UNION ALL SELECT bucket, 0, n FROM target_words JOIN hashed USING (word)) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))
  AS BIGINT) AS gain FROM counted),
weights AS (SELECT d.doc_id, CAST(sum(gain) AS BIGINT) AS weight
  FROM (SELECT doc_id, unnest(words) AS word FROM docs) d JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY d.doc_id),
scored AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST(CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE)))
    AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query("op12_resampling", ORACLE)
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
