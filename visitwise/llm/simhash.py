"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common variant at half the radius from each.
Every distinct fingerprint emits all its variants within half the radius, in two steps: the
leading bits of the variants are the shuffle key, and the task that holds a key completes
the remaining bits in numpy. So a fingerprint crosses the network once per leading part
(37 times with 8 leading bits) where whole variants would cross it 2,081 times. A run of
equal variants is linked as a chain: its members are all within the radius of one another,
so nothing is lost and no group is expanded into all pairs. Links are deduplicated, their bit
distance verified, and components give the classes.

Equal fingerprints are one node, however many documents share it, so copies cost nothing.

Defined results: a text without words (null, empty) has fingerprint zero, which links like
any other; repeated rows share fingerprint and class; a class without any doc_id has a null
component_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitwise.llm.common import map_batches, table
from visitwise.llm.components import components
from visitwise.llm.registry import query
from visitwise.operators.names import fresh
from visitwise.sources.workspace import stage

SHINGLE = 4
RADIUS = 4
SEED = 42
# Variants completed at a time in one task.
TASK_VARIANTS = 1 << 21
MAX_LEADING = 24


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash over word shingles, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    size = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    set_bits = np.zeros(64, dtype=np.int64)
    block = 1 << 15
    for begin in range(0, len(starts), block):
        part = zip(starts[begin : begin + block], stops[begin : begin + block])
        hashes = np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in part]), dtype=np.uint8)
        set_bits += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_bits > len(starts))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, marks: Sequence[Column] = ()) -> DataFrame:
    """doc_id, print (the 64 bits as a signed long), and mark_0, mark_1, ...: longs that tell rows apart."""
    names = [f"mark_{i}" for i in range(len(marks))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], dtype=np.uint64)
            columns = [batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", *names])

    marked = docs.select("doc_id", "text", *[mark.alias(name) for mark, name in zip(marks, names)])
    return map_batches(marked, apply, ", ".join(f"{name} bigint" for name in ["doc_id", "print", *names]))


def with_class(prints: DataFrame, radius: int) -> DataFrame:
    """Fingerprints with ``class``: the smallest fingerprint of their component, as a signed long."""
    linked = stage(links(prints, radius), "simhash-links")
    roots = components(linked, "a", "b").select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    placed = prints.join(roots, F.col("print") == F.col("_node"), "left")
    return placed.select(*prints.columns, F.coalesce("_root", "print").alias("class"))


def masks(bits: int, most: int) -> list[int]:
    """All numbers of ``bits`` bits with at most ``most`` ones."""
    return [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(range(bits), k)]


def leading_bits(prints: int, half: int) -> int:
    """So many that the variants under one leading part fit a task."""
    ball = sum(math.comb(64, k) for k in range(half + 1))
    return min(MAX_LEADING, max(0, math.ceil(math.log2(max(1, prints * ball / TASK_VARIANTS)))))


def collisions(prefix: int, leading: int, prints: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of prints with a common variant that begins with ``prefix``."""
    low = 64 - leading
    none = np.zeros(0, dtype=np.uint64)
    if len(prints) < 2:
        return none, none
    spent = np.zeros(len(prints), dtype=np.int64)
    if leading:
        spent = np.bitwise_count((prints >> np.uint64(low)) ^ np.uint64(prefix)).astype(np.int64)
    work = sum(int((spent == k).sum()) * sum(math.comb(low, j) for j in range(half - k + 1)) for k in range(half + 1))
    if work > 4 * TASK_VARIANTS and low > 2:
        found = []
        for more in range(4):
            inner = (prefix << 2) | more
            near = np.bitwise_count((prints >> np.uint64(low - 2)) ^ np.uint64(inner)) <= half
            found.append(collisions(inner, leading + 2, prints[near], half))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
    keep = np.uint64((1 << low) - 1)
    head = np.uint64(prefix << low if leading else 0)
    variants, owners = [], []
    for k in range(half + 1):
        members = np.flatnonzero(spent == k)
        flips = np.array(masks(low, half - k), dtype=np.uint64)
        if len(members):
            variants.append((((prints[members] & keep) | head)[:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(members, len(flips)))
    if not variants:
        return none, none
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant, kind="stable")
    variant, owner = variant[order], owner[order]
    same = variant[1:] == variant[:-1]
    pairs = np.unique(np.stack([owner[:-1][same], owner[1:][same]], axis=1), axis=0)
    return prints[pairs[:, 0]], prints[pairs[:, 1]]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b, bits: verified links between the distinct values of column ``print``."""
    half = (radius + 1) // 2
    distinct = stage(prints.select("print").distinct(), "prints")
    leading = leading_bits(distinct.count(), half)
    low = 64 - leading
    flips = F.array(*[F.lit(m) for m in masks(leading, half)])
    own = F.shiftrightunsigned("print", low) if leading else F.lit(0).cast("long")
    dealt = distinct.select("print", F.explode(F.transform(flips, lambda m: own.bitwiseXOR(m.cast("long")))).alias("lead"))

    def collide(key: tuple, group: pa.Table) -> pa.Table:
        held = np.sort(group.column("print").to_numpy().view(np.uint64))
        first, second = collisions(int(key[0].as_py()), leading, held, half)
        bits = np.bitwise_count(first ^ second)
        near = bits <= radius
        return pa.table(
            {
                "a": pa.array(np.minimum(first.view(np.int64), second.view(np.int64))[near]),
                "b": pa.array(np.maximum(first.view(np.int64), second.view(np.int64))[near]),
                "bits": pa.array(bits[near].astype(np.int32)),
            }
        )

    return dealt.groupBy("lead").applyInArrow(collide, "a bigint, b bigint, bits int").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint, component_id, n_links (links of the fingerprint in the chains that connect its class)."""
    prints = stage(fingerprints(docs, shingle, seed), "simhash")
    linked = stage(links(prints, radius), "simhash-links")
    roots = components(linked, "a", "b").select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    degree = (
        linked.select(F.col("a").alias("_end"))
        .union(linked.select("b"))
        .groupBy("_end")
        .agg(F.count(F.lit(1)).alias("n_links"))
    )
    nodes = roots.join(degree, F.col("_node") == F.col("_end"), "left").drop("_end")
    placed = prints.join(nodes, F.col("print") == F.col("_node"), "left").select(
        "doc_id",
        "print",
        F.coalesce("_root", "print").alias("_class"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    placed = stage(placed, "simhash-classes")
    smallest = placed.groupBy(F.col("_class").alias("_c")).agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, F.col("_class") == F.col("_c")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )


def drop_near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED
) -> DataFrame:
    """One row of each class, columns unchanged: the one with the smallest id (no id comes last).

    Rows of one id with different texts are different documents. Among rows of one id and class a hash of the
    text, then one of the whole row decides; of rows equal in every column one stays.
    """
    text_mark, row_mark, text_own, row_own = fresh(docs.columns, "_text_mark", "_row_mark", "_text_own", "_row_own")
    marks = [F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(*docs.columns)]
    prints = stage(fingerprints(docs, shingle, seed, marks), "simhash")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark_0", "mark_1")).alias("best")
    stay = with_class(prints, radius).groupBy("class").agg(best)
    stay = stage(stay.select(F.col("best.mark_0").alias(text_own), F.col("best.mark_1").alias(row_own)), "simhash-stay")
    marked = docs.withColumns({text_mark: marks[0], row_mark: marks[1]})
    same = (F.col(text_mark) == F.col(text_own)) & (F.col(row_mark) == F.col(row_own))
    # The join's exchange by both marks serves the second step too.
    return marked.join(stay, same, "left_semi").dropDuplicates([text_mark, row_mark]).select(*docs.columns)


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
