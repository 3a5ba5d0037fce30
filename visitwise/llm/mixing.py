"""Mixing sources to target weights.

Word totals per source give a target per source, the target divided by the source's size is
its repetition rate, and each document is emitted floor(rate) times plus once more when a
hash of its id falls below the rate's fraction.

Targets: sources in code point order (null last) weigh 5, 2, 1 in turn and share ``budget``
times all words. No target exceeds ``cap`` times its source's words; what is cut off is
shared again by weight until no target is above. That end state is one water level L with
target = least(cap * size, L * weight), found by one ordered sum over the sources.

Only one row per source leaves the aggregate, so a source with a third of all rows costs no
more than the others. Defined results: a null text has size 0; a source of size 0 has target
0 and takes nothing; a null source is a source of its own; a null id is hashed as a text of
its own; repeated rows decide alike; extra columns stay with the emitted documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitwise.llm.common import table, word_count
from visitwise.llm.registry import query
from visitwise.operators.names import fresh
from visitwise.sources.workspace import stage

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
SEED = "mix"
# The first 13 hexadecimal digits of a digest are an integer that a double holds exactly.
DIGITS = 13


def coin(doc_id: str, seed: str) -> Column:
    """A number in [0, 1) from a digest of the id."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    digits = F.substring(F.md5(key.cast("binary")), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**DIGITS))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, cap: int = CAP
) -> DataFrame:
    """_source, source_size, target: one row per source of a table (source, size)."""
    totals = sizes.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = everything.orderBy(F.col("_source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighed = totals.withColumn("_weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn))
    # Sources reach their cap in the order of size over weight. With the first ones capped, the rest share
    # what is left by weight. The level rises from source to source until one stays below its own cap and
    # falls after that, so the level sought is the largest of those that stay below.
    fill = everything.orderBy(F.col("source_size") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.lit(budget) * F.sum("source_size").over(everything) - F.lit(cap) * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    )
    leveled = weighed.withColumn("_level", left / F.sum("_weight").over(after))
    full = F.col("_level") * F.col("_weight") >= F.lit(cap) * F.col("source_size")
    level = F.max(F.when(~full, F.col("_level"))).over(everything)
    share = F.coalesce(level * F.col("_weight"), F.lit(float("inf")))
    target = F.least((F.lit(cap) * F.col("source_size")).cast("double"), share)
    return leveled.select("_source", "source_size", target.alias("target"))


def mixing_plan(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, seed: str = SEED
) -> DataFrame:
    """doc_id, size, source_size, target, copies: how often each document is emitted."""
    sizes = stage(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    targets = stage(source_targets(sizes, weights, budget, cap), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor("_rate") + (coin("doc_id", seed) < F.col("_rate") - F.floor("_rate")).cast("long")
    return (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_rate", rate)
        .select("doc_id", "size", "source_size", "target", copies.alias("copies"))
    )


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, seed: str = SEED
) -> DataFrame:
    """The emitted documents: the rows of ``docs``, each as often as its plan says, all columns kept."""
    sizes = docs.select("source", word_count().alias("size"))
    targets = stage(source_targets(sizes, weights, budget, cap), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    origin, share, copy = fresh(docs.columns, "_mix_source", "_mix_rate", "_mix_copy")
    rates = targets.select(F.col("_source").alias(origin), rate.alias(share))
    extra = coin("doc_id", seed) < F.col(share) - F.floor(share)
    copies = F.floor(share) + extra.cast("long")
    return (
        docs.join(rates, F.col("source").eqNullSafe(F.col(origin)))
        .where(copies > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
        .select(*docs.columns)
    )


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0
    ELSE len(regexp_extract_all(text, '[^ \\t-\\r]+')) END AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM totals),
leveled AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - 2 * CAST(coalesce(sum(source_size) OVER (
      ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY source_size / weight, encode(source) NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE),
    coalesce(max(CASE WHEN level * weight < 2 * source_size THEN level END) OVER () * weight, 'inf'::DOUBLE)) AS target
  FROM leveled),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), 'null') || ':{SEED}'), 1, {DIGITS}) AS BIGINT)
      / {16**DIGITS}.0::DOUBLE AS coin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""


@query("op6_mixing", ORACLE)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
