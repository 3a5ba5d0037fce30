"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregates and two joins on the edge table, written to the shared folder,
so no component is ever gathered in one task and a lost executor costs one round at most.
The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitwise.sources.workspace import stage


def _lowest(edges: DataFrame, node: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("_n")).agg(F.min("_other").alias("_m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour."""
    both = edges.select(F.col("a").alias("_u"), F.col("b").alias("_other")).union(edges.select("b", "a"))
    low = _lowest(both, "_u").select("_n", F.least("_n", "_m").alias("_m"))
    tied = both.where(F.col("_other") > F.col("_u")).join(low, F.col("_u") == F.col("_n"))
    return tied.select(F.col("_other").alias("a"), F.col("_m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("_u"), F.least("a", "b").alias("_other")).where("_u > _other")
    low = _lowest(down, "_u")
    tied = down.join(low, F.col("_u") == F.col("_n")).select(F.col("_other").alias("a"), F.col("_m").alias("b"))
    return tied.union(low.select("_n", "_m")).where("a <> b").distinct()


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))).alias("s"),
    ).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node it is connected to.

    Self-loops, repeated edges and edges with a null end are allowed and have no effect.
    """
    valid = F.col(a).isNotNull() & F.col(b).isNotNull()
    current = edges.where(valid).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b")
    current = stage(current.distinct(), "edges")
    before = _print_of(current)
    while before[0]:
        current = stage(_small_star(_large_star(current)), "stars")
        now = _print_of(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
