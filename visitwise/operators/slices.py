"""Ordered slices of keys that hold too many rows for one task.

The rows of such keys are numbered in one distributed order, by key and then by the wanted order, and
cut after every ``per_slice`` rows. So a slice of a key never holds more rows than that, however many
the key has, and there is no bound on the number of slices. Windows run per (key, slice) and are
completed from one summary row per slice; joins repeat the other side's entry once per slice.
Nothing here is broadcast by force: the tables of hot keys, slices and summaries are written, so Spark
knows their sizes and broadcasts the small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitwise.operators.names import fresh
from visitwise.operators.ordering import numbered
from visitwise.sources.statistics import remembered
from visitwise.sources.workspace import stage

ROWS_PER_SLICE = 5_000_000

SLICE = "_slice"


def order_key(day: str, tie: str) -> Column:
    """Comparable form of the visit order; missing days come last."""
    return F.struct(F.col(day).isNull().alias("undated"), F.col(day).alias("day"), F.col(tie).alias("tie"))


def hot_keys(df: DataFrame, key: str, per_slice: int) -> DataFrame | None:
    """(_p): the keys with more than ``per_slice`` rows, null among them; None if there are none.

    One pass over the key column with a map-side combine, made once per session and table; only the
    largest count reaches the driver.
    """

    def find() -> DataFrame | None:
        counts = df.groupBy(F.col(key).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        largest = counts.agg(F.max("_n")).first()[0] or 0
        return stage(counts.where(F.col("_n") > per_slice).select("_p"), "hot") if largest > per_slice else None

    return remembered(df, ("hot", key, per_slice), find)


def split(
    df: DataFrame, hot: DataFrame, key: str, *order: Column, per_slice: int, name: str = SLICE
) -> tuple[DataFrame, DataFrame]:
    """The rows of ordinary keys with slice 0, and those of hot keys with 1, 2, ... in the given order."""
    number, own = fresh([*df.columns, name], "_number", "_p")
    hot = hot.withColumnRenamed("_p", own)
    is_hot = F.col(key).eqNullSafe(F.col(own))
    cold = df.join(hot, is_hot, "left_anti").withColumn(name, F.lit(0).cast("long"))
    placed = numbered(df.join(hot, is_hot, "left_semi"), F.col(key), *order, name=number)
    place = F.floor((F.col(number) - 1) / per_slice).cast("long") + 1
    return cold, placed.withColumn(name, place).drop(number)
