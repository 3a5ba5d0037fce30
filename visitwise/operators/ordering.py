"""Row numbers of a whole table in a global order, without a window over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitwise.operators.names import fresh
from visitwise.sources.workspace import stage


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Add 1, 2, ... in the order of ``order``, which must tell all rows apart for repeatable numbers.

    Spark's own sort ranges the rows over tasks and each task writes its rows in order to one file, so a row's
    number is its place in its file plus the rows of the files before it. Besides the sort only one row per
    task is handled, so no task ever sees more than its range, whatever the keys are.
    """
    part, place, origin, start = fresh([*df.columns, name], "_part", "_place", "_from", "_start")
    laid = stage(df.orderBy(*order).withColumn(part, F.spark_partition_id()), "ordered", one_file_a_task=True)
    rows = laid.withColumn(place, F.col("_metadata.row_index"))
    earlier = Window.partitionBy().orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy(part).agg(F.count(F.lit(1)).alias(place))
    starts = sizes.select(F.col(part).alias(origin), F.coalesce(F.sum(place).over(earlier), F.lit(0)).alias(start))
    # Two numbers per task of the sort.
    whole = rows.join(F.broadcast(starts), F.col(part) == F.col(origin))
    return whole.withColumn(name, F.col(start) + F.col(place) + 1).select(*df.columns, name)
