"""Table profiles: shape, missing values, distinct values, histograms, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def missing_values(df: DataFrame) -> DataFrame:
    """(column, count, percentage) of nulls and NaNs: one pass, one partial row per task."""
    kinds = dict(df.dtypes)
    rows = F.count(F.lit(1))

    def absent(name: str):
        c = F.col(f"`{name}`")
        return c.isNull() | F.isnan(c) if kinds[name] in ("float", "double") else c.isNull()

    wide = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("column"),
                    F.count_if(absent(name)).alias("count"),
                    (F.count_if(absent(name)) / rows).alias("percentage"),
                )
                for name in df.columns
            ]
        ).alias("stats")
    )
    return wide.select(F.inline("stats"))


def missing_report(df: DataFrame) -> DataFrame:
    """The report with the emptiest columns first."""
    return missing_values(df).orderBy(F.desc("percentage"), "column")


def missing_below(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    return missing_values(df).where(F.col("percentage") < threshold)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct combinations, null kept as a value."""
    return df.select(*columns).distinct()


def edge(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Lower edge of bin ``i``."""
    return i * ((hi - lo) / bins) + lo


def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin whose edges hold x: rounding may put one that lies on an edge into the bin beside it."""
    guess = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return (
        F.when(x < edge(guess, lo, hi, bins), guess - 1)
        .when((guess < bins - 1) & (x >= edge(guess + 1, lo, hi, bins)), guess + 1)
        .otherwise(guess)
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from min to max, the last one closed: (bin, lo, hi, n).

    Rows are first counted per distinct value with a map-side combine. The exchange
    of those counts serves both the bounds and the binning, so the input plan runs
    once and a value held by very many rows arrives as one row per task.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).alias("_w")
    )
    # The total keeps the counting step in the plan of the bounds, which makes its exchange reusable.
    bounds = counted.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.sum("_w").alias("total"))
    # As in numpy, a single distinct value is put in the middle of a range of width 1.
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    bounds = bounds.select(
        F.struct((F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"), "total").alias("b")
    )
    filled = (
        counted.withColumn("_b", bounds.scalar())
        .withColumn("bin", bin_of(F.col("_x"), F.col("_b.lo"), F.col("_b.hi"), bins))
        .groupBy("bin")
        .agg(F.sum("_w").alias("n"))
    )
    every = df.sparkSession.range(bins, numPartitions=1).select(F.col("id").cast("int").alias("bin"))
    # At most ``bins`` rows on either side.
    return (
        every.join(F.broadcast(filled), "bin", "left")
        .withColumn("_b", bounds.scalar())
        .where(F.col("_b.total") > 0)
        .select(
            "bin",
            edge(F.col("bin"), F.col("_b.lo"), F.col("_b.hi"), bins).alias("lo"),
            edge(F.col("bin") + 1, F.col("_b.lo"), F.col("_b.hi"), bins).alias("hi"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def histograms(df: DataFrame, series: str, value: str, bins: int) -> DataFrame:
    """A histogram for each series, as ``histogram`` makes it: (series, bin, lo, hi, n).

    The rows are read and counted once for all series; a series held by most rows arrives as one row per
    distinct value and task. Bounds and bins share the exchange of those counts. A null series is one of its own,
    and one without values has no rows.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(
        F.col(series).alias("_series"), F.col(value).cast("double").alias("_x")
    ).agg(F.count(F.lit(1)).alias("_w"))
    # The counts' total keeps this plan equal to the one below, so that one exchange serves both.
    ranges = counted.groupBy("_series").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.sum("_w").alias("_all"))
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    ranges = ranges.select(F.col("_series").alias("_of"), (F.col("lo") - half).alias("_lo"), (F.col("hi") + half).alias("_hi"))
    filled = (
        counted.join(ranges, F.col("_series").eqNullSafe(F.col("_of")))
        .withColumn("_bin", bin_of(F.col("_x"), F.col("_lo"), F.col("_hi"), bins))
        .groupBy("_series", "_bin")
        .agg(F.sum("_w").alias("n"))
    )
    every = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    same = F.col("_of").eqNullSafe(F.col("_series")) & (F.col("bin") == F.col("_bin"))
    return every.join(filled, same, "left").select(
        F.col("_of").alias(series),
        "bin",
        edge(F.col("bin"), F.col("_lo"), F.col("_hi"), bins).alias("lo"),
        edge(F.col("bin") + 1, F.col("_lo"), F.col("_hi"), bins).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def sort_lines(df: DataFrame, line: str = "value", tie: str | None = None) -> DataFrame:
    """Global text order.

    The tie column lets the range exchange cut inside a run of equal lines, so one
    line repeated very often does not end in one task.
    """
    if tie:
        return df.orderBy(line, tie)
    return df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(line, "_tie").drop("_tie")
