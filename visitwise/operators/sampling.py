"""Stratified samples of whole persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitwise.operators.histories import Histories, Keys

HASH_SPACE = 16**8


def check_fraction(fraction: float) -> float:
    if not 0 <= fraction <= 1:
        raise ValueError(f"sample fraction must be between 0 and 1, got {fraction}")
    return fraction


def chosen(person: Column, fraction: float, seed: int) -> Column:
    """Bernoulli choice by hash: the same person is chosen in every run and every partitioning."""
    if fraction == 1:
        return F.lit(True)
    limit = f"{int(fraction * HASH_SPACE):08x}"
    digest = F.md5(F.concat_ws("|", person.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.substring(digest, 1, 8) < limit


def strata(df: DataFrame, keys: Keys = Keys(), since_year: int = 2000) -> DataFrame:
    """Persons with a visit since the year, their visits in that time, repeat or one-time."""
    return (
        df.where(F.year(keys.day) >= since_year)
        .groupBy(keys.person)
        .agg(F.count(F.lit(1)).alias("visits_since"))
        .withColumn("stratum", F.when(F.col("visits_since") > 1, "repeat").otherwise("onetime"))
    )


def sampled_ids(
    df: DataFrame, fraction: float, seed: int, keys: Keys = Keys(), since_year: int = 2000
) -> DataFrame:
    """Chosen persons of both strata, each with its stratum.

    The choice depends on the person only, so it is applied before the counting
    shuffle; counts of the chosen persons are unaffected.
    """
    check_fraction(fraction)
    return strata(df.where(chosen(F.col(keys.person), fraction, seed)), keys, since_year)


def sample_persons(
    df: DataFrame,
    fraction: float,
    seed: int,
    keys: Keys = Keys(),
    since_year: int = 2000,
    per_slice: int | None = None,
) -> DataFrame:
    """All rows of the sampled persons; a fraction of 1 returns the table as it is."""
    if check_fraction(fraction) == 1:
        return df
    # Rows of persons that cannot be chosen are gone before the join's exchange.
    candidates = df.where(chosen(F.col(keys.person), fraction, seed))
    ids = sampled_ids(df, fraction, seed, keys, since_year).select(keys.person)
    return Histories.of(candidates, keys, per_slice).attach(ids, "left_semi").frame()
