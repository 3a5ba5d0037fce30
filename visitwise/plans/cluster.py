"""Clusters of first visits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitwise.operators import clustering as C
from visitwise.sources.extracts import read_parquet, write_csv

# The features of a first visit.
FEATURES = [
    "donation_year",
    "donation_season",
    "age_bucket",
    "walk_in_ind",
    "donation_type",
    "deferral_ind",
    "sponsor_category",
    "race",
    "gender",
    "StateAbbr",
    "repeat_donor",
]


def first_visit_cohort(enriched: DataFrame, features: list[str] | None = None, since_year: int = 2000) -> DataFrame:
    """First visits since the year of persons with a known age."""
    return enriched.where(
        (F.col("donation_year") >= since_year)
        & (F.col("first_donat_ind") == 1)
        & (F.col("donation_order") == 1)
        & (F.col("age_bucket") != "Unknown")
    ).select(*(features or FEATURES))


@dataclass(frozen=True)
class Clusters:
    fit: C.Fit
    centers: DataFrame
    wssse: DataFrame
    names: list[str]
    encoder: C.Encoder

    def assign(self, visits: DataFrame) -> DataFrame:
        """The visits with the ``cluster`` of their features and the squared ``distance`` to its center."""
        return C.assign(visits, self.encoder, self.fit)


def cluster(
    cohort: DataFrame,
    k: int,
    iterations: int,
    seed: int = C.DEFAULT_SEED,
    features: list[str] | None = None,
    handle_invalid: str = "error",
    tolerance: float = 1e-4,
) -> Clusters:
    """Fit and report; ``handle_invalid`` says what a missing number does: error, skip or keep."""
    encoder, vectors = C.encode(cohort, features or FEATURES, handle_invalid)
    found = C.fit(vectors, k, iterations, seed, tolerance=tolerance)
    return Clusters(found, C.centers(vectors, found, encoder.names), C.wssse(vectors, found), encoder.names, encoder)


def cluster_job(
    spark: SparkSession,
    path: str,
    k: int,
    iterations: int,
    seed: int = C.DEFAULT_SEED,
    glob: str = "part*.parquet",
    features: list[str] | None = None,
    handle_invalid: str = "error",
    since_year: int = 2000,
    tolerance: float = 1e-4,
) -> Clusters:
    """Fit over the enriched table written by the preprocess job."""
    cohort = first_visit_cohort(read_parquet(spark, path, glob), features, since_year)
    return cluster(cohort, k, iterations, seed, features, handle_invalid, tolerance)


def sweep_job(
    spark: SparkSession,
    path: str,
    output: str,
    ks: range = range(15, 31),
    iterations: int = 10,
    seed: int = C.DEFAULT_SEED,
    glob: str = "part*.parquet",
    features: list[str] | None = None,
    since_year: int = 2000,
) -> DataFrame:
    """Fit each number of clusters and write the K, WSSSE, Centers table as CSV; the result has n_centers too."""
    cohort = first_visit_cohort(read_parquet(spark, path, glob), features, since_year)
    _, vectors = C.encode(cohort, features or FEATURES)
    result = C.sweep(vectors, ks, iterations, seed)
    write_csv(result.drop("n_centers").withColumnsRenamed({"k": "K", "wssse": "WSSSE", "centers": "Centers"}), output)
    return result
