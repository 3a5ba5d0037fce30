"""K-means over categorical visit features.

The features take few distinct combinations however many visits there are, so the
cohort is first counted per combination (one pass, map-side combine). Label order,
fits and costs then use the counts as weights; a weighted fit has the same objective
as one over the single rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitwise.operators import kmeans as M
from visitwise.operators.kmeans import Fit
from visitwise.operators.ordering import numbered
from visitwise.sources.workspace import stage

NULL_LABEL = "__null__"
DEFAULT_SEED = 52
WEIGHT = "weight"


def fill_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(NULL_LABEL, subset=columns)


def text_features(df: DataFrame, features: list[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [f for f in features if kinds[f] == "string"]


def combinations(df: DataFrame, features: list[str]) -> DataFrame:
    """Distinct feature rows with their number as weight; missing text is a label of its own."""
    filled = fill_labels(df.select(*features), text_features(df, features))
    return filled.groupBy(*features).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))


def label_counts(weighted: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, label, n) of each text feature."""
    pairs = weighted.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("label")) for c in columns])), WEIGHT
    )
    return pairs.groupBy("feature", "label").agg(F.sum(WEIGHT).alias("n"))


def ranked_labels(counts: DataFrame) -> DataFrame:
    """(feature, label, rank): 0, 1, ... by falling n within each feature, ties by label.

    All labels are numbered in one distributed order and a feature's first number is taken off, so the labels
    of a free-text feature are spread over tasks like any others.
    """
    ordered = numbered(counts, "feature", F.desc("n"), "label", name="rank")
    # One row per feature.
    firsts = ordered.groupBy(F.col("feature").alias("_of")).agg(F.min("rank").alias("_first"))
    ranked = ordered.join(firsts, F.col("feature") == F.col("_of"))
    return ranked.select("feature", "label", (F.col("rank") - F.col("_first")).cast("double").alias("rank"))


@dataclass(frozen=True)
class Encoder:
    """Label ranks by falling frequency (ties by label), kept as a table, and the columns to assemble."""

    features: list[str]
    indexed: list[str]
    ranks: DataFrame | None
    handle_invalid: str = "error"

    @classmethod
    def fit(cls, weighted: DataFrame, features: list[str], handle_invalid: str = "error") -> Encoder:
        indexed = text_features(weighted, features)
        ranks = None
        if indexed:
            ranks = stage(ranked_labels(label_counts(weighted, indexed)), "label-ranks")
        return cls(list(features), indexed, ranks, handle_invalid)

    @property
    def names(self) -> list[str]:
        return [f"{f}_index" if f in self.indexed else f for f in self.features]

    def index(self, df: DataFrame) -> DataFrame:
        """Add each text feature's label rank by a join; Spark broadcasts a rank table only if it is small.

        A label that the ranks do not know is an error, or null where ``handle_invalid`` is not ``error``.
        """
        if not self.indexed:
            return df
        df = fill_labels(df, self.indexed)
        for feature in self.indexed:
            own = self.ranks.where(F.col("feature") == feature).select(
                F.col("label").alias("_label"), F.col("rank").alias(f"{feature}_index")
            )
            df = df.join(own, F.col(feature) == F.col("_label"), "left").drop("_label")
            if self.handle_invalid == "error":
                unknown = F.raise_error(F.concat(F.lit(f"unknown label of {feature}: "), F.col(feature)))
                df = df.withColumn(f"{feature}_index", F.coalesce(f"{feature}_index", unknown.cast("double")))
        return df

    def assemble(self, df: DataFrame) -> DataFrame:
        assembler = VectorAssembler(
            inputCols=self.names, outputCol="features", handleInvalid=self.handle_invalid
        )
        return assembler.transform(self.index(df))


def encode(
    df: DataFrame, features: list[str], handle_invalid: str = "error", partitions: int | None = None
) -> tuple[Encoder, DataFrame]:
    """Encoder and the weighted feature vectors: (features array<double>, weight).

    The combinations and their vectors are written to the shared folder once, so the fits iterate over
    a small table and a lost executor never sets the visit pipeline going again. They are dealt over
    ``partitions`` tasks (all cores, if not given) by a hash of the features.
    """
    weighted = stage(combinations(df, features), "combinations")
    encoder = Encoder.fit(weighted, features, handle_invalid)
    partitions = partitions or df.sparkSession.sparkContext.defaultParallelism
    laid = features_as_array(encoder.assemble(weighted)).select("features", WEIGHT).repartition(partitions, "features")
    return encoder, stage(laid, "vectors")


def features_as_array(df: DataFrame, name: str = "features") -> DataFrame:
    return df if dict(df.dtypes)[name].startswith("array") else df.withColumn(name, vector_to_array(name))


def _distinct(vectors: DataFrame) -> DataFrame:
    """(x, w) with each vector once."""
    merged = features_as_array(vectors).groupBy(F.col("features").alias("x"))
    return merged.agg(F.sum(WEIGHT).alias("w"))


def fit_all(
    vectors: DataFrame,
    ks: Iterable[int],
    iterations: int,
    seed: int = DEFAULT_SEED,
    start_steps: int = 1,
    tolerance: float = 1e-4,
) -> dict[int, Fit]:
    """A fit for each k; every pass over the vectors serves all of them."""
    return M.fit_all(_distinct(vectors), ks, iterations, seed, start_steps, tolerance)


def fit(
    vectors: DataFrame,
    k: int,
    iterations: int,
    seed: int = DEFAULT_SEED,
    start_steps: int = 1,
    tolerance: float = 1e-4,
) -> Fit:
    """Weighted k-means over the vectors, the same way for every size and k (see ``kmeans``)."""
    return fit_all(vectors, [k], iterations, seed, start_steps, tolerance)[k]


def assign(df: DataFrame, encoder: Encoder, found: Fit) -> DataFrame:
    """Every row with its ``cluster`` and its squared ``distance`` to that center."""
    assembled = features_as_array(encoder.assemble(df))
    return M.assign(assembled, found.points).drop("features", *[f"{f}_index" for f in encoder.indexed])


def centers(vectors: DataFrame, found: Fit, names: list[str]) -> DataFrame:
    """(cluster, feature, value), one row per center and feature."""
    schema = T.StructType(
        [
            T.StructField("cluster", T.IntegerType()),
            T.StructField("feature", T.StringType()),
            T.StructField("value", T.DoubleType()),
        ]
    )
    rows = [(i, name, v) for i, center in enumerate(found.points) for name, v in zip(names, center)]
    return vectors.sparkSession.createDataFrame(rows, schema)


def wssse(vectors: DataFrame, found: Fit) -> DataFrame:
    """(k, n_centers, wssse, n_rows): the sum of squared distances to the own center."""
    n = vectors.agg(F.sum(WEIGHT).cast("long").alias("n_rows"))
    return n.select(
        F.lit(found.k).alias("k"), F.lit(found.n_centers).alias("n_centers"), F.lit(found.cost).alias("wssse"), "n_rows"
    )


def center_text(points: M.Centers) -> str:
    return ";".join("[" + ",".join(repr(v) for v in c) + "]" for c in points)


def sweep(
    vectors: DataFrame,
    ks: Iterable[int] = range(15, 31),
    iterations: int = 10,
    seed: int = DEFAULT_SEED,
    start_steps: int = 1,
    tolerance: float = 1e-4,
) -> DataFrame:
    """(k, n_centers, wssse, centers) for each k; every pass over the vectors serves all of them."""
    fits = fit_all(vectors, ks, iterations, seed, start_steps, tolerance)
    rows = [(k, found.n_centers, found.cost, center_text(found.points)) for k, found in fits.items()]
    return vectors.sparkSession.createDataFrame(rows, "k int, n_centers int, wssse double, centers string")
