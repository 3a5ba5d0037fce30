"""Encoding and clustering of first visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitwise.catalog.registry import query
from visitwise.catalog.visits import COHORT, ENRICHED, enriched
from visitwise.operators import clustering as C
from visitwise.operators import kmeans as M
from visitwise.plans import cluster as K

# The features that hold text; the others are numbers.
TEXT = ["donation_season", "age_bucket", "donation_type", "sponsor_category", "race", "gender", "StateAbbr"]


def ranks_sql(where: str = "") -> str:
    """``filled`` and ``indexed`` over the enriched visits, or over those that fulfil ``where``."""
    filled = ENRICHED + ", filled AS (SELECT txn_id, " + ", ".join(
        f"""coalesce("{f}", '__null__') AS "{f}" """ if f in TEXT else f'"{f}"' for f in K.FEATURES
    ) + f" FROM enriched {where})\n"
    ranks = "".join(
        f""", r_{i} AS (SELECT "{f}", CAST(row_number() OVER (ORDER BY count(*) DESC, "{f}") - 1 AS DOUBLE) AS ix
FROM filled GROUP BY "{f}")"""
        for i, f in enumerate(TEXT)
    )
    indexed = ", indexed AS (SELECT filled.*, " + ", ".join(f'r_{i}.ix AS "{f}_index"' for i, f in enumerate(TEXT))
    joins = " FROM filled " + " ".join(f'JOIN r_{i} ON r_{i}."{f}" = filled."{f}"' for i, f in enumerate(TEXT))
    return filled + ranks + indexed + joins + ")\n"


FILLED = ranks_sql()
RANKS = FILLED
NAMES = [f"{f}_index" if f in TEXT else f for f in K.FEATURES]


def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("txn_id", *K.FEATURES)


def encoder(df: DataFrame) -> C.Encoder:
    return C.Encoder.fit(C.combinations(df, K.FEATURES), K.FEATURES)


@query("ml_fill", FILLED + "SELECT txn_id, race, gender, \"StateAbbr\" FROM filled")
def ml_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["race", "gender", "StateAbbr"]
    return C.fill_labels(all_features(spark, sf_dir).select("txn_id", *columns), columns)


@query("ml_index", RANKS + "SELECT txn_id, " + ", ".join(f'"{f}_index"' for f in TEXT) + " FROM indexed")
def ml_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = all_features(spark, sf_dir)
    return encoder(df).index(df).select("txn_id", *[f"{f}_index" for f in TEXT])


@query(
    "ml_assemble",
    RANKS
    + " UNION ALL ".join(
        f"""SELECT txn_id, '{n}' AS feature, CAST("{n}" AS DOUBLE) AS value FROM indexed"""
        for n in (f"{f}_index" if f in TEXT else f for f in K.FEATURES)
    ),
)
def ml_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled vectors, one row per component."""
    df = all_features(spark, sf_dir)
    enc = encoder(df)
    vectors = C.features_as_array(enc.assemble(df).select("txn_id", "features"))
    names = F.array(*[F.lit(n) for n in enc.names])
    return vectors.select("txn_id", F.posexplode("features").alias("pos", "value")).select(
        "txn_id", F.get(names, F.col("pos")).alias("feature"), "value"
    )


CLUSTERS = 5
ITERATIONS = 10
# The stand-in table starts in 1995, so nearly all its first visits are before 2000.
SINCE_YEAR = 1995


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.first_visit_cohort(enriched(spark, sf_dir), since_year=SINCE_YEAR)


COHORT_RANKS = ranks_sql(COHORT.format(year=SINCE_YEAR).replace(" FROM enriched ", ""))


@query(
    "kmeans_one",
    COHORT_RANKS
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, round(avg(CAST("{n}" AS DOUBLE)), 6) AS center,
round(var_pop(CAST("{n}" AS DOUBLE)) * count(*), 4) AS cost, count(*) AS n_rows FROM indexed"""
        for n in NAMES
    ),
)
def kmeans_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single center of the cohort and each feature's part of the cost."""
    enc, vectors = C.encode(cohort(spark, sf_dir), K.FEATURES)
    found = C.fit(vectors, 1, ITERATIONS)
    names = F.array(*[F.lit(n) for n in enc.names])
    center = F.array(*[F.lit(x) for x in found.points[0]])
    parts = C.features_as_array(vectors).select(F.posexplode("features").alias("pos", "x"), C.WEIGHT)
    off = F.col("x") - F.get(center, F.col("pos"))
    sums = parts.groupBy("pos").agg(F.sum(off * off * F.col(C.WEIGHT)).alias("cost"), F.sum(C.WEIGHT).alias("n"))
    return sums.select(
        F.get(names, F.col("pos")).alias("feature"),
        F.round(F.get(center, F.col("pos")), 6).alias("center"),
        F.round("cost", 4).alias("cost"),
        F.col("n").cast("long").alias("n_rows"),
    )


@query(
    "kmeans_every_point",
    COHORT_RANKS
    + f"""SELECT DISTINCT concat_ws(',', {", ".join(f'CAST(round(CAST("{n}" AS DOUBLE)) AS BIGINT)' for n in NAMES)}) AS center,
CAST(0 AS DOUBLE) AS cost FROM indexed""",
)
def kmeans_every_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many clusters as distinct vectors: every vector is a center and costs nothing."""
    _, vectors = C.encode(cohort(spark, sf_dir), K.FEATURES)
    found = C.fit(vectors, vectors.count(), ITERATIONS)
    rows = [(",".join(str(round(x)) for x in point), found.cost) for point in found.points]
    return spark.createDataFrame(rows, "center string, cost double")


def fixed_points(rows: DataFrame, fits: dict[int, C.Fit], names: list[str]) -> DataFrame:
    """(k, item, value): what must hold of settled fits over single rows of (features array<double>).

    Every row is given its nearest center anew. Then the members of all clusters are the rows, a center is off
    its members' mean by nothing, the cost is that of the distances, and by members times center the
    rows' sums and sum of squares come out.
    """
    spark = rows.sparkSession
    single = rows.select(F.col("features").alias("x"), F.lit(1.0).alias("w"))
    keyed = M.keyed(single, {k: f.points for k, f in fits.items()}).withColumn("nearest", F.expr(M.NEAREST))
    sums = F.array(*[F.sum(F.get("x", F.lit(j))) for j in range(len(names))])
    per = keyed.groupBy("k", F.col("nearest.cluster").alias("i")).agg(
        F.count(F.lit(1)).alias("n"), sums.alias("sums"), F.sum("nearest.distance").alias("spread")
    )
    listed = [(k, i, c, f.n_centers, f.cost) for k, f in fits.items() for i, c in enumerate(f.points)]
    centers = spark.createDataFrame(listed, "k int, i int, center array<double>, n_centers int, cost double")
    off = F.array_max(F.zip_with("sums", "center", lambda s, c: F.abs(s / F.col("n") - c)))
    squares = F.col("n") * F.aggregate("center", F.lit(0.0), lambda t, c: t + c * c)
    per = per.join(centers, ["k", "i"]).groupBy("k").agg(
        F.sum("n").cast("double").alias("rows"),
        F.first("n_centers").cast("double").alias("clusters"),
        F.round(F.max(off), 6).alias("off center"),
        F.round(F.abs(F.sum("spread") - F.first("cost")) / F.greatest(F.first("cost"), F.lit(1.0)), 6).alias("off cost"),
        F.round(F.first("cost") + F.sum(squares), 1).alias("squares"),
        *[F.round(F.sum(F.col("n") * F.get("center", F.lit(j))), 3).alias(f"sum {name}") for j, name in enumerate(names)],
    )
    items = [F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").alias("value")) for c in per.columns if c != "k"]
    return per.select("k", F.inline(F.array(*items)))


def fixed_points_sql(source: str, ks: range, names: list[str]) -> str:
    """``fixed_points`` of any settled fits over ``source``, a table with a column per name."""
    number = {n: f'CAST("{n}" AS DOUBLE)' for n in names}
    items = {
        "rows": "CAST(count(*) AS DOUBLE)",
        "clusters": f"CAST(least(k, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(number.values())} FROM {source}))) AS DOUBLE)",
        "off center": "CAST(0 AS DOUBLE)",
        "off cost": "CAST(0 AS DOUBLE)",
        "squares": f"round(sum({' + '.join(f'{c} * {c}' for c in number.values())}), 1)",
        **{f"sum {n}": f"round(sum({c}), 3)" for n, c in number.items()},
    }
    fits = f"(SELECT CAST(range AS INTEGER) AS k FROM range({ks.start}, {ks.stop})) ks"
    return " UNION ALL ".join(f"SELECT k, '{n}' AS item, {e} AS value FROM {source}, {fits} GROUP BY k" for n, e in items.items())


TO_THE_END = 10_000
SWEEP = range(15, 31)


def single_vectors(df: DataFrame, enc: C.Encoder) -> DataFrame:
    return C.features_as_array(enc.assemble(df)).select("features")


@query("kmeans_fixed_point", COHORT_RANKS + fixed_points_sql("indexed", range(CLUSTERS, CLUSTERS + 1), NAMES))
def kmeans_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit run until nothing moves, held against the cohort's single visits."""
    rows = cohort(spark, sf_dir)
    enc, vectors = C.encode(rows, K.FEATURES)
    found = C.fit(vectors, CLUSTERS, TO_THE_END, tolerance=0.0)
    return fixed_points(single_vectors(rows, enc), {CLUSTERS: found}, enc.names)


@query("kmeans_sweep_fixed_points", COHORT_RANKS + fixed_points_sql("indexed", SWEEP, NAMES))
def kmeans_sweep_fixed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fits of the sweep run until nothing moves."""
    rows = cohort(spark, sf_dir)
    enc, vectors = C.encode(rows, K.FEATURES)
    fits = C.fit_all(vectors, SWEEP, TO_THE_END, tolerance=0.0)
    return fixed_points(single_vectors(rows, enc), fits, enc.names)


@query("kmeans_members", COHORT_RANKS + "SELECT txn_id, 1 AS clusters, true AS nearest FROM indexed")
def kmeans_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every visit of the cohort lies in one cluster, and no other center is nearer to it."""
    rows = K.first_visit_cohort(enriched(spark, sf_dir), ["txn_id", *K.FEATURES], SINCE_YEAR)
    found = K.cluster(rows, CLUSTERS, ITERATIONS)
    centers = F.array(*[F.array(*[F.lit(v) for v in point]) for point in found.fit.points])
    at = found.encoder.index(found.assign(rows).withColumnRenamed("cluster", "own"))
    at = at.select("txn_id", "own", "distance", F.array(*found.names).alias("x"), F.posexplode(centers).alias("i", "center"))
    apart = F.aggregate(F.zip_with("x", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, s: t + s)
    return at.groupBy("txn_id").agg(
        F.count_if(F.col("own") == F.col("i")).cast("int").alias("clusters"),
        F.min(apart >= F.col("distance")).alias("nearest"),
    )


@query("kmeans_centers")
def kmeans_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cluster(cohort(spark, sf_dir), CLUSTERS, ITERATIONS).centers


@query("kmeans_wssse")
def kmeans_wssse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cluster(cohort(spark, sf_dir), CLUSTERS, ITERATIONS).wssse


@query("kmeans_sweep")
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vectors = C.encode(cohort(spark, sf_dir), K.FEATURES)
    return C.sweep(vectors)
