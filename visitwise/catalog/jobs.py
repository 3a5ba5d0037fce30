"""The preprocess job end to end: extracts and schema files written, the job run, its outputs read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitwise.catalog import fixtures as T
from visitwise.catalog.ingest import TYPED
from visitwise.catalog.registry import query
from visitwise.catalog import clusters as CL
from visitwise.catalog.visits import SAMPLE_SEED
from visitwise.operators.sampling import HASH_SPACE
from visitwise.plans import cluster as K
from visitwise.plans.preprocess import Outputs, preprocess
from visitwise.sources.extracts import read_csv, read_parquet, register_views
from visitwise.sources.workspace import new_path

# The fields of the two extracts.
VISIT_FIELDS = [("donor_id", "string"), ("donation_dt", "date"), ("n", "integer"), ("Latitude", "float"),
                ("donation_type", "string"), ("site_zip", "string")]
PERSON_FIELDS = [("donor_id", "string"), ("birth_dt", "date"), ("race", "string"), ("gender", "string"), ("zip5c", "string")]
SINCE_YEAR = 1995
FRACTION = 0.25


def _document(spark: SparkSession, fields: list[tuple[str, str]], path: str) -> None:
    document = [([{"name": n, "type": t} for n, t in fields],)]
    spark.createDataFrame(document, "fields array<struct<name: string, type: string>>").coalesce(1).write.json(path)


def _headed(spark: SparkSession, fields: list[tuple[str, str]], lines: DataFrame, path: str) -> None:
    header = spark.range(0, 1, 1, 1).select(F.lit(",".join(n for n, _ in fields)).alias("value"))
    header.union(lines.select("value")).write.text(path)


def run_job(spark: SparkSession, sf_dir: str, fraction: float) -> Outputs:
    """The job over the raw lines and the persons, in a folder whose name has a space."""
    folder = new_path(spark, "preprocess job")
    _document(spark, VISIT_FIELDS, f"{folder}/schemas/states")
    _document(spark, PERSON_FIELDS, f"{folder}/schemas/summary")
    # The last field of the lines stands in for the postal code that the job's features need.
    _headed(spark, VISIT_FIELDS, T.raw_lines(spark, sf_dir), f"{folder}/visits in")
    values = [F.coalesce(F.col(n).cast("string"), F.lit("none")) for n, _ in PERSON_FIELDS]
    # Ids are written as the raw lines have them.
    persons = T.persons(spark, sf_dir).withColumn("donor_id", F.concat(F.lit("d"), "donor_id"))
    _headed(spark, PERSON_FIELDS, persons.select(F.concat_ws(",", *values).alias("value")), f"{folder}/persons in")
    return preprocess(
        spark, f"{folder}/visits in", f"{folder}/persons in", f"{folder}/schemas", f"{folder}/out",
        fraction=fraction, seed=SAMPLE_SEED, since_year=SINCE_YEAR,
        visits_schema="states", persons_schema="summary",
    )


COLUMNS = ["donor_id", "donation_dt", "n", "donation_type", "site_zip", "birth_dt", "race", "donation_cnt"]
# What does not depend on the order of equal days: the cleaned row, its person, and the person's count.
JOB = TYPED + """,
rows AS (SELECT donor_id, donation_dt, n, donation_type, "StateAbbr" AS site_zip FROM typed WHERE donor_id IS NOT NULL),
counts AS (SELECT donor_id, count(*) AS donation_cnt FROM rows GROUP BY donor_id),
people AS (SELECT 'D' || donor_id AS donor_id, birth_dt, upper(substring(race, 1, 1)) || substring(race, 2) AS race FROM persons),
job AS (
  SELECT r.*, p.birth_dt, p.race, c.donation_cnt
  FROM rows r JOIN counts c USING (donor_id) LEFT JOIN people p USING (donor_id))
"""
PICK = f"substring(md5(donor_id || '|{SAMPLE_SEED}'), 1, 8) < '{int(FRACTION * HASH_SPACE):08x}'"


def _read(spark: SparkSession, path: str) -> DataFrame:
    """The job's table through a view, as SQL users read it."""
    register_views(preprocessed=read_parquet(spark, path, "part*.parquet"))
    return spark.sql(f"SELECT {', '.join(COLUMNS)} FROM preprocessed")


@query("preprocess_job", JOB + 'SELECT donor_id, donation_dt, n, donation_type, site_zip, birth_dt, race, donation_cnt FROM job')
def preprocess_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, run_job(spark, sf_dir, 1.0).data)


@query(
    "preprocess_sample",
    JOB + f"""SELECT donor_id, donation_dt, n, donation_type, site_zip, birth_dt, race, donation_cnt FROM job
WHERE {PICK} AND donor_id IN (SELECT donor_id FROM rows WHERE year(donation_dt) >= {SINCE_YEAR})""",
)
def preprocess_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, run_job(spark, sf_dir, FRACTION).data)


@query("preprocess_rejects", TYPED + """SELECT value, 'arity' AS reject_reason, 'visits' AS extract FROM raw_lines
WHERE len(string_split(rtrim(value, ','), ',')) <> 6
UNION ALL SELECT value, 'missing donor_id', 'visits' FROM typed JOIN raw_lines USING (txn_id) WHERE donor_id IS NULL""")
def preprocess_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, run_job(spark, sf_dir, 1.0).rejects)


# The fields that the clustering job needs beside those of the visits.
CLUSTER_FIELDS = [
    ("donor_id", "string"), ("donation_dt", "date"), ("txn_id", "string"), ("site_zip", "string"),
    ("donation_type", "string"), ("first_donat_ind", "integer"), ("walk_in_ind", "integer"), ("deferral_ind", "integer"),
    ("sponsor_category", "string"),
]
CLUSTER_PERSONS = [*PERSON_FIELDS, ("StateAbbr", "string")]


def _lines(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    values = [F.coalesce(F.col(n).cast("string"), F.lit("none")) for n, _ in fields]
    return df.select(F.concat_ws(",", *values).alias("value"))


def clustered_data(spark: SparkSession, sf_dir: str) -> str:
    """The preprocess job over visits and persons written as extracts; the path of its enriched table."""
    folder = new_path(spark, "cluster job")
    _document(spark, CLUSTER_FIELDS, f"{folder}/schemas/states")
    _document(spark, CLUSTER_PERSONS, f"{folder}/schemas/summary")
    visits = T.visits(spark, sf_dir).withColumn("sponsor_category", F.col("donation_type"))
    # Padded, so that the lines of one person and day have the order of their numbers.
    visits = visits.withColumn("txn_id", F.lpad(F.col("txn_id").cast("string"), 12, "0"))
    _headed(spark, CLUSTER_FIELDS, _lines(visits, CLUSTER_FIELDS), f"{folder}/visits")
    _headed(spark, CLUSTER_PERSONS, _lines(T.persons_with_state(spark, sf_dir), CLUSTER_PERSONS), f"{folder}/persons")
    return preprocess(
        spark, f"{folder}/visits", f"{folder}/persons", f"{folder}/schemas", f"{folder}/out",
        since_year=SINCE_YEAR, visits_schema="states", persons_schema="summary", extra=("StateAbbr",), keep_rejects=False,
    ).data


JOB_CLUSTERS = 4


@query("cluster_job", CL.COHORT_RANKS + CL.fixed_points_sql("indexed", range(JOB_CLUSTERS, JOB_CLUSTERS + 1), CL.NAMES))
def cluster_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job from extracts to settled clusters, held against the cohort's single visits."""
    path = clustered_data(spark, sf_dir)
    done = K.cluster_job(spark, path, JOB_CLUSTERS, CL.TO_THE_END, since_year=CL.SINCE_YEAR, tolerance=0.0)
    rows = K.first_visit_cohort(read_parquet(spark, path, "part*.parquet"), since_year=CL.SINCE_YEAR)
    return CL.fixed_points(CL.single_vectors(rows, done.encoder), {JOB_CLUSTERS: done.fit}, done.names)


@query(
    "sweep_job",
    CL.COHORT_RANKS + f"""SELECT CAST(k.range AS INTEGER) AS "K", least(CAST(k.range AS INTEGER), (SELECT CAST(count(*) AS INTEGER)
  FROM (SELECT DISTINCT {", ".join(f'"{n}"' for n in CL.NAMES)} FROM indexed))) AS n_centers,
  CASE WHEN k.range = 1 THEN (SELECT round(count(*) * ({" + ".join(f'var_pop(CAST("{n}" AS DOUBLE))' for n in CL.NAMES)}), 2)
  FROM indexed) END AS wssse_of_one FROM range(1, {JOB_CLUSTERS + 1}) k""",
)
def sweep_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep's CSV table read back: centers per K, and the cost of one cluster."""
    output = new_path(spark, "sweep")
    K.sweep_job(spark, clustered_data(spark, sf_dir), output, range(1, JOB_CLUSTERS + 1), since_year=CL.SINCE_YEAR)
    table = read_csv(spark, output)
    one = F.when(F.col("K") == 1, F.round(F.col("WSSSE").cast("double"), 2))
    return table.select(
        F.col("K").cast("int").alias("K"), F.size(F.split("Centers", ";")).alias("n_centers"), one.alias("wssse_of_one")
    )
