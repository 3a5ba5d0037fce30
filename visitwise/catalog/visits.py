"""Ordinals, gaps, totals, joins, samples and features of visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitwise.catalog import fixtures as T
from visitwise.catalog.registry import query
from visitwise.functions import features as X
from visitwise.operators import lapses as L
from visitwise.operators import sampling as M
from visitwise.operators.histories import Histories
from visitwise.plans import cluster as K
from visitwise.plans import enrich as E
from visitwise.plans.exploration import merge_left

SAMPLE_FRACTION = 0.25
SAMPLE_SEED = 42

ID = ["donor_id", "donation_dt", "txn_id"]
W = "OVER (PARTITION BY donor_id ORDER BY donation_dt, txn_id)"
P = "OVER (PARTITION BY donor_id)"


def six(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


AGE = "coalesce(CAST(CAST(donation_dt - birth_dt AS DOUBLE) / 365 AS FLOAT), 0)"
ROUNDED = f"floor({AGE} + 0.5)"
BUCKET = f"""CASE WHEN {ROUNDED} = 0 THEN 'Unknown' WHEN {ROUNDED} BETWEEN 16 AND 18 THEN 'High School'
WHEN {ROUNDED} BETWEEN 19 AND 22 THEN 'College' WHEN {ROUNDED} BETWEEN 23 AND 25 THEN 'Post-College'
WHEN {ROUNDED} BETWEEN 26 AND 30 THEN 'late 20s' WHEN {ROUNDED} BETWEEN 31 AND 40 THEN '30s'
WHEN {ROUNDED} >= 41 THEN 'old' ELSE 'invalid' END"""
SEASON = """CASE WHEN month(donation_dt) IN (3, 4, 5) THEN 'Spring' WHEN month(donation_dt) IN (6, 7, 8) THEN 'Summer'
WHEN month(donation_dt) IN (9, 10, 11) THEN 'Fall' WHEN month(donation_dt) IN (12, 1, 2) THEN 'Winter'
ELSE 'Unknown' END"""
ZIP3 = "CASE WHEN length({0}) <= 5 THEN substring(lpad({0}, 5, '0'), 1, 3) ELSE 'invalid' END"
# The span of one person's visits is the sum of the gaps, each taken from the previous row.
GAP = f"coalesce(CAST(donation_dt - lag(donation_dt) {W} AS INTEGER), 0)"
FREQUENCY = f""",
gaps AS (SELECT donor_id, {GAP} AS gap FROM visits),
frequency AS (
  SELECT donor_id, n AS donation_cnt, avg_elapse,
         CASE WHEN CAST(avg_elapse AS FLOAT) = 0 THEN 'Not Applicable'
              WHEN CAST(avg_elapse AS FLOAT) <= 365 THEN '1' ELSE '0' END AS active
  FROM (SELECT donor_id, count(*) AS n,
               CASE WHEN count(*) > 1 THEN CAST(sum(gap) AS DOUBLE) / (count(*) - 1) ELSE 0 END AS avg_elapse
        FROM gaps GROUP BY donor_id))
"""
ENRICHED = (
    FREQUENCY
    + f""",
enriched AS (
  SELECT v.*, p.birth_dt, p.race, p.gender, p.zip5c, n.n_name AS "StateAbbr",
         f.donation_cnt, f.avg_elapse, f.active, v.donation_type AS sponsor_category,
         {AGE} AS age_at_donation, CAST(year(donation_dt) AS INTEGER) AS donation_year,
         CAST(month(donation_dt) AS INTEGER) AS donation_month, {SEASON} AS donation_season,
         {ZIP3.format('site_zip')} AS site_zip3, {ZIP3.format('zip5c')} AS donor_zip3,
         CASE WHEN f.donation_cnt > 1 THEN 1 ELSE 0 END AS repeat_donor, {BUCKET} AS age_bucket
  FROM (SELECT *, row_number() {W} AS donation_order, {GAP} AS since_last_donation FROM visits) v
  LEFT JOIN persons p USING (donor_id) LEFT JOIN nation n ON p.nation_key = n.n_nationkey
  JOIN frequency f USING (donor_id))
"""
)
ENRICHED_COLUMNS = ID + [
    "donation_order", "since_last_donation", "donation_cnt", "repeat_donor", "birth_dt", "race", "gender",
    "zip5c", "StateAbbr", "age_at_donation", "age_bucket", "donation_year", "donation_month", "donation_season",
    "site_zip3", "donor_zip3", "avg_elapse", "active",
]


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = T.visits(spark, sf_dir).withColumn("sponsor_category", F.col("donation_type"))
    return E.enrich(visits, T.persons_with_state(spark, sf_dir), extra=("StateAbbr",))


@query(
    "donor_enriched",
    ENRICHED
    + "SELECT donor_id, donation_dt, txn_id, donation_order, CAST(since_last_donation AS DOUBLE) AS since_last_donation,"
    ' donation_cnt, repeat_donor, birth_dt, race, gender, zip5c, "StateAbbr",'
    " round(CAST(age_at_donation AS DOUBLE), 6) AS age_at_donation, age_bucket, donation_year, donation_month,"
    " donation_season, site_zip3, donor_zip3, round(avg_elapse, 6) AS avg_elapse, active FROM enriched",
)
def donor_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = {c: six(c) for c in ("age_at_donation", "avg_elapse", "since_last_donation")}
    return enriched(spark, sf_dir).select(*ENRICHED_COLUMNS).withColumns(rounded)


@query("summary_project", "SELECT donor_id AS summary_id, birth_dt, race, gender, zip5c FROM persons")
def summary_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.project_persons(T.persons(spark, sf_dir))


@query("donation_order", f"SELECT donor_id, donation_dt, txn_id, row_number() {W} AS donation_order FROM visits")
def donation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Histories.of(T.visits(spark, sf_dir).select(*ID))
    return h.number(ordinal="donation_order").frame()


@query(
    "since_last_donation",
    f"SELECT donor_id, donation_dt, txn_id, CAST({GAP} AS DOUBLE) AS since_last_donation FROM visits",
)
def since_last_donation(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Histories.of(T.visits(spark, sf_dir).select(*ID)).number(gap="since_last_donation")
    return h.frame().withColumn("since_last_donation", F.col("since_last_donation").cast("double"))


@query("donation_cnt", f"SELECT donor_id, txn_id, count(*) {P} AS donation_cnt FROM visits")
def donation_cnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Histories.of(T.visits(spark, sf_dir).select(*ID))
    return h.visits("donation_cnt").frame().select("donor_id", "txn_id", "donation_cnt")


@query("repeat_donors", "SELECT donor_id, count(*) AS donation_cnt FROM visits GROUP BY donor_id HAVING count(*) > 1")
def repeat_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = E.frequency(T.visits(spark, sf_dir)).select("donor_id", "donation_cnt")
    return counts.where(F.col("donation_cnt") > 1)


@query("onetime_donors", "SELECT donor_id, count(*) AS donation_cnt FROM visits GROUP BY donor_id HAVING count(*) = 1")
def onetime_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = E.frequency(T.visits(spark, sf_dir)).select("donor_id", "donation_cnt")
    return counts.where(F.col("donation_cnt") == 1)


@query("donor_frequency", FREQUENCY + """SELECT donor_id, donation_cnt, round(avg_elapse, 6) AS avg_elapse
FROM frequency""")
def donor_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.frequency(T.visits(spark, sf_dir)).select("donor_id", "donation_cnt", six("avg_elapse").alias("avg_elapse"))


@query("active_donor", FREQUENCY + "SELECT donor_id, active FROM frequency")
def active_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.frequency(T.visits(spark, sf_dir)).select("donor_id", "active")


@query(
    "donor_frequency_join",
    FREQUENCY + """SELECT donor_id, donation_dt, txn_id, donation_cnt, round(avg_elapse, 6) AS avg_elapse, active
FROM visits LEFT JOIN frequency USING (donor_id)""",
)
def donor_frequency_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = E.with_frequency(Histories.of(T.visits(spark, sf_dir).select(*ID)))
    return h.frame().withColumn("avg_elapse", six("avg_elapse"))


@query(
    "join_summary",
    """SELECT donor_id, donation_dt, txn_id, birth_dt, race, gender, zip5c
FROM visits LEFT JOIN persons USING (donor_id)""",
)
def join_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = E.project_persons(T.persons(spark, sf_dir)).withColumnRenamed("summary_id", "donor_id")
    return Histories.of(T.visits(spark, sf_dir).select(*ID)).attach(persons).frame()


LOOKUP = """,
counts AS (SELECT donor_id, count(*) AS donation_cnt FROM visits WHERE year(donation_dt) >= 2000 GROUP BY donor_id)
SELECT donor_id, txn_id, donation_cnt,
       CASE WHEN donation_cnt > 1 THEN 1 WHEN donation_cnt = 1 THEN 0 END AS repeat_ind
FROM visits LEFT JOIN counts USING (donor_id)"""


@query("repeat_lookup", LOOKUP)
def repeat_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and flag looked up among the persons seen since 2000; null for the others."""
    visits = T.visits(spark, sf_dir).select(*ID)
    counts = M.strata(visits).select("donor_id", F.col("visits_since").alias("donation_cnt"))
    found = Histories.of(visits).attach(counts).frame()
    flag = F.when(F.col("donation_cnt") > 1, 1).when(F.col("donation_cnt") == 1, 0)
    return found.select("donor_id", "txn_id", "donation_cnt", flag.alias("repeat_ind"))


MERGE = """
SELECT l.donor_id, l.txn_id, l.zip AS zip_x, r.zip AS zip_y, r.gender
FROM (SELECT CASE WHEN txn_id % 97 = 0 THEN NULL ELSE donor_id END AS donor_id, txn_id, site_zip AS zip FROM visits) l
LEFT JOIN (SELECT CASE WHEN donor_id = '1' THEN NULL ELSE donor_id END AS donor_id, zip5c AS zip, gender
           FROM persons) r ON l.donor_id IS NOT DISTINCT FROM r.donor_id"""


@query("merge_left_suffix", MERGE)
def merge_left_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = T.visits(spark, sf_dir).select(
        F.when(F.col("txn_id") % 97 != 0, F.col("donor_id")).alias("donor_id"), "txn_id", F.col("site_zip").alias("zip")
    )
    right = T.persons(spark, sf_dir).select(
        F.when(F.col("donor_id") != "1", F.col("donor_id")).alias("donor_id"), F.col("zip5c").alias("zip"), "gender"
    )
    return merge_left(left, right, "donor_id")


STRATA = """,
strata AS (
  SELECT donor_id, count(*) AS visits_since, CASE WHEN count(*) > 1 THEN 'repeat' ELSE 'onetime' END AS stratum
  FROM visits WHERE year(donation_dt) >= 2000 GROUP BY donor_id)
"""


@query("sample_strata", STRATA + "SELECT donor_id, visits_since, stratum FROM strata")
def sample_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.strata(T.visits(spark, sf_dir))


@query(
    "sample_donors",
    STRATA + """SELECT donor_id, donation_dt, txn_id FROM visits WHERE donor_id IN (
  SELECT donor_id FROM strata WHERE substring(md5(donor_id || '|42'), 1, 8) < '40000000')""",
)
def sample_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sample_persons(T.visits(spark, sf_dir).select(*ID), SAMPLE_FRACTION, SAMPLE_SEED)


@query(
    "age_days_365",
    f"""SELECT txn_id, round(CAST({AGE} AS DOUBLE), 6) AS age_at_donation
FROM visits LEFT JOIN persons USING (donor_id)""",
)
def age_days_365(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_summary(spark, sf_dir)
    return joined.select("txn_id", six(X.age_years_365(F.col("donation_dt"), F.col("birth_dt"))).alias("age_at_donation"))


@query("age_bucket", f"SELECT txn_id, {BUCKET} AS age_bucket FROM visits LEFT JOIN persons USING (donor_id)")
def age_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_summary(spark, sf_dir)
    age = X.age_years_365(F.col("donation_dt"), F.col("birth_dt"))
    return joined.select("txn_id", X.age_bucket(age).alias("age_bucket"))


@query(
    "date_parts",
    """SELECT txn_id, CAST(year(donation_dt) AS INTEGER) AS donation_year,
CAST(month(donation_dt) AS INTEGER) AS donation_month FROM visits""",
)
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("donation_dt")
    return T.visits(spark, sf_dir).select(
        "txn_id", X.visit_year(day).alias("donation_year"), X.visit_month(day).alias("donation_month")
    )


@query("season", f"SELECT txn_id, {SEASON} AS donation_season FROM visits")
def season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.visits(spark, sf_dir).select("txn_id", X.season(F.col("donation_dt")).alias("donation_season"))


@query(
    "repeat_donor",
    f"SELECT txn_id, CASE WHEN count(*) {P} > 1 THEN 1 ELSE 0 END AS repeat_donor FROM visits",
)
def repeat_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Histories.of(T.visits(spark, sf_dir).select(*ID)).visits("n")
    return h.frame().select("txn_id", X.is_repeat(F.col("n")).alias("repeat_donor"))


@query(
    "repeat_donor_ind",
    f"SELECT donor_id, txn_id, CASE WHEN count(*) {P} > 1 THEN 1 ELSE 0 END AS repeat_donor_ind FROM visits",
)
def repeat_donor_ind(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = L.repeat_indicator(Histories.of(T.visits(spark, sf_dir).select(*ID)))
    return h.frame().select("donor_id", "txn_id", "repeat_donor_ind")


@query(
    "zip3",
    f"""SELECT txn_id, {ZIP3.format('site_zip')} AS site_zip3, {ZIP3.format('zip5c')} AS donor_zip3
FROM visits LEFT JOIN persons USING (donor_id)""",
)
def zip3(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = T.persons(spark, sf_dir).select("donor_id", "zip5c")
    joined = Histories.of(T.visits(spark, sf_dir).select(*ID, "site_zip")).attach(persons).frame()
    return joined.select(
        "txn_id", X.zip3(F.col("site_zip")).alias("site_zip3"), X.zip3(F.col("zip5c")).alias("donor_zip3")
    )


@query(
    "donation_bucket",
    """SELECT donor_id, CASE WHEN count(*) = 1 THEN 'One-Time' WHEN count(*) BETWEEN 2 AND 5 THEN '2-5'
WHEN count(*) BETWEEN 6 AND 10 THEN '6-10' WHEN count(*) > 10 THEN '>10' ELSE 'invalid' END AS donation_bucket
FROM visits GROUP BY donor_id""",
)
def donation_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = E.frequency(T.visits(spark, sf_dir))
    return counts.select("donor_id", X.visits_bucket(F.col("donation_cnt")).alias("donation_bucket"))


@query(
    "parse_dates",
    "SELECT txn_id, donation_dt, birth_dt FROM visits LEFT JOIN persons USING (donor_id)",
)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both written date forms read back: visits with dashes, births with slashes."""
    written = join_summary(spark, sf_dir).select(
        "txn_id",
        F.date_format("donation_dt", "yyyy-MM-dd").alias("visit_text"),
        F.date_format("birth_dt", "yyyy/MM/dd").alias("birth_text"),
    )
    return written.select(
        "txn_id",
        X.parse_day(F.col("visit_text"), X.VISIT_DAY_FORMAT).alias("donation_dt"),
        X.parse_day(F.col("birth_text"), X.BIRTH_DAY_FORMAT).alias("birth_dt"),
    )


COHORT = """ FROM enriched WHERE donation_year >= {year} AND first_donat_ind = 1 AND donation_order = 1
AND age_bucket <> 'Unknown'"""
FEATURE_LIST = ", ".join(f'"{f}"' for f in K.FEATURES)


@query("first_donation_cohort", ENRICHED + f"SELECT {FEATURE_LIST}" + COHORT.format(year=2000))
def first_donation_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.first_visit_cohort(enriched(spark, sf_dir))


@query("first_donation_cohort_1995", ENRICHED + f"SELECT {FEATURE_LIST}" + COHORT.format(year=1995))
def first_donation_cohort_1995(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same since a year that most first visits of the test tables are after."""
    return K.first_visit_cohort(enriched(spark, sf_dir), since_year=1995)
