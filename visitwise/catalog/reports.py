"""Exploration: missing values, lapses, ages, histograms, early returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitwise.catalog import fixtures as T
from visitwise.catalog.registry import query
from visitwise.catalog.visits import GAP, ID, P, W, six
from visitwise.operators import lapses as L
from visitwise.operators import profiling as R
from visitwise.operators.histories import Histories, Keys
from visitwise.plans.exploration import CYCLE_BINS, YEAR_BINS, explore, merge_left

MERGED_COLUMNS = [
    "donor_id", "donation_dt", "txn_id", "donation_type", "donation_ind", "deferral_ind", "first_donat_ind",
    "walk_in_ind", "site_zip", "birth_dt", "race", "gender", "zip5c",
]
MERGED = ", merged AS (SELECT v.*, p.* EXCLUDE (donor_id, nation_key) FROM visits v LEFT JOIN persons p USING (donor_id))"
MISSING = MERGED + ", missing AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS count,
(count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS percentage FROM merged"""
    for c in MERGED_COLUMNS
) + ")\n"


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = T.persons(spark, sf_dir).drop("nation_key")
    return merge_left(T.visits(spark, sf_dir), persons, "donor_id")


def of_type():
    return F.col("donation_type") == T.WHOLE_TYPE


@query("table_shape", MERGED + "SELECT count(*) AS n_rows, 13 AS n_columns FROM merged")
def table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table_shape(merged(spark, sf_dir))


@query(
    "missing_values",
    MISSING + 'SELECT "column", count, round(percentage, 6) AS percentage FROM missing ORDER BY percentage DESC, "column"',
)
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = R.missing_report(merged(spark, sf_dir))
    return report.withColumn("percentage", six("percentage"))


@query(
    "missing_below_threshold",
    MISSING + 'SELECT "column", count, round(percentage, 6) AS percentage FROM missing WHERE percentage < 0.7',
)
def missing_below_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.missing_below(merged(spark, sf_dir), 0.7).withColumn("percentage", six("percentage"))


@query("distinct_types", "SELECT DISTINCT donation_type FROM visits")
def distinct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_values(T.visits(spark, sf_dir), "donation_type")


LAPSE = f""",
lapse AS (
  SELECT *, row_number() {W} AS donate_times, {GAP} AS lag_in_days,
         CASE WHEN count(*) {P} > 1 THEN 1 ELSE 0 END AS repeat_donor_ind FROM visits),
typed_visits AS (SELECT * FROM visits WHERE donation_type = '{T.WHOLE_TYPE}'),
typed AS (
  SELECT *, row_number() {W} AS donate_times, {GAP} AS lag_in_days,
         CASE WHEN count(*) {P} > 1 THEN 1 ELSE 0 END AS repeat_donor_ind FROM typed_visits)
"""
LAPSE_COLUMNS = ID + ["donate_times", "lag_in_days", "repeat_donor_ind"]
LAPSE_LIST = ", ".join(LAPSE_COLUMNS)


def lapse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lapse_table(T.visits(spark, sf_dir).select(*ID, "donation_ind"))


def typed_lapse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one type is filtered first: ordinals and lags are among its own visits."""
    return L.lapse_table(T.visits(spark, sf_dir).where(of_type()).select(*ID, "donation_ind"))


@query("donation_lapse", LAPSE + f"SELECT {LAPSE_LIST} FROM lapse")
def donation_lapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lapse_table(spark, sf_dir).select(*LAPSE_COLUMNS)


@query("whole_blood_lapse", LAPSE + f"SELECT {LAPSE_LIST} FROM typed")
def whole_blood_lapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_lapse_table(spark, sf_dir).select(*LAPSE_COLUMNS)


@query(
    "event_lapse",
    """SELECT user_id, event_id, row_number() OVER w AS donate_times,
coalesce(CAST(CAST(ts AS DATE) - CAST(lag(ts) OVER w AS DATE) AS INTEGER), 0) AS lag_in_days
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def event_lapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over another history: users and their events."""
    events = T.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    h = L.with_lapse(Histories.of(events, Keys("user_id", "ts", "event_id")))
    return h.frame().select("user_id", "event_id", "donate_times", "lag_in_days")


AGES = f""",
births AS (
  SELECT v.*, CAST(date_sub('year', birth_dt, donation_dt) AS INTEGER) AS age
  FROM visits v JOIN persons USING (donor_id) WHERE birth_dt IS NOT NULL),
firsts AS (SELECT *, row_number() {W} AS rn, first_value(age) {W} AS first_age FROM births),
aged AS (
  SELECT txn_id, age, CASE WHEN rn > 1 AND first_donat_ind = 0 THEN first_age ELSE age END AS fst FROM firsts),
ages AS (
  SELECT v.*, age AS age_at_donation, fst AS fst_donation_age FROM visits v LEFT JOIN aged USING (txn_id))
"""
CATEGORY = """CASE WHEN {0} < 18 THEN '<18' WHEN {0} <= 22 THEN '18-22' WHEN {0} <= 30 THEN '23-30'
WHEN {0} <= 35 THEN '31-35' WHEN {0} > 35 THEN '>35' END"""


def aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    births = T.persons(spark, sf_dir).select("donor_id", "birth_dt")
    h = Histories.of(T.visits(spark, sf_dir).select(*ID, "first_donat_ind")).attach(births)
    return L.with_ages(h).frame()


@query("age_at_donation", AGES + "SELECT txn_id, age_at_donation FROM ages")
def age_at_donation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aged(spark, sf_dir).select("txn_id", "age_at_donation")


@query("first_donation_age", AGES + "SELECT donor_id, txn_id, fst_donation_age FROM ages")
def first_donation_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aged(spark, sf_dir).select("donor_id", "txn_id", "fst_donation_age")


@query(
    "age_categories",
    AGES + f"""SELECT txn_id, {CATEGORY.format('age_at_donation')} AS age_at_donation_cat,
{CATEGORY.format('fst_donation_age')} AS fst_donation_age_cat FROM ages""",
)
def age_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aged(spark, sf_dir).select("txn_id", "age_at_donation_cat", "fst_donation_age_cat")


@query(
    "deferred_head",
    AGES + """SELECT donor_id, donation_dt, txn_id, deferral_ind, age_at_donation, fst_donation_age
FROM ages WHERE deferral_ind = 1 ORDER BY donor_id, donation_dt, txn_id LIMIT 5""",
)
def deferred_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.deferred_head(merged(spark, sf_dir), 5).select(
        *ID, "deferral_ind", "age_at_donation", "fst_donation_age"
    )


@query(
    "lapse_preview",
    LAPSE + AGES + f"""SELECT donor_id, donation_dt, a.fst_donation_age, {CATEGORY.format('a.fst_donation_age')}
AS fst_donation_age_cat, a.age_at_donation, repeat_donor_ind, donate_times, lag_in_days
FROM lapse JOIN (SELECT txn_id, age_at_donation, fst_donation_age FROM ages) a USING (txn_id)
ORDER BY donor_id, donation_dt, txn_id LIMIT 10""",
)
def lapse_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lapse_preview(merged(spark, sf_dir), 10).select(
        "donor_id", "donation_dt", "fst_donation_age", "fst_donation_age_cat", "age_at_donation",
        "repeat_donor_ind", "donate_times", "lag_in_days",
    )


# name: (table, condition, days per unit, unit, histogram name, bins)
LAPSES = {
    "lapse_years_all": ("lapse", "lag_in_days <> 0", L.DAYS_PER_YEAR, "years", "hist_lapse_years", YEAR_BINS),
    "lapse_years_1_2": ("lapse", "donate_times = 2", L.DAYS_PER_YEAR, "years", "hist_lapse_years_1_2", YEAR_BINS),
    "lapse_cycles_all": ("typed", "lag_in_days <> 0", L.DAYS_PER_CYCLE, "cycles", "hist_cycles_all", CYCLE_BINS),
    "lapse_cycles_1_2": ("typed", "donate_times = 2", L.DAYS_PER_CYCLE, "cycles", "hist_cycles_1_2", CYCLE_BINS),
    "lapse_cycles_ge_2": ("typed", "donate_times >= 2", L.DAYS_PER_CYCLE, "cycles", "hist_cycles_ge_2", CYCLE_BINS),
}


def lapses_sql(table: str, condition: str, days: int) -> str:
    return f"SELECT txn_id, CAST(lag_in_days AS DOUBLE) / {days} AS x FROM {table} WHERE {condition} AND donation_ind = 1"


def histogram_sql(values: str, bins: int, before: str = ", ") -> str:
    return before + f"""vals AS ({values}), b AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {bins} AS w FROM vals),
guessed AS (SELECT x, lo, w, least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS g FROM vals, b),
binned AS (
  SELECT CASE WHEN x < g * w + lo THEN g - 1 WHEN g < {bins - 1} AND x >= (g + 1) * w + lo THEN g + 1 ELSE g END AS bin,
         count(*) AS n FROM guessed GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, round(r.range * (SELECT w FROM b) + (SELECT lo FROM b), 6) AS lo,
  round((r.range + 1) * (SELECT w FROM b) + (SELECT lo FROM b), 6) AS hi, coalesce(n, 0) AS n
FROM range({bins}) r LEFT JOIN binned ON binned.bin = r.range"""


def _register_lapse(name: str, table: str, condition: str, days: int, unit: str, hist: str, bins: int) -> None:
    values = lapses_sql(table, condition, days)
    conditions = {
        "lag_in_days <> 0": L.nonzero,
        "donate_times = 2": L.first_to_second,
        "donate_times >= 2": L.from_second_on,
    }

    def lapses(spark: SparkSession, sf_dir: str) -> DataFrame:
        make = lapse_table if table == "lapse" else typed_lapse_table
        return L.lapses(make(spark, sf_dir), conditions[condition](), days, unit)

    @query(name, LAPSE + f"SELECT round(x, 6) AS {unit} FROM ({values})")
    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lapses(spark, sf_dir).withColumn(unit, six(unit))

    @query(
        hist,
        LAPSE + histogram_sql(values, bins),
    )
    def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = R.histogram(lapses(spark, sf_dir), unit, bins)
        return bars.withColumns({"lo": six("lo"), "hi": six("hi")})


for _name, _spec in LAPSES.items():
    _register_lapse(_name, *_spec)

EARLY = LAPSE + ", early AS (SELECT donor_id, txn_id FROM typed WHERE lag_in_days < 56 AND lag_in_days <> 0)\n"


def typed_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = T.visits(spark, sf_dir).select(*ID, "donation_type")
    return L.early_return_visits(visits, of_type())


@query("early_return_ids", EARLY + "SELECT donor_id, txn_id FROM early")
def early_return_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_early(spark, sf_dir).select("donor_id", "txn_id")


@query("early_return_count", EARLY + "SELECT count(*) AS n FROM early")
def early_return_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_early(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query(
    "early_return_donors",
    EARLY + """SELECT donor_id, donation_dt, txn_id, donation_type, donate_times, lag_in_days
FROM lapse WHERE donor_id IN (SELECT donor_id FROM early)""",
)
def early_return_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = T.visits(spark, sf_dir).select(*ID, "donation_type")
    return L.early_return_histories(visits, of_type())


@query(
    "early_return_preview",
    EARLY + AGES + """SELECT donor_id, donation_type, donation_dt, first_donat_ind, deferral_ind, donation_ind,
donate_times, lag_in_days, a.age_at_donation
FROM lapse JOIN (SELECT txn_id, age_at_donation FROM ages) a USING (txn_id)
WHERE donor_id IN (SELECT donor_id FROM early) ORDER BY donor_id, donation_dt, txn_id LIMIT 8""",
)
def early_return_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persons come from the one placement of the visits; ages join the eight rows at the end."""
    visits = T.visits(spark, sf_dir).select(
        *ID, "donation_type", "first_donat_ind", "deferral_ind", "donation_ind"
    )
    top = L.head_rows(L.early_return_histories(visits, of_type()), 8, Keys())
    births = T.persons(spark, sf_dir).select("donor_id", "birth_dt")
    return L.with_calendar_age(top, births).select(
        "donor_id", "donation_type", "donation_dt", "first_donat_ind", "deferral_ind", "donation_ind",
        "donate_times", "lag_in_days", "age_at_donation",
    )


def report(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    persons = T.persons(spark, sf_dir).drop("nation_key")
    return explore(T.visits(spark, sf_dir), persons, T.WHOLE_TYPE)


@query(
    "explore_histograms",
    LAPSE + " UNION ALL ".join(
        f"SELECT '{hist}' AS series, bin, lo, hi, n FROM ({histogram_sql(lapses_sql(table, condition, days), bins, 'WITH ')})"
        for table, condition, days, _, hist, bins in LAPSES.values()
    ),
)
def explore_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five histograms of the report."""
    tables = report(spark, sf_dir)
    named = [tables[spec[4]].withColumn("series", F.lit(spec[4])) for spec in LAPSES.values()]
    bars = named[0]
    for more in named[1:]:
        bars = bars.unionByName(more)
    return bars.withColumns({"lo": six("lo"), "hi": six("hi")})


@query(
    "explore_early_returns",
    EARLY + AGES + """SELECT 'early' AS part, donor_id, txn_id, donate_times, lag_in_days, CAST(NULL AS INTEGER) AS age
FROM typed WHERE lag_in_days < 56 AND lag_in_days <> 0
UNION ALL SELECT DISTINCT 'person', donor_id, NULL, NULL, NULL, NULL FROM early
UNION ALL SELECT 'count', NULL, count(*), NULL, NULL, NULL FROM early
UNION ALL (SELECT 'preview', donor_id, txn_id, donate_times, lag_in_days, a.age_at_donation
FROM lapse JOIN (SELECT txn_id, age_at_donation FROM ages) a USING (txn_id)
WHERE donor_id IN (SELECT donor_id FROM early) ORDER BY donor_id, donation_dt, txn_id LIMIT 8)""",
)
def explore_early_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early returns, their persons, their number, and the first rows of those persons' histories."""
    tables = report(spark, sf_dir)
    none, lapse = F.lit(None).cast("int"), ["donate_times", "lag_in_days"]
    early = tables["early_returns"].select(F.lit("early").alias("part"), "donor_id", "txn_id", *lapse, none.alias("age"))
    ids = tables["early_return_ids"].select(F.lit("person"), "donor_id", F.lit(None), F.lit(None), F.lit(None), none)
    number = tables["early_return_count"].select(F.lit("count"), F.lit(None), "n", F.lit(None), F.lit(None), none)
    top = tables["early_return_preview"].select(F.lit("preview"), "donor_id", "txn_id", *lapse, "age_at_donation")
    return early.union(ids).union(number).union(top)


@query(
    "explore_profile",
    MISSING + """SELECT 'rows' AS part, 'rows' AS name, count(*) AS n, CAST(13 AS DOUBLE) AS share FROM merged
UNION ALL SELECT 'missing', "column", count, round(percentage, 6) FROM missing
UNION ALL SELECT 'below', "column", count, round(percentage, 6) FROM missing WHERE percentage < 0.7
UNION ALL SELECT DISTINCT 'type', donation_type, 0, 0.0 FROM visits""",
)
def explore_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, missing values and visit types of the merged table."""
    tables = report(spark, sf_dir)
    shape = tables["table_shape"].select(
        F.lit("rows").alias("part"), F.lit("rows").alias("name"), F.col("n_rows").alias("n"),
        F.col("n_columns").cast("double").alias("share"),
    )
    missing = tables["missing_values"].select(F.lit("missing"), "column", "count", six("percentage"))
    below = tables["missing_below_threshold"].select(F.lit("below"), "column", "count", six("percentage"))
    types = tables["distinct_types"].select(F.lit("type"), "donation_type", F.lit(0), F.lit(0.0))
    return shape.union(missing).union(below).union(types)


@query(
    "explore_heads",
    LAPSE + AGES + """SELECT 'deferred' AS part, donor_id, txn_id, NULL AS donate_times, fst_donation_age FROM (SELECT * FROM ages
WHERE deferral_ind = 1 ORDER BY donor_id, donation_dt, txn_id LIMIT 5)
UNION ALL SELECT 'lapse', donor_id, txn_id, donate_times, fst_donation_age FROM (
  SELECT lapse.donor_id, lapse.txn_id, donate_times, a.fst_donation_age
  FROM lapse JOIN (SELECT txn_id, fst_donation_age FROM ages) a USING (txn_id)
  ORDER BY donor_id, donation_dt, txn_id LIMIT 10)""",
)
def explore_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First deferred visits and first lapses of the report."""
    tables = report(spark, sf_dir)
    deferred = tables["deferred_head"].select(
        F.lit("deferred").alias("part"), "donor_id", "txn_id", F.lit(None).cast("bigint").alias("donate_times"), "fst_donation_age"
    )
    lapse = tables["lapse_preview"].select(F.lit("lapse"), "donor_id", "txn_id", "donate_times", "fst_donation_age")
    return deferred.union(lapse)
