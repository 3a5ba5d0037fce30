"""Visits enriched with person attributes, history features and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitwise.functions import features as X
from visitwise.operators.histories import Histories, Keys

PERSON_COLUMNS = ("birth_dt", "race", "gender", "zip5c")


def frequency(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Per person: visits, mean days between visits, active flag.

    One grouped aggregate with a map-side combine; no window, so a person holding a
    large share of the rows costs nothing extra.
    """
    day = F.col(keys.day)
    spans = df.groupBy(keys.person).agg(
        F.count(F.lit(1)).alias("donation_cnt"), F.min(day).alias("_first"), F.max(day).alias("_last")
    )
    return spans.withColumn(
        "avg_elapse", X.average_gap(F.col("donation_cnt"), F.col("_first"), F.col("_last"))
    ).withColumn("active", X.activity(F.col("avg_elapse"))).drop("_first", "_last")


def with_frequency(h: Histories) -> Histories:
    """Visit count, mean gap and active flag on each row, without a self-join."""
    h = h.span("donation_cnt", "_first", "_last")
    rows = h.rows.withColumn(
        "avg_elapse", X.average_gap(F.col("donation_cnt"), F.col("_first"), F.col("_last"))
    ).withColumn("active", X.activity(F.col("avg_elapse")))
    return h._with(rows.drop("_first", "_last"))


def project_persons(persons: DataFrame, keys: Keys = Keys(), extra: tuple[str, ...] = ()) -> DataFrame:
    """The person attributes used downstream, under the key name ``summary_id``."""
    return persons.select(F.col(keys.person).alias("summary_id"), *PERSON_COLUMNS, *extra)


def enrich(
    visits: DataFrame,
    persons: DataFrame,
    keys: Keys = Keys(),
    extra: tuple[str, ...] = (),
    per_slice: int | None = None,
) -> DataFrame:
    """The enriched visit table.

    Ordinal, gap, counts, activity and the person join all use one placement of the
    visits: one exchange of the visit table and one of the persons.
    """
    h = Histories.of(visits, keys, per_slice)
    h = h.number(ordinal="donation_order", gap="since_last_donation")
    h = with_frequency(h)
    h = h.attach(project_persons(persons, keys, extra).withColumnRenamed("summary_id", keys.person))
    day = F.col(keys.day)
    return h.frame().withColumns(
        {
            "since_last_donation": F.col("since_last_donation").cast("float"),
            "age_at_donation": X.age_years_365(day, F.col("birth_dt")),
            "donation_year": X.visit_year(day),
            "donation_month": X.visit_month(day),
            "donation_season": X.season(day),
            "site_zip3": X.zip3(F.col("site_zip")),
            "donor_zip3": X.zip3(F.col("zip5c")),
            "repeat_donor": X.is_repeat(F.col("donation_cnt")),
        }
    ).withColumn("age_bucket", X.age_bucket(F.col("age_at_donation")))
