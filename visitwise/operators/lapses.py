"""Time between visits, ages at visits, early returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitwise.functions import features as X
from visitwise.operators.histories import Histories, Keys
from visitwise.operators.slices import order_key
from visitwise.sources.workspace import stage

DAYS_PER_YEAR = 365
DAYS_PER_CYCLE = 56


def repeat_indicator(h: Histories, name: str = "repeat_donor_ind") -> Histories:
    h = h.visits("_visits")
    return h._with(h.rows.withColumn(name, X.is_repeat(F.col("_visits"))).drop("_visits"))


def with_lapse(h: Histories, only: Column | None = None) -> Histories:
    """``donate_times`` and ``lag_in_days``."""
    return h.number(ordinal="donate_times", gap="lag_in_days", only=only)


def lapse_table(df: DataFrame, keys: Keys = Keys(), per_slice: int | None = None) -> DataFrame:
    return repeat_indicator(with_lapse(Histories.of(df, keys, per_slice))).frame()


def lapses(table: DataFrame, condition: Column, unit_days: int, name: str) -> DataFrame:
    """Lapses of completed visits in units of ``unit_days`` (365: years, 56: cycles)."""
    return table.where(condition & (F.col("donation_ind") == 1)).select(
        (F.col("lag_in_days") / F.lit(unit_days)).alias(name)
    )


def nonzero() -> Column:
    return F.col("lag_in_days") != 0


def first_to_second() -> Column:
    return F.col("donate_times") == 2


def from_second_on() -> Column:
    return F.col("donate_times") >= 2


def early_return(days: int = DAYS_PER_CYCLE) -> Column:
    return (F.col("lag_in_days") < days) & (F.col("lag_in_days") != 0)


def early_return_visits(
    df: DataFrame, of_type: Column, keys: Keys = Keys(), days: int = DAYS_PER_CYCLE, per_slice: int | None = None
) -> DataFrame:
    """Visits of one type that came within ``days`` of the previous visit of that type."""
    return with_lapse(Histories.of(df.where(of_type), keys, per_slice)).frame().where(early_return(days))


def early_return_histories(
    df: DataFrame, of_type: Column, keys: Keys = Keys(), days: int = DAYS_PER_CYCLE, per_slice: int | None = None
) -> DataFrame:
    """All visits, with their lapses over all types, of the persons with an early return.

    Both lapses and the person test are windows over the same placement, so the table
    is exchanged once and no id list is built.
    """
    h = with_lapse(Histories.of(df, keys, per_slice))
    h = h.number(gap="_type_gap", only=of_type)
    early = (F.col("_type_gap") < days) & (F.col("_type_gap") != 0)
    return h.persons_with(early).frame().drop("_type_gap")


def with_ages(h: Histories, birth: str = "birth_dt", first_ind: str = "first_donat_ind") -> Histories:
    """Age at each visit and at the first known visit, each with its category.

    Rows without a birth date get nulls. Where the row is not the person's first with
    a birth date and says it is not a first visit, the age of that first row is
    carried; every other row carries its own.
    """
    day = F.col(h.keys.day)
    h = h.derive(age_at_donation=X.age_calendar_years(day, F.col(birth)))
    h = h.carry_first("age_at_donation", "_first_age", "_seen")
    own = F.col("age_at_donation")
    carried = F.col("_seen") & F.col(first_ind).eqNullSafe(0)
    first_age = F.when(own.isNull(), None).when(carried, F.col("_first_age")).otherwise(own)
    rows = h.rows.withColumn("fst_donation_age", first_age).withColumns(
        {
            "age_at_donation_cat": X.age_category(own),
            "fst_donation_age_cat": X.age_category(F.col("fst_donation_age")),
        }
    )
    return h._with(rows.drop("_first_age", "_seen"))


def preview(
    df: DataFrame,
    n: int,
    build: Callable[[Histories], Histories],
    keys: Keys = Keys(),
    where: Column | None = None,
    per_slice: int | None = None,
) -> DataFrame:
    """First n rows, in person and visit order, of the table that ``build`` makes.

    A row's history values depend on its own person only, and ``where`` on input
    columns, so the persons of the first n rows (at most n ids) are found by a top-n
    over the whole table, and windows run over their rows alone.
    """
    where = F.lit(True) if where is None else where
    top = head_rows(df.where(where), n, keys).select(F.col(keys.person).alias("_top")).distinct()
    # At most n ids, written out so that the top-n runs once; then one read of these persons' rows.
    top = stage(top, "preview-persons")
    rows = df.join(F.broadcast(top), F.col(keys.person).eqNullSafe(F.col("_top")), "left_semi")
    return head_rows(build(Histories.of(rows, keys, per_slice)).frame().where(where), n, keys)


def lapse_preview(df: DataFrame, n: int = 10, keys: Keys = Keys(), birth: str = "birth_dt") -> DataFrame:
    return preview(df, n, lambda h: repeat_indicator(with_lapse(with_ages(h, birth))), keys)


def deferred_head(df: DataFrame, n: int = 5, keys: Keys = Keys(), birth: str = "birth_dt") -> DataFrame:
    """First deferred visits, with ages."""
    return preview(df, n, lambda h: with_ages(h, birth), keys, F.col("deferral_ind") == 1)


def head_rows(df: DataFrame, n: int, keys: Keys) -> DataFrame:
    return df.orderBy(keys.person, order_key(keys.day, keys.tie)).limit(n)


def with_calendar_age(df: DataFrame, births: DataFrame, keys: Keys = Keys(), birth: str = "birth_dt") -> DataFrame:
    """Age in calendar years from a table of birth dates."""
    age = X.age_calendar_years(F.col(keys.day), F.col(birth))
    return df.join(births, keys.person, "left").withColumn("age_at_donation", age)
