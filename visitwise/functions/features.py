"""Features of a visit as built-in Column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (lowest, highest, label) of each group of whole numbers; None is open-ended.
SEASONS = [
    (3, 5, "Spring"),
    (6, 8, "Summer"),
    (9, 11, "Fall"),
    (12, 12, "Winter"),
    (1, 2, "Winter"),
]
AGE_BUCKETS = [
    (0, 0, "Unknown"),
    (16, 18, "High School"),
    (19, 22, "College"),
    (23, 25, "Post-College"),
    (26, 30, "late 20s"),
    (31, 40, "30s"),
    (41, None, "old"),
]
AGE_CATEGORIES = [
    (None, 17, "<18"),
    (18, 22, "18-22"),
    (23, 30, "23-30"),
    (31, 35, "31-35"),
    (36, None, ">35"),
]
VISIT_BUCKETS = [
    (1, 1, "One-Time"),
    (2, 5, "2-5"),
    (6, 10, "6-10"),
    (11, None, ">10"),
]
# How the two extracts write dates.
VISIT_DAY_FORMAT = "yyyy-M-d"
BIRTH_DAY_FORMAT = "yyyy/M/d"

# Labels outside the groups, and the limit of an active person.
OTHER_SEASON = "Unknown"
OTHER_BUCKET = "invalid"
INVALID_CODE = "invalid"
NOT_APPLICABLE, ACTIVE, INACTIVE = "Not Applicable", "1", "0"
ACTIVE_WITHIN_DAYS = 365

Groups = list[tuple[int | None, int | None, str]]


def label(number: Column, groups: Groups, other: str | None = None) -> Column:
    """Label of the group a whole number is in."""
    chain = F
    for low, high, name in groups:
        if low == high:
            inside = number == low
        elif low is None:
            inside = number <= high
        elif high is None:
            inside = number >= low
        else:
            inside = number.between(low, high)
        chain = chain.when(inside, name)
    return chain if other is None else chain.otherwise(other)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def age_years_365(visit_day: Column, birth_day: Column) -> Column:
    """Days lived / 365 as float; 0 where either date is missing."""
    return F.coalesce((days_between(visit_day, birth_day) / F.lit(365)).cast("float"), F.lit(0).cast("float"))


def age_calendar_years(visit_day: Column, birth_day: Column) -> Column:
    """Completed calendar years, null without both dates."""
    return (F.months_between(visit_day, birth_day) / 12).cast("int")


def visit_year(day: Column) -> Column:
    return F.year(day)


def visit_month(day: Column) -> Column:
    return F.month(day)


def season(day: Column) -> Column:
    return label(F.month(day), SEASONS, OTHER_SEASON)


def is_repeat(visits: Column) -> Column:
    return F.when(visits > 1, 1).otherwise(0)


def age_bucket(age: Column) -> Column:
    # Halves round up, also below zero.
    return label(F.floor(age + F.lit(0.5)), AGE_BUCKETS, OTHER_BUCKET)


def age_category(age: Column) -> Column:
    """Category of an age in whole years; null without an age."""
    return label(age, AGE_CATEGORIES)


def left_pad(value: Column, width: int = 5, fill: str = "0") -> Column:
    """Pad only; a longer value is kept whole."""
    return F.when(F.length(value) < width, F.lpad(value, width, fill)).otherwise(value)


def zip3(code: Column) -> Column:
    """First three digits of a code of up to five; longer or missing is ``invalid``."""
    return F.when(F.length(code) <= 5, F.substring(left_pad(code), 1, 3)).otherwise(INVALID_CODE)


def visits_bucket(visits: Column) -> Column:
    return label(visits, VISIT_BUCKETS, OTHER_BUCKET)


def average_gap(visits: Column, first_day: Column, last_day: Column) -> Column:
    """Mean days between successive visits, 0 for a single visit.

    The gaps of one person add up to last day minus first day, so no per-visit
    sum is needed.
    """
    span = F.coalesce(days_between(last_day, first_day), F.lit(0)).cast("double")
    return F.when(visits > 1, span / (visits - 1)).otherwise(F.lit(0.0))


def activity(avg_gap: Column) -> Column:
    """Whether visits follow each other within a year on average."""
    gap = avg_gap.cast("float")
    return (
        F.when(gap == 0, NOT_APPLICABLE).when(gap <= ACTIVE_WITHIN_DAYS, ACTIVE).when(gap > ACTIVE_WITHIN_DAYS, INACTIVE)
    )


def parse_day(value: Column, fmt: str) -> Column:
    """Strict parse of a date written as ``fmt``; bad text raises."""
    return F.to_date(value, fmt)
