"""The exploration report: shapes, missing values, ages, lapses, early returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitwise.functions import features as X
from visitwise.operators import lapses as L
from visitwise.operators import profiling as P
from visitwise.operators import slices as S
from visitwise.operators.histories import Keys
from visitwise.operators.names import fresh
from visitwise.sources.workspace import stage

YEAR_BINS = 300
CYCLE_BINS = 180


def merge_left(
    left: DataFrame,
    right: DataFrame,
    on: str,
    suffixes: tuple[str, str] = ("_x", "_y"),
    match_nulls: bool = True,
    per_slice: int | None = None,
) -> DataFrame:
    """Left merge with one key column; clashing names get suffixes.

    ``match_nulls`` lets a null key match a null key, which multiplies the null rows of both sides.

    The rows of a key that the left side holds more than ``per_slice`` times (null is a key like any other) are
    dealt over slices of that size, and the right side's rows of the key are repeated once per slice, so no
    task gets a hot key whole.
    """
    clash = (set(left.columns) & set(right.columns)) - {on}
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    key, slice_of, place, piece = fresh([*left.columns, *right.columns], "_on", "_of", "_place", "_piece")
    right = right.withColumnRenamed(on, key)
    same = F.col(on).eqNullSafe(F.col(key)) if match_nulls else F.col(on) == F.col(key)
    per_slice = per_slice or S.ROWS_PER_SLICE
    hot = S.hot_keys(left, on, per_slice)
    if hot is None:
        return left.join(right, same, "left").drop(key)
    cold, dealt = S.split(left, hot, on, per_slice=per_slice, name=piece)
    slices = stage(dealt.select(F.col(on).alias(slice_of), F.col(piece).alias(place)).distinct(), "merge-slices")
    repeated = right.join(slices, F.col(key).eqNullSafe(F.col(slice_of))).drop(slice_of)
    hot_part = dealt.join(repeated, same & (F.col(piece) == F.col(place)), "left").drop(key, place, piece)
    return cold.drop(piece).join(right, same, "left").drop(key).unionByName(hot_part)


def lapse_series(table: DataFrame, series: dict[str, Column], unit_days: int) -> DataFrame:
    """(series, x): the lapses of completed visits in units of ``unit_days``, once for each series whose
    condition the visit fulfils. The table is read once for all."""
    chosen = F.array(*[F.when(condition, F.lit(name)) for name, condition in series.items()])
    rows = table.where(F.col("donation_ind") == 1).select(F.explode(F.array_compact(chosen)).alias("series"), "lag_in_days")
    return rows.select("series", (F.col("lag_in_days") / F.lit(unit_days)).alias("x"))


def year_series() -> dict[str, Column]:
    """Lapses over all visit types: every lapse, and first to second visit."""
    return {"hist_lapse_years": L.nonzero(), "hist_lapse_years_1_2": L.first_to_second()}


def cycle_series() -> dict[str, Column]:
    """Lapses within one visit type."""
    return {
        "hist_cycles_all": L.nonzero(), "hist_cycles_1_2": L.first_to_second(), "hist_cycles_ge_2": L.from_second_on()
    }


def lapse_values(table: DataFrame) -> dict[str, DataFrame]:
    """Lapses in years over all visit types: every lapse, and first to second visit."""
    return {
        "lapse_years_all": L.lapses(table, L.nonzero(), L.DAYS_PER_YEAR, "years"),
        "lapse_years_1_2": L.lapses(table, L.first_to_second(), L.DAYS_PER_YEAR, "years"),
    }


def cycle_values(table: DataFrame) -> dict[str, DataFrame]:
    """Lapses in 56-day cycles within one visit type."""
    return {
        "lapse_cycles_all": L.lapses(table, L.nonzero(), L.DAYS_PER_CYCLE, "cycles"),
        "lapse_cycles_1_2": L.lapses(table, L.first_to_second(), L.DAYS_PER_CYCLE, "cycles"),
        "lapse_cycles_ge_2": L.lapses(table, L.from_second_on(), L.DAYS_PER_CYCLE, "cycles"),
    }


def explore(
    visits: DataFrame,
    persons: DataFrame,
    whole_type: str,
    keys: Keys = Keys(),
    type_col: str = "donation_type",
    missing_threshold: float = 0.7,
) -> dict[str, DataFrame]:
    """All tables of the report, by name.

    The merged table and the two lapse tables feed many results, so each is written once to the shared
    folder. A null person matches nobody. The early returns are rows of the lapse table of the type, and
    their persons' histories are rows of the merged lapse table, so persons are placed twice in all.
    """
    data = stage(merge_left(visits, persons, keys.person, match_nulls=False), "merged")
    of_type = F.col(type_col) == whole_type
    columns = [keys.person, keys.day, keys.tie, "donation_ind"]
    table = stage(L.lapse_table(data, keys), "lapse")
    typed = stage(L.lapse_table(data.where(of_type).select(*columns), keys), "lapse-of-type")
    years, cycles = lapse_values(table), cycle_values(typed)
    early = typed.where(L.early_return())
    ids = stage(early.select(keys.person).distinct(), "early-persons")
    returned = table.join(ids, keys.person, "left_semi")
    top = L.head_rows(returned, 8, keys)
    age = X.age_calendar_years(F.col(keys.day), F.col("birth_dt"))
    report = {
        "table_shape": P.table_shape(data),
        "missing_values": P.missing_report(data),
        "missing_below_threshold": P.missing_below(data, missing_threshold),
        "distinct_types": P.distinct_values(data, type_col),
        "deferred_head": L.deferred_head(data, 5, keys),
        "lapse_preview": L.lapse_preview(data, 10, keys),
        "early_returns": early,
        "early_return_ids": ids,
        "early_return_count": early.agg(F.count(F.lit(1)).alias("n")),
        "early_return_preview": top.withColumn("age_at_donation", age),
    }
    report |= years | cycles
    # One pass over either lapse table gives the histograms of all its series.
    for source, series, days, bins in (
        (table, year_series(), L.DAYS_PER_YEAR, YEAR_BINS),
        (typed, cycle_series(), L.DAYS_PER_CYCLE, CYCLE_BINS),
    ):
        bars = stage(P.histograms(lapse_series(source, series, days), "series", "x", bins), "histograms")
        for name in series:
            report[name] = bars.where(F.col("series") == name).drop("series")
    return report
