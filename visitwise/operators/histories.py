"""Per-person visit histories: ordinals, gaps, totals and joins on the person.

All operators of one ``Histories`` object share one distribution of the rows, so a
chain of them costs one exchange of the table. Where a person is too big for a task
the distribution key is (person, slice) (see ``slices``), and each window result is
completed from the slice summaries, one row per slice.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitwise.functions import features as X
from visitwise.operators import slices as S
from visitwise.sources.workspace import stage


@dataclass(frozen=True)
class Keys:
    """Columns that identify the person, order the visits and break ties.

    (day, tie) must order a person's visits completely for repeatable results.
    """

    person: str = "donor_id"
    day: str = "donation_dt"
    tie: str = "txn_id"


def visit_order(keys: Keys) -> list[Column]:
    return [F.col(keys.day).asc_nulls_last(), F.col(keys.tie).asc_nulls_last()]


@dataclass(frozen=True)
class Histories:
    rows: DataFrame
    keys: Keys
    # Hot persons' rows with their slice, before any window. None = no hot person.
    base: DataFrame | None = None
    # Visits, first and last day of each slice, ready made; None once a join may have changed them.
    summary: DataFrame | None = None

    @classmethod
    def of(cls, df: DataFrame, keys: Keys = Keys(), per_slice: int | None = None) -> Histories:
        """Distribute by person; the rows of persons with more than ``per_slice`` visits by their slices."""
        per_slice = per_slice or S.ROWS_PER_SLICE
        hot = S.hot_keys(df, keys.person, per_slice)
        if hot is None:
            return cls(df, keys)
        cold, base = S.split(df, hot, keys.person, *visit_order(keys), per_slice=per_slice)
        day = F.col(keys.day)
        summary = base.groupBy(keys.person, S.SLICE).agg(
            F.count(F.lit(1)).alias("_n"), F.min(day).alias("_first"), F.max(day).alias("_last")
        )
        return cls(cold.unionByName(base), keys, base, stage(summary, "slices"))

    # -- windows -----------------------------------------------------------

    @property
    def _partition(self) -> list[str]:
        return [self.keys.person] if self.base is None else [self.keys.person, S.SLICE]

    @property
    def whole(self) -> Window:
        return Window.partitionBy(*self._partition)

    @property
    def ordered(self) -> Window:
        return self.whole.orderBy(*visit_order(self.keys))

    @property
    def before(self) -> Window:
        return self.ordered.rowsBetween(Window.unboundedPreceding, -1)

    def _with(self, rows: DataFrame) -> Histories:
        return replace(self, rows=rows)

    def frame(self) -> DataFrame:
        return self.rows.drop(S.SLICE)

    def _carry(self, **aggs: Column) -> DataFrame:
        """One row per slice of each hot person with the given aggregates."""
        return self.base.groupBy(self.keys.person, S.SLICE).agg(*[c.alias(n) for n, c in aggs.items()])

    def _slices(self) -> DataFrame:
        """Visits, first and last day per slice."""
        day = F.col(self.keys.day)
        if self.summary is not None:
            return self.summary
        return self._carry(_n=F.count(F.lit(1)), _first=F.min(day), _last=F.max(day))

    def _lookup(self, rows: DataFrame, small: DataFrame) -> DataFrame:
        """Attach the values of a table with one row per slice."""
        person = F.col(self.keys.person).eqNullSafe(F.col("_cp"))
        small = small.withColumnsRenamed({self.keys.person: "_cp", S.SLICE: "_cs"})
        return rows.join(small, person & (F.col(S.SLICE) == F.col("_cs")), "left").drop("_cp", "_cs")

    # -- operators ---------------------------------------------------------

    def number(self, ordinal: str | None = None, gap: str | None = None, only: Column | None = None) -> Histories:
        """Visit ordinal (1, 2, ...) and whole days since the previous visit (first: 0).

        With ``only``, the visits that fail the condition are passed over: they get
        nulls and do not count as anyone's previous visit. Ordinals are 64-bit, as one
        person's visits may be more than an int counts.
        """
        day = F.col(self.keys.day)
        counted = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
        if only is None:
            ordinal_here, previous = F.row_number().over(self.ordered).cast("long"), F.lag(day).over(self.ordered)
        else:
            running = self.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ordinal_here = F.count_if(counted).over(running)
            previous = F.last(F.when(counted, day), ignorenulls=True).over(self.before)
        rows = self.rows.withColumns({"_ordinal": ordinal_here, "_previous": previous})
        ordinal_value, previous_value = F.col("_ordinal"), F.col("_previous")
        if self.base is not None:
            earlier = Window.partitionBy(self.keys.person).orderBy(S.SLICE).rowsBetween(Window.unboundedPreceding, -1)
            if only is None:
                carry = self._slices()
            else:
                carry = self._carry(_n=F.count_if(counted), _last=F.max(F.when(counted, day)))
            carry = carry.select(
                self.keys.person,
                S.SLICE,
                F.sum("_n").over(earlier).alias("_carry_n"),
                F.max("_last").over(earlier).alias("_carry_day"),
            )
            rows = self._lookup(rows, carry)
            ordinal_value = ordinal_value + F.coalesce("_carry_n", F.lit(0))
            previous_value = F.coalesce(previous_value, "_carry_day")
        out = {}
        if ordinal:
            out[ordinal] = ordinal_value
        if gap:
            out[gap] = F.coalesce(X.days_between(day, previous_value), F.lit(0))
        if only is not None:
            out = {name: F.when(counted, value) for name, value in out.items()}
        return self._with(rows.withColumns(out).drop("_ordinal", "_previous", "_carry_n", "_carry_day"))

    def span(self, count: str, first: str | None = None, last: str | None = None) -> Histories:
        """The person's number of visits, first and last day on each of the person's rows."""
        day = F.col(self.keys.day)
        # name: (over the rows of a placement, over its slices)
        totals = {count: (F.count(F.lit(1)), F.sum("_n"))}
        if first:
            totals[first] = (F.min(day), F.min("_first"))
        if last:
            totals[last] = (F.max(day), F.max("_last"))
        here = {f"_here_{n}": agg.over(self.whole) for n, (agg, _) in totals.items()}
        rows = self.rows.withColumns(here)
        if self.base is None:
            return self._with(rows.withColumnsRenamed({f"_here_{n}": n for n in totals}))
        everything = Window.partitionBy(self.keys.person)
        carry = self._slices().select(
            self.keys.person, S.SLICE, *[agg.over(everything).alias(f"_all_{n}") for n, (_, agg) in totals.items()]
        )
        hot = F.col(S.SLICE) > 0
        merged = {n: F.when(hot, F.col(f"_all_{n}")).otherwise(F.col(f"_here_{n}")) for n in totals}
        rows = self._lookup(rows, carry).withColumns(merged)
        return self._with(rows.drop(*here, *[f"_all_{n}" for n in totals]))

    def visits(self, name: str) -> Histories:
        return self.span(name)

    def carry_first(self, value: str, name: str, seen: str) -> Histories:
        """First non-null ``value`` of the person so far, and whether an earlier row had one."""
        running = self.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.rows.withColumns(
            {
                name: F.first(value, ignorenulls=True).over(running),
                seen: F.coalesce(F.first(value, ignorenulls=True).over(self.before).isNotNull(), F.lit(False)),
            }
        )
        if self.base is not None:
            key = S.order_key(self.keys.day, self.keys.tie)
            has = F.col(value).isNotNull()
            earlier = Window.partitionBy(self.keys.person).orderBy(S.SLICE).rowsBetween(Window.unboundedPreceding, -1)
            carry = self._carry(_v=F.min_by(value, F.when(has, key))).select(
                self.keys.person, S.SLICE, F.first("_v", ignorenulls=True).over(earlier).alias("_carry_v")
            )
            rows = self._lookup(rows, carry).withColumns(
                {
                    name: F.coalesce("_carry_v", name),
                    seen: F.col(seen) | F.col("_carry_v").isNotNull(),
                }
            ).drop("_carry_v")
        return self._with(rows)

    def derive(self, **columns: Column) -> Histories:
        """Row-wise columns; they can be summarised by later operators."""
        base = None if self.base is None else self.base.withColumns(columns)
        return replace(self, rows=self.rows.withColumns(columns), base=base)

    def attach(self, other: DataFrame, how: str = "left") -> Histories:
        """Join a table keyed by the person column; ``how`` is left, inner, left_semi or left_anti.

        A hot person's entry is repeated once per slice, so its visits are matched by
        as many tasks as it has slices.
        """
        key = self.keys.person
        if self.base is None:
            return self._with(self.rows.join(other, key, how))
        slices = self._slices().select(F.col(key).alias("_sp"), S.SLICE)
        placed = other.join(slices, F.col(key).eqNullSafe(F.col("_sp")), "left").drop("_sp")
        placed = placed.withColumn(S.SLICE, F.coalesce(S.SLICE, F.lit(0).cast("long")))
        base = self.base.join(placed, [key, S.SLICE], how)
        # Semi and anti joins keep or drop whole persons, which leaves the slice summaries right.
        summary = self.summary if how in ("left_semi", "left_anti") else None
        return Histories(self.rows.join(placed, [key, S.SLICE], how), self.keys, base, summary)

    def persons_with(self, flag: Column) -> Histories:
        """Keep every row of the persons that have at least one flagged row."""
        rows = self.rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
        keep = F.max("_flag").over(self.whole)
        if self.base is None:
            return self._with(rows.withColumn("_keep", keep).where("_keep").drop("_flag", "_keep"))
        key = self.keys.person
        # At most one entry per hot person.
        flagged = rows.where((F.col(S.SLICE) > 0) & F.col("_flag")).select(F.col(key).alias("_fp")).distinct()
        rows = rows.withColumn("_keep", keep)
        rows = rows.join(flagged, F.col(key).eqNullSafe(F.col("_fp")), "left")
        return self._with(rows.where(F.col("_keep") | F.col("_fp").isNotNull()).drop("_flag", "_keep", "_fp"))
