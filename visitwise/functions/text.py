"""Typed cleaning of delimited text: one Column expression per rule.

Every rule maps a value it cannot convert to null; none fails a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean "missing", and the fields where 0 means "not located".
NULL_WORDS = ("na", "none", "")
ZERO_IS_MISSING = ("Latitude", "Longitude")

# All characters up to U+0020 count as blank.
BLANKS = "".join(map(chr, range(0x21)))

NON_FINITE_SPELLINGS = ("inf", "+inf", "-inf", "nan", "infinity", "+infinity", "-infinity")
NON_FINITE_ACCEPTED = ("NaN", "Infinity", "+Infinity", "-Infinity")


def split_fields(line: Column, sep: str = ",") -> Column:
    """Unquoted split; empty fields at the end of the line are not counted."""
    body = F.rtrim(line, F.lit(sep))
    only_separators = (body == "") & (line != "")
    return F.when(only_separators, F.array().cast("array<string>")).otherwise(
        F.split(body, f"[{sep}]" if sep in r".$|()[{^?*+\\" else sep)
    )


def has_controls(line: Column) -> Column:
    return line.rlike(r"[\x00-\x1f]")


def trim_blanks(value: Column, controls: Column | None = None) -> Column:
    """Trim every character up to U+0020 at both ends.

    ``controls`` tells, once per line, whether there are control characters at all;
    without any, the much faster trim of spaces does the same.
    """
    every = F.btrim(value, F.lit(BLANKS))
    return every if controls is None else F.when(controls, every).otherwise(F.trim(value))


def null_words(value: Column, words: tuple[str, ...] = NULL_WORDS) -> Column:
    """Null where the text is one of the words in any case; longer text is not even lower-cased."""
    longest = max(len(w.encode()) for w in words)
    return F.when((F.octet_length(value) > longest) | ~F.lower(value).isin(*words), value)


def tidy_fields(fields: Column) -> Column:
    """Trim and null-word rules over a whole field array at once."""
    return F.transform(F.transform(fields, lambda x: trim_blanks(x)), lambda x: null_words(x))


def capitalize(value: Column) -> Column:
    """Upper-case the first letter, leave the rest."""
    first = F.substring(value, 1, 1)
    upper = F.upper(first)
    # Letters whose upper-case form is more than one character stay as they are.
    head = F.when(F.length(upper) == 1, upper).otherwise(first)
    return F.concat(head, F.substring(value, 2, 2147483647))


def keeps_case(field: str) -> bool:
    """Fields named as abbreviations (lower-case ``abbr``) are trimmed only."""
    return "abbr" in field


def to_int(value: Column) -> Column:
    return F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("int"))


def to_float(value: Column) -> Column:
    refused = F.lower(value).isin(*NON_FINITE_SPELLINGS) & ~value.isin(*NON_FINITE_ACCEPTED)
    return F.when(~refused, value.try_cast("float"))


def to_bool(value: Column) -> Column:
    return value.try_cast("boolean")


def zero_is_missing(value: Column) -> Column:
    return F.when(value != "0", value)


def _dashed(value: Column, strict: bool) -> Column:
    """``yyyy-[m]m-[d]d``, whole text; days 29-31 past the month's end roll over."""
    shape = r"^(?!0000)[0-9]{4}-(0?[1-9]|1[0-2])-(0?[1-9]|[12][0-9]|3[01])$"
    exact = value.try_cast("date")
    if strict:
        return F.when(value.rlike(shape), exact)
    month_start = F.concat(F.substring_index(value, "-", 2), F.lit("-1")).try_cast("date")
    rolled = F.date_add(month_start, F.substring_index(value, "-", -1).try_cast("int") - 1)
    return F.when(value.rlike(shape), F.coalesce(exact, rolled))


def _slashed(value: Column, strict: bool) -> Column:
    """Lenient ``yyyy/MM/dd`` prefix; months and days out of range roll over.

    Every digit of a number counts. A date outside the years 1 to 9999 is null.
    """
    prefix = r"^[ \t]*([0-9]+)/[ \t]*([0-9]+)/[ \t]*([0-9]+)"
    names = ("year", "month", "day")
    numbers = F.struct(*[F.regexp_extract(value, prefix, i).try_cast("int").alias(n) for i, n in enumerate(names, 1)])

    def rolled(part: Column) -> Column:
        year, month, day = (part[n] for n in names)
        start = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
        # Beyond these bounds the sum could only lie outside the years 1 to 9999.
        bounded = (year >= 1) & (year <= 9999) & (month <= 12 * 9999) & (day <= 366 * 9999)
        return F.struct(F.when(bounded, F.date_add(start, day - 1)).alias("date"), *[part[n].alias(n) for n in names])

    def valid(part: Column) -> Column:
        fits = F.year(part["date"]).between(1, 9999)
        if strict:
            fits = fits & (F.month(part["date"]) == part["month"]) & (F.dayofmonth(part["date"]) == part["day"])
        return F.when(fits, part["date"])

    # One-element arrays name the steps, so no step's expression is copied into the next.
    return F.get(F.transform(F.transform(F.array(numbers), rolled), valid), F.lit(0))


def to_day(value: Column, strict: bool = False) -> Column:
    """Date from either written form, quotes ignored; ``strict`` refuses rollover."""
    bare = F.replace(value, F.lit('"'), F.lit(""))
    return F.when(value.contains("-"), _dashed(bare, strict)).when(value.contains("/"), _slashed(bare, strict))


def convert(value: Column, field: str, dtype: str, strict_dates: bool = False) -> Column:
    """The typed expression of one schema field over its tidied text."""
    if dtype == "string":
        return value if keeps_case(field) else capitalize(value)
    if field in ZERO_IS_MISSING:
        value = zero_is_missing(value)
    if dtype == "integer":
        return to_int(value)
    if dtype == "float":
        return to_float(value)
    if dtype == "date":
        return to_day(value, strict_dates)
    if dtype == "boolean":
        return to_bool(value)
    raise ValueError(f"field {field!r}: unknown type {dtype!r}")
