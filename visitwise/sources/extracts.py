"""Readers and writers of delimited, text and Parquet extracts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitwise.functions import text as X
from visitwise.sources.schema import Fields, check

LINE = "value"
REASON = "reject_reason"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def header_line(spark: SparkSession, path: str) -> str | None:
    """First line of the file with the lowest name that is not empty.

    The files are listed as a table whose contents are not read; only one path and one line
    reach the driver.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    lowest = files.where("length > 0").orderBy("path").first()
    if lowest is None:
        return None
    literal = re.sub(r"([{}\[\]*?\\])", r"\\\1", lowest["path"])
    return spark.read.text(literal).first()[LINE]


def drop_header(lines: DataFrame, header: str | None, line: str = LINE) -> DataFrame:
    """Drop every line equal to the header, so extracts with repeated headers can be concatenated."""
    return lines if header is None else lines.where(F.col(line) != header)


@dataclass(frozen=True)
class Cleaned:
    """Outcome of cleaning: typed rows, and lines that were turned away with the reason."""

    rows: DataFrame
    rejects: DataFrame


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    The optimizer neither pushes a filter on these columns below the generator nor
    copies their expressions into later ones, so a line is split and tidied once
    however many typed columns and filters read the result.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def typed_columns(fields: Fields, strict_dates: bool = False) -> dict[str, Column]:
    return {name: X.convert(F.col(f"_t_f{i}"), name, word, strict_dates) for i, (name, word) in enumerate(fields)}


def mark(
    lines: DataFrame,
    fields: Fields,
    required: tuple[str, ...] = (),
    mode: str = "reject",
    strict_dates: bool = False,
    line: str = LINE,
) -> DataFrame:
    """Input columns, typed columns and ``reject_reason`` (null for a good row) in one narrow pass."""
    check(fields)
    arity_ok = F.size("_parts") == len(fields)
    if mode == "failfast":
        message = F.concat(F.lit(f"expected {len(fields)} fields, found "), F.size("_parts").cast("string"))
        arity_ok = F.when(arity_ok, True).otherwise(F.raise_error(message).cast("boolean"))
    elif mode != "reject":
        raise ValueError(f"unknown mode {mode!r}: use 'reject' or 'failfast'")
    missing = F.lit(None).cast("string")
    for name in required:
        missing = F.coalesce(missing, F.when(F.col(name).isNull(), f"missing {name}"))
    parts = computed_once(
        lines, _parts=X.split_fields(F.col(line)), _controls=X.has_controls(F.col(line))
    ).withColumn("_ok", arity_ok)
    names = [f"_f{i}" for i in range(len(fields))]
    trimmed = computed_once(
        parts,
        _arity=F.col("_ok"),
        **{
            n: X.trim_blanks(F.when(F.col("_ok"), F.get("_parts", F.lit(i))), F.col("_controls"))
            for i, n in enumerate(names)
        },
    ).drop("_parts", "_controls", "_ok")
    tidied = computed_once(trimmed, **{"_t" + n: X.null_words(F.col(n)) for n in names}).drop(*names)
    return (
        tidied.withColumns(typed_columns(fields, strict_dates))
        .withColumn(REASON, F.when(~F.col("_arity"), "arity").otherwise(missing))
        .drop("_arity", *["_t" + n for n in names])
    )


def clean(
    lines: DataFrame,
    fields: Fields,
    required: tuple[str, ...] = (),
    mode: str = "reject",
    strict_dates: bool = False,
    line: str = LINE,
    keep: tuple[str, ...] = (),
) -> Cleaned:
    """Typed rows and rejects; ``keep`` names input columns to carry along."""
    return parted(mark(lines, fields, required, mode, strict_dates, line), fields, line, keep)


def parted(marked: DataFrame, fields: Fields, line: str = LINE, keep: tuple[str, ...] = ()) -> Cleaned:
    """The good rows and the rejects of a marked table."""
    names = [name for name, _ in fields]
    return Cleaned(
        rows=marked.where(F.col(REASON).isNull()).select(*keep, *names),
        rejects=marked.where(F.col(REASON).isNotNull()).select(*dict.fromkeys((*keep, line, REASON))),
    )


def register_views(**tables: DataFrame) -> None:
    """Name tables for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """CSV with a header; give ``schema`` to save the extra pass that infers one."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    df.write.option("header", True).option("encoding", encoding).csv(path)


def read_parquet(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    return spark.read.option("pathGlobFilter", glob).parquet(path)


def write_parquet(df: DataFrame, path: str, compression: str | None = None) -> None:
    writer = df.write.mode("errorifexists")
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)


def output_name(folder: str, run_time: int, fraction: float, seed: int) -> str:
    """Sink path that tells the run time and, for a sample, its fraction and seed."""
    tail = f"{fraction}_{seed}_sample_data" if fraction < 1 else "_all_visits"
    return f"{folder.rstrip('/')}/{run_time}{tail}"
