"""From two delimited extracts to the enriched visit table on Parquet."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from visitwise.operators.histories import Keys
from visitwise.operators.sampling import check_fraction, chosen, sample_persons
from visitwise.plans.enrich import enrich
from visitwise.sources import extracts as E
from visitwise.sources.schema import Fields, load_fields
from visitwise.sources.workspace import stage

TIE = "_tie"


@dataclass(frozen=True)
class Outputs:
    data: str
    rejects: str | None


def load_extract(
    spark: SparkSession,
    path: str,
    fields: Fields,
    person: str,
    mode: str = "reject",
    strict_dates: bool = False,
    fraction: float = 1.0,
    seed: int = 0,
) -> E.Cleaned:
    """Scan, drop headers, clean; visits of one person and day keep the text order of their lines.

    The extract is parsed once into a staged table, which rows and rejects are then read from by column.
    A sample depends on the person only, so the rows of other persons are gone before anything is written;
    rejects are all kept. The row's place joins the line as tie, so the order is total even among copies of one line.
    """
    lines = E.drop_header(E.read_lines(spark, path), E.header_line(spark, path))
    marked = E.mark(lines, fields, (person,), mode, strict_dates)
    if fraction < 1:
        marked = marked.where(F.col(E.REASON).isNotNull() | chosen(F.col(person), fraction, seed))
    marked = stage(marked, "cleaned", row_id="_row").withColumn(TIE, F.struct(E.LINE, "_row")).drop("_row")
    return E.parted(marked, fields, keep=(TIE,))


def preprocess(
    spark: SparkSession,
    visits_path: str,
    persons_path: str,
    schema_folder: str,
    output_folder: str,
    fraction: float = 1.0,
    seed: int = 0,
    person: str = "donor_id",
    day: str = "donation_dt",
    since_year: int = 2000,
    mode: str = "reject",
    strict_dates: bool = False,
    extra: tuple[str, ...] = (),
    visits_schema: str = "states_schema.json",
    persons_schema: str = "summary_schema.json",
    keep_rejects: bool = True,
) -> Outputs:
    """Run the whole job and return where the results are."""
    check_fraction(fraction)
    run_time = int(time.time() * 1000)
    folder = schema_folder.rstrip("/")
    visit_fields = load_fields(spark, f"{folder}/{visits_schema}")
    person_fields = load_fields(spark, f"{folder}/{persons_schema}")

    how = (person, mode, strict_dates, fraction, seed)
    visits = load_extract(spark, visits_path, visit_fields, *how)
    persons = load_extract(spark, persons_path, person_fields, *how)
    keys = Keys(person, day, TIE)

    rows = sample_persons(visits.rows, fraction, seed, keys, since_year)
    result = enrich(rows, persons.rows.drop(TIE), keys, extra).drop(TIE)

    target = E.output_name(output_folder, run_time, fraction, seed)
    E.write_parquet(result, target)
    if not keep_rejects:
        return Outputs(target, None)
    rejects = visits.rejects.drop(TIE).withColumn("extract", F.lit("visits")).unionByName(
        persons.rejects.drop(TIE).withColumn("extract", F.lit("persons"))
    )
    E.write_parquet(rejects, f"{target}_rejects")
    return Outputs(target, f"{target}_rejects")
