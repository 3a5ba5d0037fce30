"""Scans, sinks and cleaning rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitwise.catalog import fixtures as T
from visitwise.catalog.registry import query
from visitwise.functions import text as X
from visitwise.operators.profiling import sort_lines
from visitwise.operators.words import lines_of, word_count
from visitwise.sources import extracts as E
from visitwise.sources.schema import load_fields, schema_table, struct_type
from visitwise.sources.workspace import new_path

PARTS = """,
parts AS (SELECT txn_id, value, string_split(rtrim(value, ','), ',') AS p FROM raw_lines),
tidy AS (
  SELECT txn_id, p, list_transform(p, lambda x:
           CASE WHEN lower(trim(x)) IN ('na', 'none', '') THEN NULL ELSE trim(x) END) AS t
  FROM parts WHERE len(p) = 6)
"""
CAPITAL = "upper(substring({0}, 1, 1)) || substring({0}, 2)"
TO_INT = "CASE WHEN regexp_matches({0}, '^[+-]?[0-9]+$') THEN TRY_CAST({0} AS INTEGER) END"
GEO = "TRY_CAST(CASE WHEN {0} <> '0' THEN {0} END AS FLOAT)"
TO_DAY = """CASE
  WHEN contains({0}, '-') THEN
    CASE WHEN regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$')
          AND CAST(string_split({0}, '-')[2] AS INTEGER) BETWEEN 1 AND 12
          AND CAST(string_split({0}, '-')[3] AS INTEGER) BETWEEN 1 AND 31
      THEN make_date(CAST(string_split({0}, '-')[1] AS INTEGER), CAST(string_split({0}, '-')[2] AS INTEGER), 1)
           + (CAST(string_split({0}, '-')[3] AS INTEGER) - 1) END
  WHEN regexp_matches({0}, '^[0-9]+/[0-9]+/[0-9]+') THEN
    CASE WHEN __Y__ BETWEEN 1 AND 9999 AND __M__ <= 119988 AND __D__ <= 3659634 THEN
      CASE WHEN year(__DATE__) BETWEEN 1 AND 9999 THEN __DATE__ END END
  END"""
# The numbers of a slashed date, and the date they roll over to.
for _name, _text in (
    ("__DATE__", "(CAST(make_date(__Y__, 1, 1) + to_months(__M__ - 1) AS DATE) + (__D__ - 1))"),
    *((f"__{n}__", f"TRY_CAST(regexp_extract({{0}}, '^([0-9]+)/([0-9]+)/([0-9]+)', {i}) AS INTEGER)")
      for i, n in enumerate("YMD", 1)),
):
    TO_DAY = TO_DAY.replace(_name, _text)
TYPED = (
    PARTS
    + f""",
typed AS (
  SELECT txn_id, {CAPITAL.format('t[1]')} AS donor_id, {TO_DAY.format('t[2]')} AS donation_dt,
         {TO_INT.format('t[3]')} AS n, CAST({GEO.format('t[4]')} AS DOUBLE) AS "Latitude",
         {CAPITAL.format('t[5]')} AS donation_type, {CAPITAL.format('t[6]')} AS "StateAbbr"
  FROM tidy)
"""
)


def tidied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn_id, p: raw fields, t: trimmed fields without null words; lines of the right arity."""
    parts = E.computed_once(T.raw_lines(spark, sf_dir), p=X.split_fields(F.col("value")))
    good = parts.where(F.size("p") == len(T.RAW_FIELDS)).select("txn_id", "p")
    return E.computed_once(good, t=X.tidy_fields(F.col("p")))


def field(column: str, i: int):
    return F.get(F.col(column), F.lit(i))


@query("ingest_split", PARTS + """SELECT txn_id, CAST(i - 1 AS INTEGER) AS pos, p[i] AS field
FROM (SELECT txn_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)""")
def ingest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.raw_lines(spark, sf_dir)
    return lines.select("txn_id", F.posexplode(X.split_fields(F.col("value"))).alias("pos", "field"))


@query("ingest_drop_header", "SELECT value FROM raw_lines")
def ingest_drop_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two headed extracts in one folder: the header line comes back in the middle."""
    lines = T.raw_lines(spark, sf_dir).select("value")
    header = spark.range(0, 1, 1, 1).select(F.lit(T.RAW_HEADER).alias("value"))
    path = new_path(spark, "headed")
    header.union(lines).union(header).write.text(path)
    return E.drop_header(E.read_lines(spark, path), E.header_line(spark, path))


@query("ingest_arity", TYPED + """SELECT txn_id, value, 'arity' AS reject_reason FROM parts WHERE len(p) <> 6
UNION ALL SELECT txn_id, value, 'missing donor_id' FROM typed JOIN raw_lines USING (txn_id) WHERE donor_id IS NULL""")
def ingest_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.clean(T.raw_lines(spark, sf_dir), T.RAW_FIELDS, ("donor_id",), keep=("txn_id",)).rejects


@query("ingest_clean", TYPED + "SELECT * FROM typed WHERE donor_id IS NOT NULL")
def ingest_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.clean(T.raw_lines(spark, sf_dir), T.RAW_FIELDS, ("donor_id",), keep=("txn_id",)).rows
    return rows.withColumn("Latitude", F.col("Latitude").cast("double"))


def fields_document(spark: SparkSession) -> str:
    path = new_path(spark, "schema")
    document = [([{"name": n, "type": t} for n, t in T.RAW_FIELDS],)]
    spark.createDataFrame(document, "fields array<struct<name: string, type: string>>").coalesce(1).write.json(path)
    return path


@query(
    "schema_fields",
    TYPED
    + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{n}' AS name, '{t}' AS type, '{s}' AS spark_type, count("{n}") AS filled
FROM typed"""
        for i, (n, t, s) in enumerate(
            (n, t, {"string": "string", "date": "date", "integer": "int", "float": "float"}[t])
            for n, t in T.RAW_FIELDS
        )
    ),
)
def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a schema document, and how many cleaned lines fill each."""
    path = fields_document(spark)
    fields = load_fields(spark, path)
    kinds = {f.name: f.dataType.simpleString() for f in struct_type(fields)}
    rows = E.clean(T.raw_lines(spark, sf_dir), fields).rows
    filled = rows.agg(
        F.array(
            *[
                F.struct(F.lit(n).alias("name"), F.lit(kinds[n]).alias("spark_type"), F.count(n).alias("filled"))
                for n, _ in fields
            ]
        ).alias("stats")
    ).select(F.inline("stats"))
    return schema_table(spark, path).join(filled, "name", "left").select(
        "position", "name", "type", "spark_type", "filled"
    )


@query("parquet_roundtrip", "SELECT * FROM visits")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "visits")
    E.write_parquet(T.visits(spark, sf_dir), path, "gzip")
    return E.read_parquet(spark, path, "part*.gz.parquet")


@query("csv_scan", "SELECT * FROM visits")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = T.visits(spark, sf_dir)
    path = new_path(spark, "visits-csv")
    E.write_csv(visits, path)
    return E.read_csv(spark, path, visits.schema)


@query(
    "csv_scan_latin1",
    "SELECT donor_id, 'Spéndér ' || race || ' ÄÖÜ ß ÿ' AS label, birth_dt FROM persons",
)
def csv_scan_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.persons(spark, sf_dir).select(
        "donor_id", F.concat(F.lit("Spéndér "), "race", F.lit(" ÄÖÜ ß ÿ")).alias("label"), "birth_dt"
    )
    path = new_path(spark, "latin1-csv")
    E.write_csv(rows, path, "ISO-8859-1")
    return E.read_csv(spark, path, rows.schema, "ISO-8859-1")


WORDS = """,
lines AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)
SELECT word, count(*) AS cnt FROM (
  SELECT unnest(string_split(rtrim(value, ' '), ' ')) AS word FROM lines
  WHERE NOT (value <> '' AND rtrim(value, ' ') = ''))
GROUP BY word"""


@query("word_count", WORDS)
def count_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_count(lines_of(T.table(spark, sf_dir, "documents"), "text"))


@query("word_count_files", WORDS)
def count_words_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a text sink and a text scan."""
    path = new_path(spark, "texts")
    T.table(spark, sf_dir, "documents").select("text").write.text(path)
    return word_count(E.read_lines(spark, path))


@query("sorted_lines", "SELECT txn_id, value FROM raw_lines ORDER BY value, txn_id")
def sorted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_lines(T.raw_lines(spark, sf_dir), "value", "txn_id")


@query(
    "clean_trim",
    PARTS
    + r"""SELECT txn_id, regexp_replace(chr(9) || p[1] || chr(10) || chr(1), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')
AS trimmed FROM tidy""",
)
def clean_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\t"), field("p", 0), F.lit("\n\x01"))
    return tidied(spark, sf_dir).select("txn_id", X.trim_blanks(padded).alias("trimmed"))


@query("clean_null_tokens", PARTS + """SELECT txn_id, t[1] AS donor_text, t[2] AS day_text, t[5] AS type_text
FROM tidy""")
def clean_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(spark, sf_dir).select(
        "txn_id",
        field("t", 0).alias("donor_text"),
        field("t", 1).alias("day_text"),
        field("t", 4).alias("type_text"),
    )


@query(
    "clean_capitalize",
    PARTS + f"""SELECT txn_id, {CAPITAL.format('t[1]')} AS donor_id, {CAPITAL.format('t[6]')} AS "StateAbbr",
t[6] AS state_abbr FROM tidy""",
)
def clean_capitalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``state_abbr`` is an abbreviation field and keeps its case; ``StateAbbr`` is not."""
    return tidied(spark, sf_dir).select(
        "txn_id",
        X.convert(field("t", 0), "donor_id", "string").alias("donor_id"),
        X.convert(field("t", 5), "StateAbbr", "string").alias("StateAbbr"),
        X.convert(field("t", 5), "state_abbr", "string").alias("state_abbr"),
    )


@query("clean_geo_zero", PARTS + f"""SELECT txn_id, CAST({GEO.format('t[4]')} AS DOUBLE) AS "Latitude" FROM tidy""")
def clean_geo_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = X.convert(field("t", 3), "Latitude", "float")
    return tidied(spark, sf_dir).select("txn_id", value.cast("double").alias("Latitude"))


@query("clean_int", PARTS + f"SELECT txn_id, t[3] AS raw, {TO_INT.format('t[3]')} AS n FROM tidy")
def clean_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(spark, sf_dir).select("txn_id", field("t", 2).alias("raw"), X.to_int(field("t", 2)).alias("n"))


@query(
    "clean_float",
    PARTS + "SELECT txn_id, t[4] AS raw, CAST(TRY_CAST(t[4] AS FLOAT) AS DOUBLE) AS x FROM tidy",
)
def clean_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = field("t", 3)
    return tidied(spark, sf_dir).select(
        "txn_id", value.alias("raw"), X.to_float(value).cast("double").alias("x")
    )


@query("clean_date", PARTS + f"SELECT txn_id, t[2] AS raw, {TO_DAY.format('t[2]')} AS donation_dt FROM tidy")
def clean_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = field("t", 1)
    return tidied(spark, sf_dir).select("txn_id", value.alias("raw"), X.to_day(value).alias("donation_dt"))
