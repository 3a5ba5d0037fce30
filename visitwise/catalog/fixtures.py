"""Visit, person and raw-line tables derived from the order tables.

The select lists are SQL that means the same in Spark and in the SQL oracle;
``{text}`` and ``{birth}`` are the two places where the dialects differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE_TYPE = "1-URGENT"

SPARK = {
    "text": "STRING",
    "birth": "date_add(DATE'1940-01-01', CAST(c_custkey * 37 % 25000 AS INT))",
}
DUCKDB = {
    "text": "VARCHAR",
    "birth": "DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INTEGER)",
}

VISITS = """
SELECT CAST(o_custkey AS {text}) AS donor_id, CAST(o_orderdate AS DATE) AS donation_dt,
       o_orderkey AS txn_id, o_orderpriority AS donation_type,
       CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS donation_ind,
       CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS deferral_ind,
       CASE WHEN o_orderkey % 10 = 0 THEN 1 WHEN o_orderkey % 10 = 5 THEN NULL ELSE 0 END AS first_donat_ind,
       CAST(o_orderkey % 2 AS INT) AS walk_in_ind,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL
            WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey % 1000 AS {text})
            WHEN o_orderkey % 5 = 2 THEN '12345-6789'
            ELSE lpad(CAST(o_orderkey % 100000 AS {text}), 5, '0') END AS site_zip
FROM {orders}
"""

# Every 17th person has an id that no visit has, so both sides of the left join have unmatched rows.
PERSONS = """
SELECT CASE WHEN c_custkey % 17 = 0 THEN concat('none-', CAST(c_custkey AS {text}))
            ELSE CAST(c_custkey AS {text}) END AS donor_id,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE {birth} END AS birth_dt,
       c_mktsegment AS race, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CAST(c_custkey % 100000 AS {text}) AS zip5c, c_nationkey AS nation_key
FROM {customer}
"""

RAW_LINES = """
SELECT o_orderkey AS txn_id, concat_ws(',',
 CASE WHEN o_orderkey % 97 = 0 THEN ' NA ' ELSE concat(' d', CAST(o_custkey AS {text}), ' ') END,
 CASE WHEN o_orderkey % 101 = 1 THEN '2015/01/1234567' WHEN o_orderkey % 101 = 2 THEN '20150/01/01'
      WHEN o_orderkey % 101 = 3 THEN '2015/123456/01'
      WHEN o_orderkey % 11 = 0 THEN '2015-02-30' WHEN o_orderkey % 11 = 1 THEN '2015/13/45'
      WHEN o_orderkey % 11 = 2 THEN 'none' WHEN o_orderkey % 11 = 3 THEN '20150102'
      WHEN o_orderkey % 11 = 4 THEN '2015-01-02 10:00' WHEN o_orderkey % 11 = 5 THEN '2015/01/02 10:00'
      ELSE substring(CAST(o_orderdate AS {text}), 1, 10) END,
 CASE WHEN o_orderkey % 7 = 0 THEN '1.0' WHEN o_orderkey % 7 = 1 THEN 'x' ELSE CAST(o_orderkey % 100 AS {text}) END,
 CASE WHEN o_orderkey % 5 = 0 THEN '0' WHEN o_orderkey % 5 = 1 THEN '0.0'
      ELSE CAST(CAST(o_orderkey % 90 AS DOUBLE) + 0.5 AS {text}) END,
 CASE WHEN o_orderkey % 6 = 0 THEN 'none' ELSE lower(o_orderpriority) END,
 CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 13 = 1 THEN 'mA' ELSE lower(o_orderstatus) END) AS value
FROM {orders}
"""

# The schema of the raw lines, and their header.
RAW_FIELDS = [
    ("donor_id", "string"),
    ("donation_dt", "date"),
    ("n", "integer"),
    ("Latitude", "float"),
    ("donation_type", "string"),
    ("StateAbbr", "string"),
]
RAW_HEADER = ",".join(name for name, _ in RAW_FIELDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _from(spark: SparkSession, sf_dir: str, sql: str, **names: str) -> DataFrame:
    tables = {alias: table(spark, sf_dir, name) for alias, name in names.items()}
    filled = sql.format(**SPARK, **{a: "{" + a + "}" for a in names})
    return spark.sql(filled, **tables)


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, VISITS, orders="orders")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, PERSONS, customer="customer")


def persons_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with the nation name in the place of a state."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("StateAbbr")
    )
    return persons(spark, sf_dir).join(nation, "nation_key", "left").drop("nation_key")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, RAW_LINES, orders="orders")


def oracle_ctes() -> str:
    """The three tables as common table expressions for the oracle."""
    names = {"orders": "orders", "customer": "customer"}
    return (
        "WITH visits AS (" + VISITS.format(**DUCKDB, **names) + "),\n"
        "persons AS (" + PERSONS.format(**DUCKDB, **names) + "),\n"
        "raw_lines AS (" + RAW_LINES.format(**DUCKDB, **names) + ")"
    )
