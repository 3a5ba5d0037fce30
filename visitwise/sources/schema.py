"""Schema documents ``{"fields": [{"name": ..., "type": ...}, ...]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type words of a schema document.
TYPE_WORDS = {
    "integer": T.IntegerType(),
    "float": T.FloatType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
}

DOCUMENT = T.StructType(
    [
        T.StructField(
            "fields",
            T.ArrayType(
                T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
            ),
        )
    ]
)

Fields = list[tuple[str, str]]


def schema_table(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, type) of each field, in document order."""
    document = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    return document.select(F.posexplode("fields").alias("position", "field")).select(
        "position", "field.name", "field.type"
    )


def load_fields(spark: SparkSession, path: str) -> Fields:
    """The (name, type) list of a schema document; one row per column reaches the driver."""
    rows = schema_table(spark, path).orderBy("position").collect()
    fields = [(r["name"], r["type"]) for r in rows if r["name"] is not None and r["type"] is not None]
    check(fields)
    return fields


def check(fields: Fields) -> None:
    unknown = sorted({t for _, t in fields} - set(TYPE_WORDS))
    if unknown:
        raise ValueError(f"unknown type words in schema: {unknown}")


def struct_type(fields: Fields) -> T.StructType:
    check(fields)
    return T.StructType([T.StructField(name, TYPE_WORDS[word], True) for name, word in fields])
