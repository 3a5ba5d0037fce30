"""Table access, the held-out split and word rules shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but the six ASCII white-space characters; bytes.split()
# without arguments splits UTF-8 by exactly this rule.
WORD = r"[^\x20\x09-\x0D]+"
HELD_OUT_REMAINDER = 2
# Bytes of one Arrow batch between a task and its Python worker.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that no model may learn from; a null id is never held out."""
    remainder = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))
    return F.coalesce(remainder == HELD_OUT_REMAINDER, F.lit(False))


def word_count(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_order(*columns: str, seed: int) -> Column:
    """A repeatable pseudo-random order of rows."""
    return F.xxhash64(F.lit(seed), *columns)


def map_batches(df: DataFrame, apply: Callable, schema: object) -> DataFrame:
    """``mapInArrow`` in batches of about ``BATCH_BYTES``, where 10,000 long texts would fill hundreds of MB.

    The session's limit is lowered if it is above that, and stays so, as the plan runs later.
    """
    spark = df.sparkSession
    # In any of the ways that Spark writes sizes.
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF))
    if limit > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(apply, schema)
