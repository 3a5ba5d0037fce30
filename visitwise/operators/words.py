"""Word counts of text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitwise.functions.text import split_fields


def lines_of(df: DataFrame, text: str) -> DataFrame:
    """One row per line of a multi-line text column, as a text file scan would give."""
    return df.select(F.explode(F.split(text, "\n")).alias("value"))


def word_count(lines: DataFrame, line: str = "value") -> DataFrame:
    """(word, cnt): words are what single spaces separate; counts combine before the shuffle."""
    words = lines.select(F.explode(split_fields(F.col(line), " ")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
