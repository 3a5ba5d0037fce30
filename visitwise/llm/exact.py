"""Exact duplicates by a content sort.

Splitters drawn from a sample range-partition the rows by their normalised bytes, an external sort
in every partition places equal texts next to each other, and each row is compared in full with
the row before it. A run of equal rows is one group, of which the row with the largest id stays
(or the smallest, see ``keep``).

A splitter must be small, so the bytes are ordered by their first ``PREFIX_BYTES``, then by their
SHA-256 digest, then in full: equal texts have equal keys, and the range partitioning of prefix and
digest serves every window and aggregate here, so whole texts are exchanged once.

A text whose copies hold more than ``slice_bytes`` is dealt over slices by a hash of the row's id.
Each slice is sorted and compared on its own; then one row per run of a slice, the head, is sorted
and compared with the heads of the text's other slices, which completes the group. Which digests
are that heavy comes from one aggregate with a map-side combine over the digests alone; a digest
that two texts share costs a slice more and changes no result.

Defined results: a null text equals an empty one. A null id is smaller than every other one, and
``keep_id`` is null where it stays. Of rows that agree in text and id one is kept.
Rows with a null id cannot be told apart, so they stay in one slice. An empty table gives no rows.
Other columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitwise.llm.common import table
from visitwise.llm.registry import query
from visitwise.sources.workspace import stage

PREFIX_BYTES = 16
SLICE_BYTES = 64 * 1024 * 1024
# A run of short copies is cut by its rows: this many bytes are counted for each beside its text.
ROW_BYTES = 64

# One text's rows in one slice; ``run`` tells texts of equal digest apart.
PLACE = ["_prefix", "_sha", "_slice"]
RUN = [*PLACE, "_run"]


def normalised(text: str = "text") -> Column:
    """What is compared: the text as it is, a null as an empty one."""
    return F.coalesce(F.col(text), F.lit(""))


def sliced(rows: DataFrame, slice_bytes: int) -> DataFrame:
    """Add ``_slice``: 0 for ordinary texts, 1.. for those with too many bytes of copies for one task."""
    held = rows.groupBy(F.col("_sha").alias("_heavy")).agg(F.sum(F.octet_length("_text") + ROW_BYTES).alias("_held"))
    heavy = held.where(F.col("_held") > slice_bytes).select(
        "_heavy", F.ceil(F.col("_held") / slice_bytes).cast("int").alias("_slices")
    )
    # A table of its known size: Spark broadcasts it below its limit and sorts both sides beyond.
    found = rows.join(stage(heavy, "heavy-digests"), F.col("_sha") == F.col("_heavy"), "left")
    dealt = F.pmod(F.xxhash64("_id"), F.col("_slices")).cast("int") + 1
    return found.withColumn("_slice", F.coalesce(dealt, F.lit(0))).drop("_heavy", "_slices")


def neighbours_compared(rows: DataFrame, place: list[str], order: list[Column], name: str) -> DataFrame:
    """Sort a place's rows by their bytes, then by ``order``, and compare each with the one before it.

    Adds ``_unlike`` (the first row of a run of equal texts), ``_run`` (its number in the place) and
    ``_first``, the struct of the run's first row held by the column ``name``.
    """
    ordered = Window.partitionBy(*place).orderBy("_text", *order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_unlike", ~F.col("_text").eqNullSafe(F.lag("_text").over(ordered)))
    return rows.withColumns(
        {
            "_run": F.sum(F.col("_unlike").cast("int")).over(so_far),
            "_first": F.last(F.when(F.col("_unlike"), F.struct(name)), ignorenulls=True).over(so_far),
        }
    )


def preferred(name: str, keep: str) -> Column:
    return F.col(name).desc_nulls_last() if keep == "largest" else F.col(name).asc_nulls_first()


def content_sort(rows: DataFrame, keep: str, slice_bytes: int) -> DataFrame:
    """Rows of (_id, _text) with place and run, whether they come first in it, its best id and number of rows.

    ``_head`` is the text where the row is the first of a run in a slice, else null.
    """
    keyed = rows.withColumns(
        {
            "_prefix": F.substring(F.col("_text").cast("binary"), 1, PREFIX_BYTES),
            "_sha": F.unhex(F.sha2(F.col("_text").cast("binary"), 256)),
        }
    )
    laid = sliced(keyed, slice_bytes).repartitionByRange(*PLACE)
    runs = neighbours_compared(laid, PLACE, [preferred("_id", keep)], "_id")
    # The same sort serves this window, as equal texts of a place are one run.
    of_run = Window.partitionBy(*PLACE, "_text")
    return runs.select(
        "_id",
        *RUN,
        "_unlike",
        F.col("_first._id").alias("_best"),
        F.count(F.lit(1)).over(of_run).alias("_n"),
        F.when(F.col("_unlike") & (F.col("_slice") > 0), F.col("_text")).alias("_head"),
    )


def join_heads(runs: DataFrame, keep: str) -> DataFrame:
    """Place and run of the sliced runs, with their group's best id, size, and whether its first row is theirs."""
    heads = runs.where(F.col("_head").isNotNull()).select(
        F.col("_prefix").alias("_p"),
        F.col("_sha").alias("_s"),
        F.col("_slice").alias("_l"),
        F.col("_run").alias("_o"),
        "_best",
        "_n",
        F.col("_head").alias("_text"),
    )
    laid = heads.repartitionByRange("_p", "_s")
    joined = neighbours_compared(laid, ["_p", "_s"], [preferred("_best", keep), F.col("_l")], "_best")
    of_text = Window.partitionBy("_p", "_s", "_text")
    return joined.select(
        "_p",
        "_s",
        "_l",
        "_o",
        F.col("_first._best").alias("_group_best"),
        F.sum("_n").over(of_text).alias("_group_n"),
        F.col("_unlike").alias("_group_first"),
    )


def duplicates(docs: DataFrame, keep: str = "largest", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    ``keep`` says which row of equal texts stays: the one with the ``largest`` or ``smallest`` id.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep}")
    rows = docs.select(F.col("doc_id").alias("_id"), normalised().alias("_text"))
    runs = stage(content_sort(rows, keep, slice_bytes), "runs")
    heads = stage(join_heads(runs, keep), "heads")
    same = (
        (F.col("_prefix") == F.col("_p"))
        & (F.col("_sha") == F.col("_s"))
        & (F.col("_slice") == F.col("_l"))
        & (F.col("_run") == F.col("_o"))
    )
    whole = runs.drop("_head").join(heads, same, "left")
    is_sliced = F.col("_slice") > 0
    return whole.select(
        F.col("_id").alias("doc_id"),
        F.when(is_sliced, F.col("_group_best")).otherwise(F.col("_best")).alias("keep_id"),
        F.when(is_sliced, F.col("_group_n")).otherwise(F.col("_n")).alias("group_size"),
        (F.col("_unlike") & F.coalesce("_group_first", F.lit(True))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@query("op11_exact", ORACLE)
def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))
