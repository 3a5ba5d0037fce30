"""Shared scratch folder for staged tables and round trips."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, the checkpoint folder of the running context; only a session of one
    process (``local`` or ``local[...]``) that has neither gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="visitwise-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs
    place = files.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stage(
    df: DataFrame,
    name: str = "staged",
    row_id: str | None = None,
    one_file_a_task: bool = False,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    ``row_id`` adds a column that is unique per row and the same on every scan. ``one_file_a_task`` holds
    even where the session limits the rows of a file. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("maxRecordsPerFile", 0) if one_file_a_task else df.write
    writer.options(**(options or {})).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    if row_id:
        back = back.withColumn(row_id, F.struct("_metadata.file_path", "_metadata.row_index"))
    return back
