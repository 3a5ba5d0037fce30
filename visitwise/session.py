"""Session settings for laptops, tests and clusters."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

SHUFFLE_PARTITION_BYTES = 256 * 1024 * 1024


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Enough reducers for ~256 MB each, and never fewer than there are cores."""
    return max(cores, math.ceil(input_bytes / SHUFFLE_PARTITION_BYTES))


def settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job that shuffles about ``input_bytes``.

    AQE starts from the planned partition number and merges small ones, so a
    generous number costs little. Static broadcasts stay at Spark's own 10 MB limit.
    """
    parts = shuffle_partitions(input_bytes, cores)
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }


def local_session(name: str, cores: int = 8, memory: str = "12g") -> SparkSession:
    """One-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.parquet.compression.codec", "snappy")
        # Call-site capture for each Column operation costs more than planning small queries.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in settings(0, cores).items():
        if key != "spark.sql.parquet.compression.codec":
            builder = builder.config(key, value)
    return builder.getOrCreate()
