"""Captured probe reports and ping output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathmeter import schemas
from pathmeter.functions import probes

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Captured reports from JSON lines; ``report`` is null for unreadable text."""
    return probes.parse_reports(spark.read.schema(schemas.PROBE_ENVELOPE).json(path))


def stream_reports(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream over newly arriving files."""
    lines = (
        spark.readStream.schema(schemas.PROBE_ENVELOPE)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )
    return probes.parse_reports(lines)


def read_ping(spark: SparkSession, path: str) -> DataFrame:
    """Captured ping runs (``returncode, output``) with their ``latency``."""
    df = spark.read.parquet(path)
    return df.withColumn("latency", probes.ping_average("output", "returncode"))
