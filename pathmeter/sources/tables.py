"""Stored tables: cycle telemetry by day, calibrated settings, policy actions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ------------------------------------------------------------ telemetry by day


def write_telemetry(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Append documents to their UTC day.

    The rebalance hint lets AQE merge small days and split a day that holds too
    many rows, so neither tiny files nor one giant writer task come out.
    """
    (
        documents.withColumn("dt", F.to_date("ts"))
        .hint("rebalance", "dt")
        .write.partitionBy("dt")
        .mode(mode)
        .parquet(path)
    )


def read_telemetry(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, schema=None
) -> DataFrame:
    """Documents with start <= ts <= end; only the days in between are listed."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    if start is not None:
        df = df.where(in_days(F.col("dt") >= F.to_date(F.lit(start)), F.col("ts") >= _instant(start)))
    if end is not None:
        df = df.where(in_days(F.col("dt") <= F.to_date(F.lit(end)), F.col("ts") <= _instant(end)))
    return df


def _instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def in_days(day: Column, instant: Column) -> Column:
    """Both bounds: the day prunes partitions, the instant is exact."""
    return day & instant


# --------------------------------------------------------- calibrated settings


def write_calibrated(config: DataFrame, path: str, run: str | None = None) -> None:
    """One row per site calibrated in this run; earlier runs stay.

    Each run owns a folder, named by its start in UTC unless ``run`` is given,
    so readers always see whole runs and other sites keep their settings.
    """
    run = run or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    config.write.mode("overwrite").parquet(f"{path}/run={run}")


def read_calibrated(spark: SparkSession, path: str) -> DataFrame:
    """The settings of the latest run of every site."""
    runs = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in runs.columns if c != "run"]
    latest = runs.groupBy("site_id").agg(F.max_by(F.struct(*columns), F.col("run").cast("string")).alias("latest"))
    return latest.select("latest.*")


# -------------------------------------------------------------- policy actions


def write_actions(actions: DataFrame, path: str, batch_id: int, dry_run: bool = True) -> None:
    """Write the actions of one micro-batch.

    Each batch owns a folder and replaces it, so a batch that is run again after
    a failure leaves no duplicates. With ``dry_run`` the table is all there is;
    otherwise an applier may pick up rows that are not marked.
    """
    (
        actions.withColumn("dry_run", F.lit(dry_run))
        .write.mode("overwrite")
        .parquet(f"{path}/batch_id={batch_id}")
    )


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)
