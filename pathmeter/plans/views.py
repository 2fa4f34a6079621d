"""Fixture views over the driver tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmeter.functions import scoring

PROVIDERS = ["PROVIDER1", "PROVIDER2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probe_columns(events: DataFrame) -> DataFrame:
    """Two successive events make one cycle, one per provider; 16 sites."""
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        events.select("event_id", "event_type", "value", "ts", k.alias("k"))
        .select(
            F.expr("(event_id div 2) % 16").alias("site_id"),
            F.expr("(event_id div 2) div 16").alias("cycle"),
            F.expr("concat('PROVIDER', cast(event_id % 2 + 1 as string))").alias("provider"),
            F.expr("cast(event_id % 2 as int)").alias("provider_ord"),
            "ts",
            (F.col("k") >= 98).alias("failed"),
            (F.col("value") / 4).alias("peer_avg"),
            F.expr("value / 4 + k / 10.0D").alias("dns_avg"),
            F.expr("case when event_type = 'error' and k < 20 then 10.0D * (k % 4) else 0.0D end").alias("loss"),
            F.expr("k / 50.0D").alias("peer_stddev"),
            F.expr("k / 25.0D").alias("dns_stddev"),
            "event_id",
            "k",
        )
    )


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_columns(table(spark, sf_dir, "events"))


def raw_measurements(probes: DataFrame) -> DataFrame:
    return probes.select(
        "site_id",
        "cycle",
        "provider",
        "provider_ord",
        "ts",
        "failed",
        "peer_avg",
        F.col("loss").alias("peer_loss"),
        "dns_avg",
        F.col("loss").alias("dns_loss"),
        "peer_stddev",
        "dns_stddev",
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputed measurements of every site, cycle and provider."""
    return scoring.impute_failed(raw_measurements(probe(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_score(measurements(spark, sf_dir))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe(spark, sf_dir).select("site_id").distinct()


def supplier_count(spark: SparkSession, sf_dir: str) -> Column:
    return table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()


# ------------------------------------------------------------------- SQL twins

PROBE_SQL = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
probe AS (
  SELECT (event_id // 2) % 16 AS site_id, (event_id // 2) // 16 AS cycle,
         concat('PROVIDER', CAST(event_id % 2 + 1 AS VARCHAR)) AS provider,
         CAST(event_id % 2 AS INTEGER) AS provider_ord, ts, k >= 98 AS failed,
         value / 4 AS peer_avg, value / 4 + k / 10.0::DOUBLE AS dns_avg,
         CASE WHEN event_type = 'error' AND k < 20 THEN 10.0::DOUBLE * (k % 4) ELSE 0.0::DOUBLE END AS loss,
         k / 50.0::DOUBLE AS peer_stddev, k / 25.0::DOUBLE AS dns_stddev, event_id, k
  FROM ev)"""

MEAS_SQL = (
    PROBE_SQL
    + """,
meas AS (
  SELECT site_id, cycle, provider, provider_ord, ts, failed,
         CASE WHEN failed THEN 999.0::DOUBLE ELSE peer_avg END AS peer_avg,
         CASE WHEN failed THEN 100.0::DOUBLE ELSE loss END AS peer_loss,
         CASE WHEN failed THEN 999.0::DOUBLE ELSE dns_avg END AS dns_avg,
         CASE WHEN failed THEN 100.0::DOUBLE ELSE loss END AS dns_loss,
         CASE WHEN failed THEN 0.0::DOUBLE ELSE peer_stddev END AS peer_stddev,
         CASE WHEN failed THEN 0.0::DOUBLE ELSE dns_stddev END AS dns_stddev
  FROM probe)"""
)

SCORED_SQL = (
    MEAS_SQL
    + """,
scored AS (
  SELECT *, (peer_avg * 0.7::DOUBLE + dns_avg * 0.3::DOUBLE) + (peer_loss + dns_loss) * 100.0::DOUBLE
            + (peer_stddev + dns_stddev) * 0.5::DOUBLE AS score
  FROM meas)"""
)

SMOOTH_SQL = (
    SCORED_SQL
    + """,
smooth AS (
  SELECT *, avg(score) OVER (PARTITION BY site_id, provider ORDER BY cycle
                             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smoothed
  FROM scored)"""
)


def cut_sql(expr: str, digits: int = 2) -> str:
    scale = f"1e{digits}::DOUBLE"
    return f"floor({expr} * {scale} + 0.5::DOUBLE) / {scale}"
