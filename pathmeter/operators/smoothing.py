"""Smoothed scores and the best provider of each cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmeter.operators import failover, ordered
from pathmeter.params import CHUNK, FailoverParams


def trailing_score(scored: DataFrame, rows: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Mean score over the last ``rows`` measurements, penalties included."""
    return ordered.trailing_mean(scored, ["site_id", "provider"], "cycle", "score", rows, "smoothed", chunk)


def trailing_latency(latency: DataFrame, rows: int = 5, chunk: int = CHUNK) -> DataFrame:
    """Mean latency over the last ``rows`` pings; one infinity spreads to all of them."""
    return ordered.trailing_mean(latency, ["site_id", "provider"], "cycle", "latency", rows, "smoothed", chunk)


def best_provider(
    measurements: DataFrame,
    providers: list[str],
    params: FailoverParams = FailoverParams(),
    chunk: int = CHUNK,
) -> DataFrame:
    """Lowest smoothed score per site and cycle; the first provider wins ties."""
    n = len(providers)
    cycles = failover.decision_columns(
        failover.smoothed_cycles(measurements, providers, params, chunk), n, params
    )
    averages = F.array(*[F.col(f"avg_{i}") for i in range(n)])
    return cycles.select(
        "site_id",
        "cycle",
        failover.provider_name("best", providers).alias("best_provider"),
        F.get(averages, F.col("best")).alias("best_score"),
    )


def first_lowest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Provider with the lowest ``value`` per group; ties go to the lower order."""
    return df.groupBy(*keys).agg(
        F.min_by("provider", F.struct(value, "provider_ord")).alias("best_provider")
    )


def candidate_streak(
    best: DataFrame, primary: str, chunk: int = CHUNK
) -> DataFrame:
    """Consecutive cycles with the same better provider while ``primary`` stays fixed."""
    runs = ordered.run_length(best, ["site_id"], "cycle", "best_provider", "_run", chunk)
    return runs.withColumn(
        "streak", F.when(F.col("best_provider") == primary, F.lit(0).cast("bigint")).otherwise(F.col("_run"))
    ).drop("_run")
