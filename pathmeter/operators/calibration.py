"""Calibration: statistics per provider, thresholds and advice per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_rule_ids(dimension: DataFrame) -> DataFrame:
    """Rule ids 2i+1 and 2i+2 of the i-th provider (from 0) of each site.

    A site has at most a handful of providers, so the window stays small.
    """
    window = Window.partitionBy("site_id").orderBy("provider_ord")
    i = (F.row_number().over(window) - 1).cast("bigint")
    return dimension.withColumn("_i", i).select(
        "site_id",
        "provider",
        (2 * F.col("_i") + 1).alias("export_rule_id"),
        (2 * F.col("_i") + 2).alias("pref_rule_id"),
    )


def provider_metrics(measurements: DataFrame) -> DataFrame:
    """Fourteen statistics, the success count and rate per site and provider.

    Failed cycles count against the rate only. Whatever has no value is 0, as
    is the deviation of a single cycle.
    """

    def ok(name: str) -> Column:
        return F.when(~F.col("failed"), F.col(name))

    def filled(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    aggregates = []
    for side in ("peer", "dns"):
        latency, jitter, loss = ok(f"{side}_avg"), ok(f"{side}_stddev"), ok(f"{side}_loss")
        aggregates += [
            filled(F.avg(latency)).alias(f"{side}_latency_avg"),
            filled(F.min(latency)).alias(f"{side}_latency_min"),
            filled(F.max(latency)).alias(f"{side}_latency_max"),
            filled(F.stddev_samp(latency)).alias(f"{side}_latency_std"),
            filled(F.avg(jitter)).alias(f"{side}_jitter_avg"),
            filled(F.max(jitter)).alias(f"{side}_jitter_max"),
            filled(F.max(loss)).alias(f"{side}_loss_max"),
        ]
    return measurements.groupBy("site_id", "provider", "provider_ord").agg(
        *aggregates,
        F.count_if(~F.col("failed")).alias("measurement_count"),
        success_rate().alias("success_rate"),
    )


def success_rate() -> Column:
    n = F.count(F.lit(1))
    return F.when(n > 0, F.count_if(~F.col("failed")) / n * 100.0).otherwise(F.lit(0.0))


def site_baseline(metrics: DataFrame, exclude_failed: bool = False) -> DataFrame:
    """Baseline (largest average), spread and jitter over the providers of a site.

    A provider without any successful cycle takes part with zeros, which widens
    the spread; ``exclude_failed`` leaves it out.
    """
    if exclude_failed:
        metrics = metrics.where("measurement_count > 0")
    return metrics.groupBy("site_id").agg(
        F.max("peer_latency_avg").alias("peer_baseline"),
        F.max("dns_latency_avg").alias("dns_baseline"),
        (F.max("peer_latency_avg") - F.min("peer_latency_avg")).alias("peer_diff"),
        (F.max("dns_latency_avg") - F.min("dns_latency_avg")).alias("dns_diff"),
        _ordered_mean("peer_jitter_avg").alias("avg_peer_jitter"),
        _ordered_mean("dns_jitter_avg").alias("avg_dns_jitter"),
        F.max("peer_jitter_max").alias("max_peer_jitter"),
        _sample_mean().alias("avg_latency"),
        F.bool_or((F.col("peer_loss_max") > 0) | (F.col("dns_loss_max") > 0)).alias("any_loss"),
    )


def _listed(name: str) -> Column:
    """The providers' values in provider order; at most a handful per site."""
    return F.transform(
        F.array_sort(F.collect_list(F.struct("provider_ord", F.col(name).alias("v")))), lambda x: x["v"]
    )


def _ordered_mean(name: str) -> Column:
    """Mean over the providers, summed in provider order so that it repeats exactly."""
    return _mean_of(_listed(name))


def _sample_mean() -> Column:
    """Mean of all peer averages followed by all destination averages."""
    return _mean_of(F.concat(_listed("peer_latency_avg"), _listed("dns_latency_avg")))


def _mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.size(values)


def thresholds(baseline: DataFrame) -> DataFrame:
    """Warning and critical limits and the switch margin; rounding is half to even."""
    margin = F.bround(F.col("peer_diff") + F.col("dns_diff") + F.col("avg_peer_jitter"), 0)
    return baseline.withColumns(
        {
            "peer_warning": F.bround(F.col("peer_baseline") * 2, 0),
            "peer_critical": F.bround(F.col("peer_baseline") * 4, 0),
            "dns_warning": F.bround(F.col("dns_baseline") * 2.5, 0),
            "dns_critical": F.bround(F.col("dns_baseline") * 5, 0),
            "switch_margin": F.greatest(F.lit(3.0), F.least(F.lit(10.0), margin)),
        }
    )


def probe_settings(baseline: DataFrame) -> DataFrame:
    """Packets per probe, spacing and the pause between cycles."""
    latency = F.col("avg_latency")
    slow = latency >= 50
    return baseline.withColumns(
        {
            "probe_count": F.when(slow, 3).otherwise(5),
            "probe_interval": F.when(slow, 1.0).otherwise(0.5),
            "cycle_interval": F.when((F.col("max_peer_jitter") > 10) | (latency > 50), 60).otherwise(30),
        }
    )


def network_class(baseline: DataFrame) -> DataFrame:
    latency = (F.col("peer_baseline") + F.col("dns_baseline")) / 2
    jitter = F.col("avg_peer_jitter")
    return baseline.withColumn("class_latency", latency).withColumn(
        "network_class",
        F.when((latency < 10) & (jitter < 2), "excellent")
        .when((latency < 30) & (jitter < 5), "good")
        .when((latency < 100) & (jitter < 15), "acceptable")
        .otherwise("problematic"),
    )


def recommendations(baseline: DataFrame) -> DataFrame:
    """Advice codes per site, in a fixed order."""
    latency = (F.col("peer_baseline") + F.col("dns_baseline")) / 2
    spread = F.col("peer_diff") + F.col("dns_diff")
    codes = F.array(
        F.when(F.col("avg_peer_jitter") > 10, "HIGH_JITTER"),
        F.when(latency > 50, "HIGH_LATENCY"),
        F.when(spread < 3, "SIMILAR_PROVIDERS"),
        F.when(spread > 10, "LARGE_DIFFERENCE"),
        F.when(F.col("any_loss"), "PACKET_LOSS").otherwise("NO_PACKET_LOSS"),
    )
    return baseline.withColumn("recommendations", F.filter(codes, lambda c: c.isNotNull()))


def compare_providers(metrics: DataFrame) -> DataFrame:
    """Each pair of providers of a site, a handful per site, with their distance."""
    cut = metrics.select("site_id", "provider", "provider_ord", "peer_latency_avg", "dns_latency_avg")
    a, b = cut.alias("a"), cut.alias("b")
    peer = F.abs(F.col("a.peer_latency_avg") - F.col("b.peer_latency_avg"))
    dns = F.abs(F.col("a.dns_latency_avg") - F.col("b.dns_latency_avg"))
    return a.join(
        b,
        (F.col("a.site_id") == F.col("b.site_id")) & (F.col("a.provider_ord") < F.col("b.provider_ord")),
    ).select(
        F.col("a.site_id").alias("site_id"),
        F.col("a.provider").alias("provider_a"),
        F.col("b.provider").alias("provider_b"),
        peer.alias("peer_diff"),
        dns.alias("dns_diff"),
        F.when((peer < 2) & (dns < 3), "similar")
        .when((peer < 5) & (dns < 10), "moderate")
        .otherwise("significant")
        .alias("comparison"),
    )


def fastest_provider(metrics: DataFrame) -> DataFrame:
    """Provider with the lowest average peer latency; the first one on ties."""
    order = F.struct("peer_latency_avg", "provider_ord")
    return metrics.groupBy("site_id").agg(
        F.min_by("provider", order).alias("best_provider"), F.min("peer_latency_avg").alias("best_latency")
    )


def behind_fastest(metrics: DataFrame) -> DataFrame:
    """How much slower every other provider of the site is."""
    return (
        metrics.join(fastest_provider(metrics), "site_id")
        .where(F.col("provider") != F.col("best_provider"))
        .select(
            "site_id",
            "provider",
            "best_provider",
            (F.col("peer_latency_avg") - F.col("best_latency")).alias("slower_by"),
        )
    )


def calibrated_config(metrics: DataFrame) -> DataFrame:
    """One row per site with all calibrated settings, as stored for the live engine."""
    return network_class(probe_settings(thresholds(site_baseline(metrics))))
