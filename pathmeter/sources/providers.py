"""Provider dimension and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathmeter import params as P


def default_dimension(sites: DataFrame) -> DataFrame:
    """The default providers for every site; order matters for ties."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("provider"),
                F.lit(order).alias("provider_ord"),
                F.lit(destination).alias("destination"),
                F.lit(peer_ip).alias("peer_ip"),
                F.lit(version).alias("ip_version"),
            )
            for name, order, destination, peer_ip, version in P.DEFAULT_PROVIDERS
        ]
    )
    return sites.select("site_id", F.inline(entries))


def thresholds_or_default(
    sites: DataFrame, calibrated: DataFrame, default: P.Thresholds = P.Thresholds()
) -> DataFrame:
    """Calibrated thresholds of each site, or the defaults where there are none."""
    names = ["peer_warning", "peer_critical", "dns_warning", "dns_critical", "switch_margin"]
    return sites.join(calibrated.select("site_id", *names), "site_id", "left").select(
        "site_id", *[F.coalesce(n, F.lit(float(getattr(default, n)))).alias(n) for n in names]
    )


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """The stored providers of each site, which may differ from site to site.

    ``provider_ord`` decides ties and is numbered anew from 0 per site; equal
    numbers go by name. Rows without a site or provider are left out, and of
    several rows of a provider the one with the lowest number counts.
    """
    rows = spark.read.parquet(path).where("site_id IS NOT NULL AND provider IS NOT NULL")
    others = [c for c in rows.columns if c not in ("site_id", "provider", "provider_ord")]
    one = rows.groupBy("site_id", "provider").agg(F.min(F.struct("provider_ord", *others)).alias("_row"))
    # A site has a handful of providers, so its window is small.
    order = Window.partitionBy("site_id").orderBy(F.col("_row.provider_ord").asc_nulls_last(), "provider")
    return one.select(
        "site_id",
        "provider",
        (F.row_number().over(order) - 1).cast("int").alias("provider_ord"),
        *[F.col(f"_row.{c}").alias(c) for c in others],
    )
