"""Score, health and label columns of one measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmeter import params as P


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def latency_part(peer_avg="peer_avg", dns_avg="dns_avg") -> Column:
    return _col(peer_avg) * P.PEER_WEIGHT + _col(dns_avg) * P.DNS_WEIGHT


def loss_part(peer_loss="peer_loss", dns_loss="dns_loss") -> Column:
    return (_col(peer_loss) + _col(dns_loss)) * P.LOSS_WEIGHT


def jitter_part(peer_stddev="peer_stddev", dns_stddev="dns_stddev") -> Column:
    return (_col(peer_stddev) + _col(dns_stddev)) * P.JITTER_WEIGHT


def quality_score() -> Column:
    """Weighted latency plus loss and jitter penalties; lower is better."""
    return latency_part() + loss_part() + jitter_part()


def is_healthy(limit: float = 20.0) -> Column:
    """Neither loss reaches the limit."""
    return (F.col("peer_loss") < limit) & (F.col("dns_loss") < limit)


def is_strictly_healthy(peer_critical="peer_critical", dns_critical="dns_critical") -> Column:
    """No loss at all and both latencies below critical."""
    return (
        (F.col("peer_loss") == 0.0)
        & (F.col("dns_loss") == 0.0)
        & (F.col("peer_avg") < _col(peer_critical))
        & (F.col("dns_avg") < _col(dns_critical))
    )


def has_latency_warning(peer="peer_warning", dns="dns_warning") -> Column:
    return (F.col("peer_avg") >= _col(peer)) | (F.col("dns_avg") >= _col(dns))


def has_latency_critical(peer="peer_critical", dns="dns_critical") -> Column:
    return (F.col("peer_avg") >= _col(peer)) | (F.col("dns_avg") >= _col(dns))


def has_packet_loss() -> Column:
    return (F.col("peer_loss") > 0.0) | (F.col("dns_loss") > 0.0)


def cut(value: Column | str, digits: int = 2) -> Column:
    """Round a non-negative double half up at ``digits`` decimals.

    ``floor`` keeps the arithmetic in doubles; Spark's own ``round`` goes
    through decimals and differs from other engines on stored binary values.
    Infinite values pass through.
    """
    x = _col(value)
    scale = float(10**digits)
    finite = F.floor(x * scale + 0.5).cast("double") / scale
    return F.when(F.abs(x) < 1e15, finite).otherwise(x)


def hundredths(value: Column | str) -> Column:
    """Whole hundredths of a figure with two decimals; their sums are exact."""
    return F.floor(_col(value) * 100.0 + 0.5).cast("bigint")


def impute_failed(df: DataFrame, failed: str = "failed") -> DataFrame:
    """Replace every metric of a failed measurement by the penalty row."""
    return df.withColumns(
        {m: F.when(F.col(failed), F.lit(v)).otherwise(F.col(m)) for m, v in P.PENALTY.items()}
    )


def with_score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", quality_score())


def ip_version_label(version: Column | str) -> Column:
    return F.concat(F.lit("IPv"), F.coalesce(_col(version), F.lit("?")))


def provider_key(name: Column | str) -> Column:
    """Upper case with blanks as underscores, as used in rule names."""
    return F.replace(F.upper(_col(name)), F.lit(" "), F.lit("_"))


def provider_prefix(name: Column | str) -> Column:
    return F.lower(_col(name))


def with_thresholds(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Attach the thresholds of the row's site.

    No broadcast hint: the table has one row per site, so Spark (statically or
    through AQE) broadcasts it only while it is under the configured size and
    otherwise shuffles, splitting sites that hold too many rows.
    """
    return df.join(thresholds, "site_id")

