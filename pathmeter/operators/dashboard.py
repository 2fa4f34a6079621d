"""Cycle documents and the dashboard's queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmeter import params as P
from pathmeter.functions import scoring
from pathmeter.functions.steps import penalty_score
from pathmeter.operators import failover
from pathmeter.params import CHUNK, Thresholds

# Source column of each stored figure.
_FIGURES = {
    "score": "smoothed",
    "peer_latency_ms": "peer_avg",
    "peer_jitter_ms": "peer_stddev",
    "peer_loss_pct": "peer_loss",
    "dns_latency_ms": "dns_avg",
    "dns_jitter_ms": "dns_stddev",
    "dns_loss_pct": "dns_loss",
}


def reported(smoothed: DataFrame, limits: Thresholds = Thresholds(), loss_limit: float = 20.0) -> DataFrame:
    """Figures and flags of each site, cycle and provider as they are reported.

    This long form is the stored truth; documents are one way to lay it out.
    """
    return smoothed.select(
        "site_id",
        "cycle",
        "provider",
        "ts",
        *[scoring.cut(source).alias(name) for name, source in _FIGURES.items()],
        scoring.ip_version_label("ip_version").alias("ip_version"),
        scoring.is_healthy(loss_limit).alias("is_healthy"),
        scoring.has_latency_warning(F.lit(limits.peer_warning), F.lit(limits.dns_warning)).alias("has_latency_warning"),
        scoring.has_latency_critical(F.lit(limits.peer_critical), F.lit(limits.dns_critical)).alias("has_latency_critical"),
        scoring.has_packet_loss().alias("has_packet_loss"),
    )


def wide_figures(scored: DataFrame, providers: list[str], rows: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Smoothed score and metrics of every provider side by side, in one shuffle."""
    values = {m: F.col(m) for m in ("score", *P.METRICS)}
    missing = {"score": penalty_score(), **P.PENALTY}
    needed = scored.select("site_id", "cycle", "provider", "ts", *values)
    latest = [F.max("ts").alias("ts")]
    wide = failover.wide_cycles(needed, providers, values, missing, "score", rows, chunk, latest)
    return wide.withColumnsRenamed({f"avg_{i}": f"smoothed_{i}" for i in range(len(providers))})


def one_row_per_cycle(
    wide: DataFrame,
    providers: list[str],
    versions: list[str],
    limits: Thresholds = Thresholds(),
    loss_limit: float = 20.0,
) -> DataFrame:
    """Reported figures per cycle, in columns prefixed by the lower-case name.

    Works on :func:`wide_figures` and on the output of the selection stream.
    """
    fields: dict[str, Column] = {}
    for i, (provider, version) in enumerate(zip(providers, versions)):
        fields.update(_figures(i, provider.lower(), version, limits, loss_limit))
    used = {f"{name}_{i}" for i in range(len(providers)) for name in ("smoothed", "score", *P.METRICS)}
    kept = [c for c in wide.columns if c not in used and c != "_chunk"]
    return wide.select(*kept, *[v.alias(name) for name, v in fields.items()])


def _figures(i: int, prefix: str, version: str, limits: Thresholds, loss_limit: float) -> dict[str, Column]:
    def at(name: str) -> Column:
        return F.col(f"{name}_{i}")

    worst_loss = F.greatest(at("peer_loss"), at("dns_loss"))
    out = {f"{prefix}_{name}": scoring.cut(at(source)) for name, source in _FIGURES.items()}
    out |= {
        f"{prefix}_ip_version": scoring.ip_version_label(F.lit(version)),
        f"{prefix}_is_healthy": worst_loss < loss_limit,
        f"{prefix}_has_latency_warning": (at("peer_avg") >= limits.peer_warning) | (at("dns_avg") >= limits.dns_warning),
        f"{prefix}_has_latency_critical": (at("peer_avg") >= limits.peer_critical)
        | (at("dns_avg") >= limits.dns_critical),
        f"{prefix}_has_packet_loss": worst_loss > 0.0,
    }
    return out


def cycle_documents(
    per_cycle: DataFrame, decisions: DataFrame, changes: DataFrame, providers: list[str]
) -> DataFrame:
    """One document per cycle with the state before a switch takes effect."""
    previous = changes.select("site_id", "cycle", "previous_provider")
    joined = (
        per_cycle.join(decisions, ["site_id", "cycle"])
        .join(previous, ["site_id", "cycle"], "left")
        .withColumnRenamed("reason", "change_reason")
    )
    return arrange_document(joined, providers)


def arrange_document(joined: DataFrame, providers: list[str]) -> DataFrame:
    """Columns of the cycle document in their order, with the primary marked."""
    for p in providers:
        joined = joined.withColumn(f"{p.lower()}_is_primary", F.col("current_provider") == p)
    return joined.select(
        "site_id",
        "ts",
        "cycle",
        "current_provider",
        "provider_changed",
        "previous_provider",
        "new_provider",
        "change_reason",
        *[f"{p.lower()}_{f}" for p in providers for f in P.DOCUMENT_FIELDS],
    )


def change_events(documents: DataFrame) -> DataFrame:
    return documents.where("provider_changed")


def in_range(df: DataFrame, asof: str, minutes: int = 15) -> DataFrame:
    """Rows of the last ``minutes`` up to ``asof``, a UTC instant.

    Bounds are constants, so the scan gets them as pushed filters.
    """
    end = F.lit(asof).cast("timestamp_ntz")
    start = end - F.make_interval(mins=F.lit(minutes))
    return df.where((F.col("ts") >= start) & (F.col("ts") <= end))


def date_histogram(
    df: DataFrame, width: str, values: dict[str, Column | str], keys: list[str] | None = None
) -> DataFrame:
    """Mean of each value per time bucket of ``width`` and key, over all rows."""
    means = [F.avg(c).alias(name) for name, c in values.items()]
    return (
        df.groupBy(F.window("ts", width).alias("_w"), *(keys or []))
        .agg(*means)
        .withColumn("bucket", F.col("_w.start"))
        .drop("_w")
    )


def last_not_null(buckets: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Value of the latest bucket that has one."""
    return (
        buckets.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.max_by(value, "bucket").alias(value), F.max("bucket").alias("bucket"))
    )


def series_union(buckets: DataFrame, series: dict[str, str]) -> DataFrame:
    """Several value columns as one long (bucket, series, value) table."""
    named = buckets.select("bucket", *[F.col(c).alias(label) for c, label in series.items()])
    return named.unpivot(["bucket"], list(series.values()), "series", "value")


def latest_changes(documents: DataFrame, n: int = 20) -> DataFrame:
    """The newest change documents; a top-n per task, then of those."""
    return change_events(documents).orderBy(F.desc("ts"), "site_id").limit(n)


def change_history(documents: DataFrame, headings: dict[str, str] | None = None) -> DataFrame:
    """The change table: without provider columns, under its own headings."""
    headings = headings or P.CHANGE_HEADINGS
    return documents.select(*[F.col(c).alias(title) for c, title in headings.items()])
