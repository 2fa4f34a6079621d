"""Scores, health flags and labels of the measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathmeter.functions import bands, scoring
from pathmeter.params import Thresholds
from pathmeter.plans import views
from pathmeter.plans.registry import query
from pathmeter.plans.views import cut_sql
from pathmeter.sources import providers as provider_source

KEYS = ["site_id", "cycle", "provider"]
DEFAULT = Thresholds()


@query(
    "src_03_provider_dimension",
    f"""WITH {views.PROBE_SQL}
SELECT site_id, d.* FROM (SELECT DISTINCT site_id FROM probe) s
CROSS JOIN (VALUES ('PROVIDER1', 0, '2001:db8:8888::100', '2001:db8:ffaa::255', '6'),
                   ('PROVIDER2', 1, '2001:db8:4444::100', '2001:db8:ffac::255', '6'))
           d(provider, provider_ord, destination, peer_ip, ip_version)""",
)
def src_03(spark, sf_dir):
    return provider_source.default_dimension(views.sites(spark, sf_dir))


@query("prj_07_quality_score", f"WITH {views.SCORED_SQL} SELECT site_id, cycle, provider, score FROM scored")
def prj_07(spark, sf_dir):
    return views.scored(spark, sf_dir).select(*KEYS, "score")


@query(
    "prj_08_score_breakdown",
    f"""WITH {views.MEAS_SQL}
SELECT site_id, cycle, provider, peer_avg * 0.7::DOUBLE + dns_avg * 0.3::DOUBLE AS latency_part,
       (peer_loss + dns_loss) * 100.0::DOUBLE AS loss_part,
       (peer_stddev + dns_stddev) * 0.5::DOUBLE AS jitter_part FROM meas""",
)
def prj_08(spark, sf_dir):
    return views.measurements(spark, sf_dir).select(
        *KEYS,
        scoring.latency_part().alias("latency_part"),
        scoring.loss_part().alias("loss_part"),
        scoring.jitter_part().alias("jitter_part"),
    )


def _flag(name: str, column: str, make, sql: str) -> None:
    @query(name, f"WITH {views.MEAS_SQL} SELECT site_id, cycle, provider, {sql} AS {column} FROM meas")
    def run(spark, sf_dir):
        return views.measurements(spark, sf_dir).select(*KEYS, make().alias(column))


_flag("prj_09_healthy", "is_healthy", scoring.is_healthy, "peer_loss < 20 AND dns_loss < 20")
_flag(
    "prj_10_strictly_healthy",
    "is_healthy",
    lambda: scoring.is_strictly_healthy(F.lit(DEFAULT.peer_critical), F.lit(DEFAULT.dns_critical)),
    "peer_loss = 0 AND dns_loss = 0 AND peer_avg < 25 AND dns_avg < 30",
)
_flag(
    "prj_11_latency_warning",
    "has_latency_warning",
    lambda: scoring.has_latency_warning(F.lit(DEFAULT.peer_warning), F.lit(DEFAULT.dns_warning)),
    "peer_avg >= 12 OR dns_avg >= 15",
)
_flag(
    "prj_12_latency_critical",
    "has_latency_critical",
    lambda: scoring.has_latency_critical(F.lit(DEFAULT.peer_critical), F.lit(DEFAULT.dns_critical)),
    "peer_avg >= 25 OR dns_avg >= 30",
)
_flag("prj_13_packet_loss", "has_packet_loss", scoring.has_packet_loss, "peer_loss > 0 OR dns_loss > 0")


@query(
    "prj_14_failed_imputation",
    f"""WITH {views.MEAS_SQL}
SELECT site_id, cycle, provider, failed, peer_avg, peer_loss, dns_avg, dns_loss, peer_stddev, dns_stddev FROM meas""",
)
def prj_14(spark, sf_dir):
    return views.measurements(spark, sf_dir).drop("provider_ord", "ts")


@query(
    "prj_15_two_digits",
    f"""WITH {views.SCORED_SQL}
SELECT site_id, cycle, provider, {cut_sql('score')} AS score, {cut_sql('peer_avg')} AS peer_latency_ms,
       {cut_sql('peer_stddev')} AS peer_jitter_ms, {cut_sql('dns_avg')} AS dns_latency_ms,
       {cut_sql('dns_stddev')} AS dns_jitter_ms, {cut_sql('dns_loss')} AS dns_loss_pct FROM scored""",
)
def prj_15(spark, sf_dir):
    return views.scored(spark, sf_dir).select(
        *KEYS,
        scoring.cut("score").alias("score"),
        scoring.cut("peer_avg").alias("peer_latency_ms"),
        scoring.cut("peer_stddev").alias("peer_jitter_ms"),
        scoring.cut("dns_avg").alias("dns_latency_ms"),
        scoring.cut("dns_stddev").alias("dns_jitter_ms"),
        scoring.cut("dns_loss").alias("dns_loss_pct"),
    )


@query(
    "prj_16_ip_version_label",
    f"""WITH {views.PROBE_SQL}
SELECT site_id, cycle, provider,
       concat('IPv', CASE WHEN k % 20 = 4 THEN '?' WHEN k % 2 = 0 THEN '4' ELSE '6' END) AS ip_version FROM probe""",
)
def prj_16(spark, sf_dir):
    k = F.col("k")
    version = F.when(k % 20 == 4, F.lit(None)).when(k % 2 == 0, F.lit("4")).otherwise(F.lit("6"))
    return views.probe(spark, sf_dir).select(*KEYS, scoring.ip_version_label(version).alias("ip_version"))


@query(
    "prj_17_provider_names",
    """SELECT p_partkey AS id, replace(upper(p_name), ' ', '_') AS provider_key, lower(p_name) AS provider_prefix
FROM part""",
)
def prj_17(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        scoring.provider_key("p_name").alias("provider_key"),
        scoring.provider_prefix("p_name").alias("provider_prefix"),
    )


@query(
    "prj_21_threshold_bands",
    f"""WITH {views.SCORED_SQL}
SELECT site_id, cycle, provider,
       CASE WHEN score >= 50 THEN 'red' WHEN score >= 30 THEN 'amber' ELSE 'green' END AS score_band,
       CASE WHEN peer_avg >= 80 THEN 'red' WHEN peer_avg >= 40 THEN 'amber' ELSE 'green' END AS latency_band,
       CASE WHEN dns_avg >= 80 THEN 'red' ELSE 'green' END AS table_band FROM scored""",
)
def prj_21(spark, sf_dir):
    return views.scored(spark, sf_dir).select(
        *KEYS,
        bands.band("score", "score").alias("score_band"),
        bands.band("latency", "peer_avg").alias("latency_band"),
        bands.band("table", "dns_avg").alias("table_band"),
    )
