"""Calibration statistics, thresholds, comparison and advice per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmeter import session
from pathmeter.functions import scoring
from pathmeter.operators import calibration, failover
from pathmeter.plans import selection, views
from pathmeter.plans.registry import query
from pathmeter.plans.views import cut_sql
from pathmeter.sources import providers as provider_source
from pathmeter.sources import tables

THRESHOLDS = ["peer_warning", "peer_critical", "dns_warning", "dns_critical", "switch_margin"]


def _side_sql(side: str) -> str:
    loss = "loss"
    return f"""
         coalesce(avg({side}_avg) FILTER (NOT failed), 0) AS {side}_latency_avg,
         coalesce(min({side}_avg) FILTER (NOT failed), 0) AS {side}_latency_min,
         coalesce(max({side}_avg) FILTER (NOT failed), 0) AS {side}_latency_max,
         coalesce(stddev_samp({side}_avg) FILTER (NOT failed), 0) AS {side}_latency_std,
         coalesce(avg({side}_stddev) FILTER (NOT failed), 0) AS {side}_jitter_avg,
         coalesce(max({side}_stddev) FILTER (NOT failed), 0) AS {side}_jitter_max,
         coalesce(max({loss}) FILTER (NOT failed), 0) AS {side}_loss_max,"""


METRICS_SQL = (
    views.PROBE_SQL
    + f""",
metrics AS (
  SELECT site_id, provider, provider_ord,{_side_sql("peer")}{_side_sql("dns")}
         count(*) FILTER (NOT failed) AS measurement_count,
         count(*) FILTER (NOT failed) / count(*) * 100.0::DOUBLE AS success_rate
  FROM probe GROUP BY site_id, provider, provider_ord)"""
)
BASELINE_SQL = (
    METRICS_SQL
    + """,
baseline AS (
  SELECT site_id, max(peer_latency_avg) AS peer_baseline, max(dns_latency_avg) AS dns_baseline,
         max(peer_latency_avg) - min(peer_latency_avg) AS peer_diff, max(dns_latency_avg) - min(dns_latency_avg) AS dns_diff,
         avg(peer_jitter_avg) AS avg_peer_jitter, avg(dns_jitter_avg) AS avg_dns_jitter,
         max(peer_jitter_max) AS max_peer_jitter,
         (sum(peer_latency_avg) + sum(dns_latency_avg)) / (2 * count(*)) AS avg_latency,
         bool_or(peer_loss_max > 0 OR dns_loss_max > 0) AS any_loss
  FROM metrics GROUP BY site_id)"""
)
CONFIG_SQL = (
    BASELINE_SQL
    + """,
config AS (
  SELECT *, round_even(peer_baseline * 2, 0)::DOUBLE AS peer_warning, round_even(peer_baseline * 4, 0)::DOUBLE AS peer_critical,
         round_even(dns_baseline * 2.5::DOUBLE, 0)::DOUBLE AS dns_warning, round_even(dns_baseline * 5, 0)::DOUBLE AS dns_critical,
         greatest(3.0::DOUBLE, least(10.0::DOUBLE, round_even(peer_diff + dns_diff + avg_peer_jitter, 0)::DOUBLE)) AS switch_margin,
         CASE WHEN avg_latency >= 50 THEN 3 ELSE 5 END AS probe_count,
         CASE WHEN avg_latency >= 50 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS probe_interval,
         CASE WHEN max_peer_jitter > 10 OR avg_latency > 50 THEN 60 ELSE 30 END AS cycle_interval,
         (peer_baseline + dns_baseline) / 2 AS class_latency,
         CASE WHEN (peer_baseline + dns_baseline) / 2 < 10 AND avg_peer_jitter < 2 THEN 'excellent'
              WHEN (peer_baseline + dns_baseline) / 2 < 30 AND avg_peer_jitter < 5 THEN 'good'
              WHEN (peer_baseline + dns_baseline) / 2 < 100 AND avg_peer_jitter < 15 THEN 'acceptable'
              ELSE 'problematic' END AS network_class
  FROM baseline)"""
)

STATISTICS = [
    f"{side}_{name}"
    for side in ("peer", "dns")
    for name in ("latency_avg", "latency_min", "latency_max", "latency_std", "jitter_avg", "jitter_max", "loss_max")
]


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.provider_metrics(views.raw_measurements(views.probe(spark, sf_dir)))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.site_baseline(metrics(spark, sf_dir))


def _cut(*names: str):
    """Averages depend on summation order in the last bits, so four digits are kept."""
    return [scoring.cut(n, 4).alias(n) for n in names]


def _cut_sql(*names: str) -> str:
    return ", ".join(f"{cut_sql(n, 4)} AS {n}" for n in names)


@query(
    "agg_01_calibration_metrics",
    f"WITH {METRICS_SQL} SELECT site_id, provider, {_cut_sql(*STATISTICS)}, measurement_count FROM metrics",
)
def agg_01(spark, sf_dir):
    return metrics(spark, sf_dir).select("site_id", "provider", *_cut(*STATISTICS), "measurement_count")


@query(
    "agg_02_success_rate",
    f"WITH {METRICS_SQL} SELECT site_id, provider, measurement_count, success_rate FROM metrics",
)
def agg_02(spark, sf_dir):
    return (
        views.probe(spark, sf_dir)
        .groupBy("site_id", "provider")
        .agg(
            F.count_if(~F.col("failed")).alias("measurement_count"),
            calibration.success_rate().alias("success_rate"),
        )
    )


BASE = ["peer_baseline", "dns_baseline", "peer_diff", "dns_diff", "avg_peer_jitter", "avg_dns_jitter"]


@query("agg_03_baseline_and_spread", f"WITH {BASELINE_SQL} SELECT site_id, {_cut_sql(*BASE)} FROM baseline")
def agg_03(spark, sf_dir):
    return baseline(spark, sf_dir).select("site_id", *_cut(*BASE))


@query(
    "agg_04_threshold_derivation",
    f"WITH {CONFIG_SQL} SELECT site_id, peer_warning, peer_critical, dns_warning, dns_critical FROM config",
)
def agg_04(spark, sf_dir):
    return calibration.thresholds(baseline(spark, sf_dir)).select("site_id", *THRESHOLDS[:4])


@query("agg_05_switch_margin", f"WITH {CONFIG_SQL} SELECT site_id, switch_margin FROM config")
def agg_05(spark, sf_dir):
    return calibration.thresholds(baseline(spark, sf_dir)).select("site_id", "switch_margin")


@query("agg_06_probe_settings", f"WITH {CONFIG_SQL} SELECT site_id, probe_count, probe_interval FROM config")
def agg_06(spark, sf_dir):
    return calibration.probe_settings(baseline(spark, sf_dir)).select("site_id", "probe_count", "probe_interval")


@query("agg_07_cycle_interval", f"WITH {CONFIG_SQL} SELECT site_id, cycle_interval FROM config")
def agg_07(spark, sf_dir):
    return calibration.probe_settings(baseline(spark, sf_dir)).select("site_id", "cycle_interval")


@query(
    "agg_08_network_class",
    f"WITH {CONFIG_SQL} SELECT site_id, {_cut_sql('class_latency')}, network_class FROM config",
)
def agg_08(spark, sf_dir):
    return calibration.network_class(baseline(spark, sf_dir)).select(
        "site_id", *_cut("class_latency"), "network_class"
    )


@query(
    "agg_09_recommendations",
    f"""WITH {CONFIG_SQL}
SELECT site_id, concat_ws(',', CASE WHEN avg_peer_jitter > 10 THEN 'HIGH_JITTER' END,
       CASE WHEN class_latency > 50 THEN 'HIGH_LATENCY' END,
       CASE WHEN peer_diff + dns_diff < 3 THEN 'SIMILAR_PROVIDERS' END,
       CASE WHEN peer_diff + dns_diff > 10 THEN 'LARGE_DIFFERENCE' END,
       CASE WHEN any_loss THEN 'PACKET_LOSS' ELSE 'NO_PACKET_LOSS' END) AS recommendations FROM config""",
)
def agg_09(spark, sf_dir):
    out = calibration.recommendations(baseline(spark, sf_dir))
    return out.select("site_id", F.concat_ws(",", "recommendations").alias("recommendations"))


@query("agg_10_any_loss", f"WITH {BASELINE_SQL} SELECT site_id, any_loss FROM baseline")
def agg_10(spark, sf_dir):
    return (
        views.raw_measurements(views.probe(spark, sf_dir))
        .where("not failed")
        .groupBy("site_id")
        .agg(F.bool_or(scoring.has_packet_loss()).alias("any_loss"))
    )


@query(
    "joi_07_provider_comparison",
    f"""WITH {METRICS_SQL},
pairs AS (
  SELECT a.site_id, a.provider AS provider_a, b.provider AS provider_b,
         abs(a.peer_latency_avg - b.peer_latency_avg) AS peer_diff, abs(a.dns_latency_avg - b.dns_latency_avg) AS dns_diff
  FROM metrics a JOIN metrics b ON a.site_id = b.site_id AND a.provider_ord < b.provider_ord)
SELECT site_id, provider_a, provider_b, {_cut_sql("peer_diff", "dns_diff")},
       CASE WHEN peer_diff < 2 AND dns_diff < 3 THEN 'similar'
            WHEN peer_diff < 5 AND dns_diff < 10 THEN 'moderate' ELSE 'significant' END AS comparison
FROM pairs""",
)
def joi_07(spark, sf_dir):
    return calibration.compare_providers(metrics(spark, sf_dir)).select(
        "site_id", "provider_a", "provider_b", *_cut("peer_diff", "dns_diff"), "comparison"
    )


FASTEST_SQL = (
    METRICS_SQL
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY peer_latency_avg, provider_ord) AS rn FROM metrics)"""
)


@query(
    "joi_08_behind_fastest",
    f"""WITH {FASTEST_SQL}
SELECT o.site_id, o.provider, b.provider AS best_provider,
       {cut_sql("(o.peer_latency_avg - b.peer_latency_avg)", 4)} AS slower_by
FROM ranked o JOIN ranked b ON b.site_id = o.site_id AND b.rn = 1 WHERE o.rn > 1""",
)
def joi_08(spark, sf_dir):
    out = calibration.behind_fastest(metrics(spark, sf_dir))
    return out.select("site_id", "provider", "best_provider", *_cut("slower_by"))


@query(
    "srt_04_fastest_provider",
    f"""WITH {FASTEST_SQL}
SELECT site_id, provider AS best_provider, {cut_sql("peer_latency_avg", 4)} AS best_latency FROM ranked WHERE rn = 1""",
)
def srt_04(spark, sf_dir):
    out = calibration.fastest_provider(metrics(spark, sf_dir))
    return out.select("site_id", "best_provider", *_cut("best_latency"))


@query(
    "set_02_concatenated_samples",
    f"""WITH {METRICS_SQL},
samples AS (SELECT site_id, peer_latency_avg AS v FROM metrics UNION ALL SELECT site_id, dns_latency_avg FROM metrics)
SELECT site_id, {cut_sql("avg(v)", 4)} AS avg_latency, count(*) AS n_samples FROM samples GROUP BY site_id""",
)
def set_02(spark, sf_dir):
    """Peer and destination averages as one sample, by unpivoting."""
    samples = metrics(spark, sf_dir).select("site_id", "peer_latency_avg", "dns_latency_avg")
    return (
        samples.unpivot(["site_id"], ["peer_latency_avg", "dns_latency_avg"], "source", "v")
        .groupBy("site_id")
        .agg(scoring.cut(F.avg("v"), 4).alias("avg_latency"), F.count("v").alias("n_samples"))
    )


CONFIG = [*BASE, *THRESHOLDS, "probe_count", "probe_interval", "cycle_interval", "network_class"]


@query(
    "snk_02_calibrated_config",
    f"""WITH {CONFIG_SQL}
SELECT site_id, {_cut_sql(*BASE)}, {", ".join(CONFIG[len(BASE):])} FROM config""",
)
def snk_02(spark, sf_dir):
    """Store the calibrated settings per site and read them back."""
    path = session.scratch_dir(spark, "calibrated")
    tables.write_calibrated(calibration.calibrated_config(metrics(spark, sf_dir)), path)
    stored = tables.read_calibrated(spark, path)
    return stored.select("site_id", *_cut(*BASE), *CONFIG[len(BASE) :])


def site_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated thresholds, with sites divisible by three left on the defaults."""
    calibrated = calibration.thresholds(baseline(spark, sf_dir)).where("site_id % 3 <> 0")
    return provider_source.thresholds_or_default(views.sites(spark, sf_dir), calibrated)


THRESHOLDS_SQL = (
    CONFIG_SQL
    + """,
thr AS (
  SELECT s.site_id, coalesce(c.peer_warning, 12) AS peer_warning, coalesce(c.peer_critical, 25) AS peer_critical,
         coalesce(c.dns_warning, 15) AS dns_warning, coalesce(c.dns_critical, 30) AS dns_critical,
         coalesce(c.switch_margin, 5) AS switch_margin
  FROM (SELECT DISTINCT site_id FROM probe) s LEFT JOIN config c ON c.site_id = s.site_id AND c.site_id % 3 <> 0)"""
)


@query("src_04_thresholds_with_fallback", f"WITH {THRESHOLDS_SQL} SELECT * FROM thr")
def src_04(spark, sf_dir):
    return site_thresholds(spark, sf_dir)


@query(
    "joi_11_scores_with_thresholds",
    f"""WITH {THRESHOLDS_SQL}, {views.SCORED_SQL.removeprefix(views.PROBE_SQL).lstrip(",")}
SELECT m.site_id, cycle, provider, score, switch_margin,
       peer_avg >= peer_warning OR dns_avg >= dns_warning AS has_latency_warning,
       peer_avg >= peer_critical OR dns_avg >= dns_critical AS has_latency_critical
FROM scored m JOIN thr ON thr.site_id = m.site_id""",
)
def joi_11(spark, sf_dir):
    rows = scoring.with_thresholds(views.scored(spark, sf_dir), site_thresholds(spark, sf_dir))
    return rows.select(
        "site_id",
        "cycle",
        "provider",
        "score",
        "switch_margin",
        scoring.has_latency_warning().alias("has_latency_warning"),
        scoring.has_latency_critical().alias("has_latency_critical"),
    )


def _calibrated_fold_sql() -> str:
    """The fold with each site's own margin."""
    own = selection.FOLD_SQL.replace("END > 5)", "END > switch_margin)")
    own = own.replace("SELECT p.*, f.cur,", "SELECT p.*, thr.switch_margin, f.cur,")
    own = own.replace(
        "p.site_id = f.site_id AND p.cycle = f.cycle + 1) x)",
        "p.site_id = f.site_id AND p.cycle = f.cycle + 1 JOIN thr ON thr.site_id = p.site_id) x)",
    )
    return own.replace(views.PROBE_SQL, THRESHOLDS_SQL, 1)


@query(
    "str_02_calibrated_fold",
    f"""WITH RECURSIVE {_calibrated_fold_sql()}
SELECT site_id, cycle, current_provider, reason, counter, new_provider FROM decision""",
)
def str_02_calibrated(spark, sf_dir):
    """The fold with calibrated margins; the few thresholds are stored before."""
    margins = session.materialize(site_thresholds(spark, sf_dir).select("site_id", "switch_margin"), "margins")
    rows = scoring.with_thresholds(views.measurements(spark, sf_dir), margins)
    out = failover.fold(rows, views.PROVIDERS)
    return out.select("site_id", "cycle", "current_provider", "reason", "counter", "new_provider")
