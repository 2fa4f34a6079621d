"""Cycle documents, the telemetry store and the dashboard panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmeter import params as P
from pathmeter import session
from pathmeter.functions import scoring
from pathmeter.operators import dashboard, failover, smoothing
from pathmeter.plans import selection, views
from pathmeter.plans.registry import query
from pathmeter.plans.views import PROVIDERS, cut_sql
from pathmeter.sources import providers as provider_source
from pathmeter.sources import tables

ASOF = "2024-01-15 12:00:00"
RANGE = ("2024-01-10 06:00:00", "2024-01-12 18:00:00")



def _mean_sql(name: str) -> str:
    return f"avg(CAST(floor({name} * 100 + 0.5) AS BIGINT)) / 100"


REPORTED_SQL = f""",
reported AS (
  SELECT site_id, cycle, provider, ts, {cut_sql("smoothed")} AS score, {cut_sql("peer_avg")} AS peer_latency_ms,
         {cut_sql("peer_stddev")} AS peer_jitter_ms, {cut_sql("peer_loss")} AS peer_loss_pct,
         {cut_sql("dns_avg")} AS dns_latency_ms, {cut_sql("dns_stddev")} AS dns_jitter_ms,
         {cut_sql("dns_loss")} AS dns_loss_pct, 'IPv6' AS ip_version, peer_loss < 20 AND dns_loss < 20 AS is_healthy,
         peer_avg >= 12 OR dns_avg >= 15 AS has_latency_warning, peer_avg >= 25 OR dns_avg >= 30 AS has_latency_critical,
         peer_loss > 0 OR dns_loss > 0 AS has_packet_loss
  FROM smooth)"""
FIELDS = [f for f in (
    "score is_healthy peer_latency_ms peer_jitter_ms peer_loss_pct dns_latency_ms dns_jitter_ms dns_loss_pct "
    "ip_version has_latency_warning has_latency_critical has_packet_loss"
).split()]
WIDE_FIELDS_SQL = ", ".join(
    f"max(CASE WHEN provider = '{p}' THEN {f} END) AS {p.lower()}_{f}" for p in PROVIDERS for f in FIELDS
)
WIDE_SQL = f"{REPORTED_SQL},\nwide AS (SELECT site_id, cycle, max(ts) AS ts, {WIDE_FIELDS_SQL} FROM reported GROUP BY site_id, cycle)"
DOCS_SQL = (
    selection.CHANGES_SQL
    + WIDE_SQL
    + """,
docs AS (
  SELECT w.*, d.current_provider, d.provider_changed, c.previous_provider, d.new_provider, d.reason AS change_reason,
         d.current_provider = 'PROVIDER1' AS provider1_is_primary, d.current_provider = 'PROVIDER2' AS provider2_is_primary
  FROM wide w JOIN decision d ON d.site_id = w.site_id AND d.cycle = w.cycle
  LEFT JOIN changes c ON c.site_id = w.site_id AND c.cycle = w.cycle)"""
)


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.trailing_score(views.scored(spark, sf_dir)).withColumn("ip_version", F.lit("6"))


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.reported(smoothed(spark, sf_dir))


def per_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = dashboard.wide_figures(views.scored(spark, sf_dir), PROVIDERS)
    return dashboard.one_row_per_cycle(wide, PROVIDERS, [p[4] for p in P.DEFAULT_PROVIDERS])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle documents; the decisions are stored once for their two uses."""
    decisions = session.materialize(selection.decisions(spark, sf_dir), "decisions")
    changes = failover.previous_provider(decisions, PROVIDERS[0])
    return dashboard.cycle_documents(per_cycle(spark, sf_dir), decisions, changes, PROVIDERS)


@query("agg_11_cycle_rows", f"WITH {views.SMOOTH_SQL} {WIDE_SQL} SELECT * FROM wide")
def agg_11(spark, sf_dir):
    return per_cycle(spark, sf_dir)


@query("snk_01_daily_telemetry", f"WITH RECURSIVE {DOCS_SQL} SELECT *, CAST(ts AS DATE) AS dt FROM docs")
def snk_01(spark, sf_dir):
    """Append every cycle document to its day and read the store back."""
    path = session.scratch_dir(spark, "telemetry")
    tables.write_telemetry(documents(spark, sf_dir), path)
    return tables.read_telemetry(spark, path)


@query(
    "src_07_daily_partition_scan",
    f"""WITH {views.SCORED_SQL}
SELECT site_id, cycle, provider, ts, score FROM scored
WHERE ts >= TIMESTAMP '{RANGE[0]}' AND ts <= TIMESTAMP '{RANGE[1]}'""",
)
def src_07(spark, sf_dir):
    """Time-range read of a store partitioned by day."""
    path = session.scratch_dir(spark, "scores")
    tables.write_telemetry(views.scored(spark, sf_dir), path)
    return tables.read_telemetry(spark, path, *RANGE).select("site_id", "cycle", "provider", "ts", "score")


@query(
    "flt_01_change_events",
    f"""WITH RECURSIVE {selection.FOLD_SQL}
SELECT site_id, cycle, current_provider, new_provider, reason FROM decision WHERE provider_changed""",
)
def flt_01(spark, sf_dir):
    out = dashboard.change_events(selection.decisions(spark, sf_dir))
    return out.select("site_id", "cycle", "current_provider", "new_provider", "reason")


@query(
    "flt_02_relative_time_range",
    f"""WITH {views.SCORED_SQL}
SELECT site_id, cycle, provider, ts, score FROM scored
WHERE ts >= TIMESTAMP '{ASOF}' - INTERVAL 15 MINUTE AND ts <= TIMESTAMP '{ASOF}'""",
)
def flt_02(spark, sf_dir):
    return dashboard.in_range(views.scored(spark, sf_dir), ASOF).select("site_id", "cycle", "provider", "ts", "score")


@query(
    "agg_13_date_histogram",
    f"""WITH {views.SMOOTH_SQL} {REPORTED_SQL}
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, provider, {_mean_sql("score")} AS score,
       {_mean_sql("peer_latency_ms")} AS peer_latency_ms FROM reported GROUP BY ALL""",
)
def agg_13(spark, sf_dir):
    """Means of the reported figures, summed as whole hundredths so that they repeat exactly."""
    values = {name: scoring.hundredths(name) for name in ("score", "peer_latency_ms")}
    means = dashboard.date_histogram(reported(spark, sf_dir), "1 hour", values, ["provider"])
    return means.select("bucket", "provider", *[(F.col(name) / 100).alias(name) for name in values])


@query(
    "agg_15_last_not_null",
    f"""WITH {views.PROBE_SQL},
b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, site_id, provider, avg(CASE WHEN NOT failed THEN peer_avg END) AS v
      FROM probe GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id, provider ORDER BY bucket DESC) AS rn FROM b WHERE v IS NOT NULL)
SELECT site_id, provider, {cut_sql("v", 4)} AS peer_latency_ms, bucket FROM r WHERE rn = 1""",
)
def agg_15(spark, sf_dir):
    """Last hourly mean latency that has a value, failed measurements giving none."""
    keys = ["site_id", "provider"]
    value = F.when(~F.col("failed"), F.col("peer_avg"))
    buckets = dashboard.date_histogram(views.probe(spark, sf_dir), "1 hour", {"peer_latency_ms": value}, keys)
    last = dashboard.last_not_null(buckets, "peer_latency_ms", keys)
    return last.select(*keys, scoring.cut("peer_latency_ms", 4).alias("peer_latency_ms"), "bucket")


@query(
    "srt_01_latest_changes",
    f"""WITH RECURSIVE {DOCS_SQL}
SELECT site_id, ts, cycle, current_provider, previous_provider, new_provider, change_reason
FROM docs WHERE provider_changed ORDER BY ts DESC, site_id LIMIT 20""",
)
def srt_01(spark, sf_dir):
    return dashboard.latest_changes(documents(spark, sf_dir)).select(
        "site_id", "ts", "cycle", "current_provider", "previous_provider", "new_provider", "change_reason"
    )


@query(
    "prj_22_change_table",
    f"""WITH RECURSIVE {DOCS_SQL}
SELECT ts AS "Time", change_reason AS "Causa", current_provider AS "Actual", cycle AS "Ciclo",
       new_provider AS "Próximo", previous_provider AS "Anterior" FROM docs WHERE provider_changed""",
)
def prj_22(spark, sf_dir):
    return dashboard.change_history(dashboard.change_events(documents(spark, sf_dir)))


@query(
    "set_01_series_union",
    f"""WITH {views.SMOOTH_SQL} {WIDE_SQL}
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, 'PROVIDER1 Peer' AS series,
       {_mean_sql("provider1_peer_latency_ms")} AS value FROM wide GROUP BY ALL
UNION ALL
SELECT time_bucket(INTERVAL 1 HOUR, ts), 'PROVIDER2 Peer', {_mean_sql("provider2_peer_latency_ms")}
FROM wide GROUP BY ALL""",
)
def set_01(spark, sf_dir):
    columns = {f"{p.lower()}_peer_latency_ms": f"{p} Peer" for p in PROVIDERS}
    buckets = dashboard.date_histogram(per_cycle(spark, sf_dir), "1 hour", {c: scoring.hundredths(c) for c in columns})
    out = dashboard.series_union(buckets, columns)
    return out.withColumn("value", F.col("value") / 100)


ACTIONS_SQL = f"""WITH RECURSIVE {selection.CHANGES_SQL}, {selection.CONFIGURED_SQL},
acts AS (
  SELECT c.site_id, c.cycle, p.provider, CAST(p.export_rule_id AS BIGINT) AS rule_id, 'as_path_prepend_count' AS field,
         CASE WHEN p.provider = c.new_provider THEN '0' ELSE '3' END AS value
  FROM changes c JOIN configured p ON p.site_id = c.site_id
  UNION ALL
  SELECT c.site_id, c.cycle, p.provider, CAST(p.pref_rule_id AS BIGINT), 'local_preference',
         CASE WHEN p.provider = c.new_provider THEN '200' ELSE '100' END
  FROM changes c JOIN configured p ON p.site_id = c.site_id)
SELECT *, true AS dry_run FROM acts"""


@query("snk_03_policy_updates", ACTIONS_SQL)
def snk_03(spark, sf_dir):
    """Write the rule updates of all changes to the action table."""
    path = session.scratch_dir(spark, "actions")
    switched = selection.decisions(spark, sf_dir).where("provider_changed")
    dimension = provider_source.default_dimension(views.sites(spark, sf_dir))
    actions = failover.policy_actions(switched, dimension, selection.rule_table(spark, sf_dir))
    tables.write_actions(actions, path, batch_id=0)
    return tables.read_actions(spark, path).drop("batch_id")


MERGED_SQL = ACTIONS_SQL.replace(
    "SELECT *, true AS dry_run FROM acts",
    """SELECT site_id, cycle, rule_id, field, found, CASE WHEN found THEN site_id * 100 + rule_id END AS routing_policy,
       CASE WHEN found THEN 10 END AS index, CASE WHEN found THEN 'permit' END AS action,
       CASE WHEN field = 'as_path_prepend_count' THEN CAST(value AS INTEGER) WHEN kept THEN 1 END AS as_path_prepend_count,
       CASE WHEN field = 'local_preference' THEN value WHEN kept THEN '150' END AS local_preference,
       CASE WHEN kept THEN concat('rule ', CAST(rule_id AS VARCHAR)) END AS note, CASE WHEN kept THEN 3 ELSE 1 END AS n_fields
FROM (SELECT *, site_id % 7 <> 6 AS found, site_id % 7 <> 6 AND site_id % 3 <> 0 AS kept FROM acts) x""",
)


def listed_rules(spark, sf_dir):
    """Rules as they stand: some have no fields yet, some are not listed."""
    kept = F.create_map(
        F.lit("as_path_prepend_count"), F.lit("1"), F.lit("local_preference"), F.lit("150"),
        F.lit("note"), F.concat(F.lit("rule "), F.col("rule_id").cast("string")),
    )
    return selection.rule_table(spark, sf_dir).where("site_id % 7 <> 6").select(
        "site_id",
        "rule_id",
        (F.col("site_id") * 100 + F.col("rule_id")).alias("routing_policy"),
        F.lit(10).alias("index"),
        F.lit("permit").alias("action"),
        F.when(F.col("site_id") % 3 != 0, kept).alias("custom_fields"),
    )


def merged_columns(merged):
    return merged.select(
        "site_id", "cycle", "rule_id", "field", "found", "routing_policy", "index", "action",
        "as_path_prepend_count", "local_preference",
        F.try_element_at("custom_fields", F.lit("note")).alias("note"),
        F.size("custom_fields").alias("n_fields"),
    )


@query("snk_03_merged_rules", MERGED_SQL)
def snk_03_merged(spark, sf_dir):
    """Rule rows after all changes' updates; some rules have no fields yet, some are not listed."""
    switched = selection.decisions(spark, sf_dir).where("provider_changed")
    dimension = provider_source.default_dimension(views.sites(spark, sf_dir))
    actions = failover.policy_actions(switched, dimension, selection.rule_table(spark, sf_dir))
    return merged_columns(failover.merged_rules(actions, listed_rules(spark, sf_dir)))
