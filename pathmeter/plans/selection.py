"""Smoothing windows, provider selection and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmeter import session
from pathmeter.operators import calibration, failover, ordered, smoothing
from pathmeter.params import FailoverParams, Thresholds
from pathmeter.plans import views
from pathmeter.plans.registry import ORACLE_SQL, query
from pathmeter.plans.views import PROVIDERS
from pathmeter.sources import providers as provider_source

KEYS = ["site_id", "cycle", "provider"]
SUSTAINED = FailoverParams()
MARGIN_ONLY = FailoverParams(mode="margin", margin=3.0, thresholds=Thresholds(12.0, 25.0, 10.0, 30.0, 3.0))
WARNING_ONLY = FailoverParams(mode="warning", history=5, warning=20.0)

# ------------------------------------------------------------------- SQL twins

CYCLES_SQL = (
    views.SMOOTH_SQL
    + """,
per AS (
  SELECT site_id, cycle,
         max(CASE WHEN provider_ord = 0 THEN smoothed END) AS a0, max(CASE WHEN provider_ord = 1 THEN smoothed END) AS a1,
         max(CASE WHEN provider_ord = 0 THEN peer_loss END) AS l0, max(CASE WHEN provider_ord = 1 THEN peer_loss END) AS l1,
         bool_and(CASE WHEN provider_ord = 0 THEN peer_loss = 0 AND peer_avg < 25 AND dns_avg < 30 END) AS h0,
         bool_and(CASE WHEN provider_ord = 1 THEN peer_loss = 0 AND peer_avg < 25 AND dns_avg < 30 END) AS h1
  FROM smooth GROUP BY site_id, cycle)"""
)

FOLD_SQL = (
    CYCLES_SQL
    + """,
fold AS (
  SELECT DISTINCT site_id, CAST(-1 AS BIGINT) AS cycle, 0 AS pre, 0 AS cur, -1 AS cand, CAST(0 AS BIGINT) AS cnt,
         'SEED' AS reason FROM per
  UNION ALL
  SELECT site_id, cycle, cur AS pre,
         CASE WHEN reason IN ('CRITICAL_LOSS', 'SUSTAINED') THEN best ELSE cur END,
         CASE WHEN reason IN ('STABLE', 'CRITICAL_LOSS', 'SUSTAINED') THEN -1 ELSE best END,
         CASE WHEN reason IN ('STABLE', 'CRITICAL_LOSS', 'SUSTAINED') THEN 0 ELSE n END, reason
  FROM (
    SELECT *, CASE WHEN best = cur THEN 'STABLE'
                   WHEN NOT (CASE cur WHEN 0 THEN a0 - a1 ELSE a1 - a0 END > 5) THEN 'INSUFFICIENT_MARGIN'
                   WHEN CASE cur WHEN 0 THEN l0 ELSE l1 END >= 20 THEN 'CRITICAL_LOSS'
                   WHEN n >= 3 THEN 'SUSTAINED' ELSE 'EVALUATING' END AS reason
    FROM (
      SELECT p.*, f.cur, CASE WHEN a1 < a0 THEN 1 ELSE 0 END AS best,
             CASE WHEN f.cand = CASE WHEN a1 < a0 THEN 1 ELSE 0 END THEN f.cnt + 1 ELSE 1 END AS n
      FROM fold f JOIN per p ON p.site_id = f.site_id AND p.cycle = f.cycle + 1) x) y),
decision AS (
  SELECT site_id, cycle, concat('PROVIDER', CAST(pre + 1 AS VARCHAR)) AS current_provider, reason, cnt AS counter,
         cur <> pre AS provider_changed,
         CASE WHEN cur <> pre THEN concat('PROVIDER', CAST(cur + 1 AS VARCHAR)) END AS new_provider
  FROM fold WHERE cycle >= 0)"""
)

CHANGES_SQL = (
    FOLD_SQL
    + """,
changes AS (
  SELECT *, coalesce(lag(current_provider) OVER (PARTITION BY site_id ORDER BY cycle), 'PROVIDER1') AS previous_provider
  FROM decision WHERE provider_changed)"""
)


def _simple_fold_sql(other_wins: str, reason: str, base: str) -> str:
    """Fold that switches at once; ``other_wins`` and ``reason`` see c, o (averages), h (health)."""
    return (
        base
        + f""",
fold AS (
  SELECT DISTINCT site_id, CAST(-1 AS BIGINT) AS cycle, 0 AS pre, 0 AS cur, 'SEED' AS reason FROM per
  UNION ALL
  SELECT site_id, cycle, cur, CASE WHEN {other_wins} THEN 1 - cur ELSE cur END,
         CASE WHEN {other_wins} THEN {reason} ELSE 'STABLE' END
  FROM (SELECT p.site_id, p.cycle, f.cur, CASE f.cur WHEN 0 THEN a0 ELSE a1 END AS c,
               CASE f.cur WHEN 0 THEN a1 ELSE a0 END AS o, CASE f.cur WHEN 0 THEN h0 ELSE h1 END AS h
        FROM fold f JOIN per p ON p.site_id = f.site_id AND p.cycle = f.cycle + 1) x)
SELECT site_id, cycle, concat('PROVIDER', CAST(pre + 1 AS VARCHAR)) AS current_provider, reason,
       CASE WHEN cur <> pre THEN concat('PROVIDER', CAST(cur + 1 AS VARCHAR)) END AS new_provider
FROM fold WHERE cycle >= 0"""
    )


LATENCY_SQL = (
    views.PROBE_SQL
    + """,
latency AS (
  SELECT site_id, cycle, provider, provider_ord,
         CASE WHEN failed THEN 'Infinity'::DOUBLE ELSE peer_avg END AS latency FROM probe),
late AS (
  SELECT *,
         lag(latency, 1) OVER w AS x1, lag(latency, 2) OVER w AS x2, lag(latency, 3) OVER w AS x3,
         lag(latency, 4) OVER w AS x4, least(row_number() OVER w, 5) AS n
  FROM latency WINDOW w AS (PARTITION BY site_id, provider ORDER BY cycle)),
smooth AS (
  SELECT *, ((((coalesce(x4, 0) + coalesce(x3, 0)) + coalesce(x2, 0)) + coalesce(x1, 0)) + latency) / n AS smoothed
  FROM late)"""
)

# ----------------------------------------------------------------------- inputs


def ping_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peer latency with failed pings as infinity."""
    return views.probe(spark, sf_dir).select(
        *KEYS,
        "provider_ord",
        F.when(F.col("failed"), F.lit(float("inf"))).otherwise(F.col("peer_avg")).alias("latency"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failover.fold(views.measurements(spark, sf_dir), PROVIDERS, SUSTAINED)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events with their previous provider; the few events are stored first."""
    switched = session.materialize(decisions(spark, sf_dir).where("provider_changed"), "changes")
    return failover.previous_provider(switched, PROVIDERS[0])


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured rules per site; sites with site_id % 5 = 4 lack one preference rule."""
    ids = failover_rule_ids(spark, sf_dir)
    export = ids.select(
        "site_id", F.concat(F.lit("EXPORT-TO-"), F.col("provider")).alias("rule_name"), F.col("export_rule_id").alias("rule_id")
    )
    pref = ids.where("not (site_id % 5 = 4 and provider = 'PROVIDER2')").select(
        "site_id", F.concat(F.lit("SET-LOCAL-PREF-"), F.col("provider")).alias("rule_name"), F.col("pref_rule_id").alias("rule_id")
    )
    return export.unionByName(pref)


def failover_rule_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.assign_rule_ids(provider_source.default_dimension(views.sites(spark, sf_dir)))


# ---------------------------------------------------------------------- windows


@query(
    "win_01_trailing_score_mean",
    f"WITH {views.SMOOTH_SQL} SELECT site_id, cycle, provider, score, smoothed FROM smooth",
)
def win_01(spark, sf_dir):
    return smoothing.trailing_score(views.scored(spark, sf_dir).select(*KEYS, "score"))


@query("win_02_trailing_latency_mean", f"WITH {LATENCY_SQL} SELECT site_id, cycle, provider, latency, smoothed FROM smooth")
def win_02(spark, sf_dir):
    return smoothing.trailing_latency(ping_latency(spark, sf_dir).drop("provider_ord"))


@query(
    "win_03_previous_provider",
    f"""WITH RECURSIVE {CHANGES_SQL}
SELECT site_id, cycle, current_provider, new_provider, previous_provider, current_provider AS previous_corrected
FROM changes""",
)
def win_03(spark, sf_dir):
    return changes(spark, sf_dir).select(
        "site_id", "cycle", "current_provider", "new_provider", "previous_provider", "previous_corrected"
    )


@query(
    "win_04_cycle_number",
    f"""WITH {views.PROBE_SQL}
SELECT site_id, ts, row_number() OVER (PARTITION BY site_id ORDER BY ts, event_id) AS cycle_number
FROM (SELECT site_id, cycle, min(ts) AS ts, min(event_id) AS event_id FROM probe GROUP BY site_id, cycle) starts""",
)
def win_04(spark, sf_dir):
    """Number the cycles of a site from their start times, the earliest row of any provider."""
    starts = views.probe(spark, sf_dir).groupBy("site_id", "cycle").agg(F.min("ts").alias("ts"), F.min("event_id").alias("event_id"))
    starts = starts.select("site_id", "ts", "event_id")
    return ordered.number_rows(starts, ["site_id"], ["ts", "event_id"], "cycle_number").drop("event_id")


@query(
    "win_06_rule_ids",
    f"""WITH {views.PROBE_SQL}
SELECT site_id, provider, CAST(2 * i + 1 AS BIGINT) AS export_rule_id, CAST(2 * i + 2 AS BIGINT) AS pref_rule_id
FROM (SELECT site_id, provider, row_number() OVER (PARTITION BY site_id ORDER BY provider_ord) - 1 AS i
      FROM (SELECT DISTINCT site_id, provider, provider_ord FROM probe) p) q""",
)
def win_06(spark, sf_dir):
    return failover_rule_ids(spark, sf_dir)


@query(
    "win_07_candidate_streak",
    f"""WITH {CYCLES_SQL},
b AS (SELECT site_id, cycle, CASE WHEN a1 < a0 THEN 'PROVIDER2' ELSE 'PROVIDER1' END AS best_provider FROM per),
i AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY cycle)
              - row_number() OVER (PARTITION BY site_id, best_provider ORDER BY cycle) AS island FROM b)
SELECT site_id, cycle, best_provider,
       CASE WHEN best_provider = 'PROVIDER1' THEN 0
            ELSE row_number() OVER (PARTITION BY site_id, best_provider, island ORDER BY cycle) END AS streak
FROM i""",
)
def win_07(spark, sf_dir):
    best = smoothing.best_provider(views.measurements(spark, sf_dir), PROVIDERS).drop("best_score")
    return smoothing.candidate_streak(best, PROVIDERS[0])


@query(
    "agg_12_best_provider",
    f"""WITH {views.SMOOTH_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id, cycle ORDER BY smoothed, provider_ord) AS rn FROM smooth)
SELECT site_id, cycle, provider AS best_provider, smoothed AS best_score FROM ranked WHERE rn = 1""",
)
def agg_12(spark, sf_dir):
    return smoothing.best_provider(views.measurements(spark, sf_dir), PROVIDERS)


@query(
    "srt_03_provider_order_ties",
    f"""WITH {views.MEAS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id, cycle ORDER BY dns_loss, provider_ord) AS rn FROM meas)
SELECT site_id, cycle, provider AS best_provider FROM ranked WHERE rn = 1""",
)
def srt_03(spark, sf_dir):
    """Lowest loss, mostly a tie at zero, decided by provider order."""
    return smoothing.first_lowest(views.measurements(spark, sf_dir), ["site_id", "cycle"], "dns_loss")


# ------------------------------------------------------------------------ folds


@query(
    "str_02_failover_fold",
    f"""WITH RECURSIVE {FOLD_SQL}
SELECT site_id, cycle, current_provider, reason, counter, provider_changed, new_provider FROM decision""",
)
def str_02(spark, sf_dir):
    return decisions(spark, sf_dir).drop("candidate")


@query(
    "str_03_margin_fold",
    "WITH RECURSIVE "
    + _simple_fold_sql("o < c - 3", "CASE WHEN h THEN 'MARGIN' ELSE 'UNHEALTHY' END", CYCLES_SQL),
)
def str_03(spark, sf_dir):
    out = failover.fold(views.measurements(spark, sf_dir), PROVIDERS, MARGIN_ONLY)
    return out.select("site_id", "cycle", "current_provider", "reason", "new_provider")


@query(
    "str_04_warning_fold",
    "WITH RECURSIVE "
    + _simple_fold_sql(
        "o < c AND c > 20",
        "'WARNING'",
        LATENCY_SQL
        + """,
per AS (
  SELECT site_id, cycle, max(CASE WHEN provider_ord = 0 THEN smoothed END) AS a0,
         max(CASE WHEN provider_ord = 1 THEN smoothed END) AS a1, true AS h0, true AS h1
  FROM smooth GROUP BY site_id, cycle)""",
    ),
)
def str_04(spark, sf_dir):
    pings = ping_latency(spark, sf_dir).select(
        *KEYS,
        F.col("latency").alias("peer_avg"),
        F.col("latency").alias("dns_avg"),
        *[F.lit(0.0).alias(m) for m in ("peer_loss", "dns_loss", "peer_stddev", "dns_stddev")],
    )
    out = failover.fold(pings, PROVIDERS, WARNING_ONLY)
    return out.select("site_id", "cycle", "current_provider", "reason", "new_provider")


@query(
    "str_06_change_events",
    f"""WITH RECURSIVE {CHANGES_SQL}
SELECT site_id, cycle, current_provider, previous_provider, new_provider, reason FROM changes""",
)
def str_06(spark, sf_dir):
    return changes(spark, sf_dir).select(
        "site_id", "cycle", "current_provider", "previous_provider", "new_provider", "reason"
    )


CONFIGURED_SQL = """
pairs AS (SELECT DISTINCT site_id, provider, provider_ord FROM probe),
configured AS (SELECT *, 2 * provider_ord + 1 AS export_rule_id, 2 * provider_ord + 2 AS pref_rule_id
               FROM pairs WHERE NOT (site_id % 5 = 4 AND provider = 'PROVIDER2'))"""


@query(
    "str_07_policy_actions",
    f"""WITH RECURSIVE {CHANGES_SQL}, {CONFIGURED_SQL}
SELECT c.site_id, c.cycle, p.provider, CAST(p.export_rule_id AS BIGINT) AS rule_id, 'as_path_prepend_count' AS field,
       CASE WHEN p.provider = c.new_provider THEN '0' ELSE '3' END AS value
FROM changes c JOIN configured p ON p.site_id = c.site_id
UNION ALL
SELECT c.site_id, c.cycle, p.provider, CAST(p.pref_rule_id AS BIGINT), 'local_preference',
       CASE WHEN p.provider = c.new_provider THEN '200' ELSE '100' END
FROM changes c JOIN configured p ON p.site_id = c.site_id""",
)
def str_07(spark, sf_dir):
    switched = decisions(spark, sf_dir).where("provider_changed")
    dimension = provider_source.default_dimension(views.sites(spark, sf_dir))
    return failover.policy_actions(switched, dimension, rule_table(spark, sf_dir))


@query(
    "joi_09_rule_lookup",
    f"""WITH {views.PROBE_SQL}, {CONFIGURED_SQL}
SELECT p.site_id, p.provider, c.site_id IS NOT NULL AS configured, CAST(c.export_rule_id AS BIGINT) AS export_rule_id,
       CAST(c.pref_rule_id AS BIGINT) AS pref_rule_id
FROM pairs p LEFT JOIN configured c ON c.site_id = p.site_id AND c.provider = p.provider""",
)
def joi_09(spark, sf_dir):
    """Providers with both rules, and those reported as not configured."""
    dimension = provider_source.default_dimension(views.sites(spark, sf_dir))
    rules = rule_table(spark, sf_dir)
    found = failover.configured_rules(dimension, rules).withColumn("configured", F.lit(True))
    missing = failover.unconfigured_providers(dimension, rules).withColumn("configured", F.lit(False))
    return found.unionByName(missing, allowMissingColumns=True)


# ---------------------------------------------------------------- cycles left out

# Single cycles and whole stretches are missing, as when a collector is down.
KEPT = "(cycle * 37 + site_id) % 11 > 3 and cycle % 60 < 41"
GAP_CHUNK = 16


def _with_gaps(sql: str) -> str:
    """The same SQL over the cycles kept."""
    return sql.replace("probe AS (", "whole AS (", 1).replace("FROM ev)", f"FROM ev),\nprobe AS (SELECT * FROM whole WHERE {KEPT})", 1)


def measured_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.measurements(spark, sf_dir).where(KEPT)


@query(
    "win_01_trailing_mean_over_gaps",
    f"WITH {_with_gaps(views.SMOOTH_SQL)} SELECT site_id, cycle, provider, score, smoothed FROM smooth",
)
def win_01_gaps(spark, sf_dir):
    scored = views.scored(spark, sf_dir).where(KEPT).select(*KEYS, "score")
    return smoothing.trailing_score(scored, chunk=GAP_CHUNK)


@query("win_07_candidate_streak_over_gaps", _with_gaps(ORACLE_SQL["win_07_candidate_streak"]))
def win_07_gaps(spark, sf_dir):
    best = smoothing.best_provider(measured_with_gaps(spark, sf_dir), PROVIDERS, chunk=GAP_CHUNK)
    return smoothing.candidate_streak(best.drop("best_score"), PROVIDERS[0], chunk=GAP_CHUNK)


# The recursion steps over the numbers of the cycles that occur.
NUMBERED = "(SELECT *, dense_rank() OVER (PARTITION BY site_id ORDER BY cycle) - 1 AS place FROM smooth)"


@query(
    "str_02_failover_fold_over_gaps",
    "WITH RECURSIVE "
    + _with_gaps(FOLD_SQL).replace(
        "FROM smooth GROUP BY site_id, cycle)", f"FROM (SELECT * REPLACE (place AS cycle) FROM {NUMBERED}) GROUP BY site_id, cycle)"
    )
    + f"""
SELECT d.site_id, o.cycle, current_provider, reason, counter, provider_changed, new_provider
FROM decision d JOIN (SELECT DISTINCT site_id, cycle, place FROM {NUMBERED}) o ON o.site_id = d.site_id AND o.place = d.cycle""",
)
def str_02_gaps(spark, sf_dir):
    return failover.fold(measured_with_gaps(spark, sf_dir), PROVIDERS, SUSTAINED, chunk=GAP_CHUNK).drop("candidate")


# ------------------------------------------------- providers that differ by site


def own_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored dimension: of four sites one has the usual providers, one the
    other order, one lists the first only, one a third that never reports."""
    names = {0: [1, 2], 1: [2, 1], 2: [1], 3: [1, 2, 3]}
    lists = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, ",".join(f"PROVIDER{i}" for i in v))])
    site = views.sites(spark, sf_dir).withColumn("_names", F.split(lists[F.expr("cast(site_id % 4 as int)")], ","))
    # Numbers with gaps, as a table kept by hand has them.
    rows = site.select("site_id", F.posexplode("_names").alias("at", "provider"))
    path = session.scratch_dir(spark, "own-providers")
    rows.select("site_id", "provider", (F.col("at") * 10 + 5).cast("int").alias("provider_ord")).write.parquet(path)
    return provider_source.read_dimension(spark, path)


# The third provider is as good as a failed one, so the usual fold holds there too.
OWN_FOLD_SQL = (
    FOLD_SQL.replace(
        "CAST(event_id % 2 AS INTEGER) AS provider_ord",
        "CAST(CASE WHEN (event_id // 2) % 4 = 1 THEN 1 - event_id % 2 ELSE event_id % 2 END AS INTEGER) AS provider_ord",
    )
    .replace("  FROM ev)", "  FROM ev WHERE NOT ((event_id // 2) % 4 = 2 AND event_id % 2 = 1))")
    .replace("CAST(pre + 1 AS", "CAST(CASE WHEN site_id % 4 = 1 THEN 2 - pre ELSE pre + 1 END AS")
    .replace("CAST(cur + 1 AS", "CAST(CASE WHEN site_id % 4 = 1 THEN 2 - cur ELSE cur + 1 END AS")
)


@query(
    "str_02_fold_by_site",
    f"""WITH RECURSIVE {OWN_FOLD_SQL}
SELECT site_id, cycle, current_provider, reason, counter, provider_changed, new_provider FROM decision""",
)
def str_02_by_site(spark, sf_dir):
    """Sites with one, two and three providers in one fold."""
    own = own_providers(spark, sf_dir)
    return failover.fold_by_site(views.measurements(spark, sf_dir), own, SUSTAINED).drop("candidate")


@query(
    "src_03_unlisted_providers",
    f"""WITH {views.PROBE_SQL}
SELECT site_id, provider, count(*) AS rows FROM probe WHERE site_id % 4 = 2 AND provider = 'PROVIDER2' GROUP BY ALL""",
)
def src_03_unlisted(spark, sf_dir):
    """Rows of providers that their site does not list."""
    return failover.unlisted_by_site(views.measurements(spark, sf_dir), own_providers(spark, sf_dir))
