"""The streaming jobs run over the driver's event table until it is consumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathmeter import params as P
from pathmeter import schemas, session
from pathmeter.functions import scoring
from pathmeter.plans import panels, reports, selection, views
from pathmeter.plans.registry import ORACLE_SQL, query
from pathmeter.plans.views import PROVIDERS, cut_sql
from pathmeter.sources import providers as provider_source
from pathmeter.sources import reports as report_source
from pathmeter.sources import tables
from pathmeter.streaming import failover as live_failover
from pathmeter.streaming import jobs


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spark.readStream.schema(schemas.EVENTS)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )


def scored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = views.probe_columns(event_stream(spark, sf_dir))
    return scoring.with_score(scoring.impute_failed(views.raw_measurements(probes)))


def stored_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The providers of every site, stored before a stream starts so that no micro-batch derives them anew."""
    return session.materialize(provider_source.default_dimension(views.sites(spark, sf_dir)), "dimension")


def decided_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.use_rocksdb(spark)
    return live_failover.select_stream(scored_stream(spark, sf_dir), PROVIDERS)


@query(
    "str_01_probe_ingestion",
    f"""WITH {views.SCORED_SQL}
SELECT site_id, provider, cycle, ts, failed, peer_avg, peer_loss, dns_avg, dns_loss, peer_stddev, dns_stddev, score
FROM scored""",
)
def str_01(spark, sf_dir):
    """Captured report files arrive, are measured and appended."""
    base = session.scratch_dir(spark, "ingest")
    reports.captured(spark, sf_dir).write.option("timestampNTZFormat", report_source.TS_FORMAT).json(f"{base}/in")
    dimension = stored_dimension(spark, sf_dir)
    measured = jobs.measure_stream(report_source.stream_reports(spark, f"{base}/in"), dimension).select(
        "site_id", "provider", "cycle", "ts", "failed", *P.METRICS, "score"
    )
    jobs.append_table(measured, f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(
    "str_02_failover_stream",
    f"""WITH RECURSIVE {selection.CHANGES_SQL}
SELECT d.site_id, d.cycle, d.current_provider, d.reason, d.counter, d.provider_changed, d.new_provider, c.previous_provider
FROM decision d LEFT JOIN changes c ON c.site_id = d.site_id AND c.cycle = d.cycle""",
)
def str_02_stream(spark, sf_dir):
    """The same decisions as the batch fold, from keyed state."""
    base = session.scratch_dir(spark, "decisions")
    jobs.append_table(decided_stream(spark, sf_dir), f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "site_id", "cycle", "current_provider", "reason", "counter", "provider_changed", "new_provider", "previous_provider"
    )


#: The first cycle that the stream of late rows takes; rows of earlier ones come too late.
FIRST_TAKEN = 5


@query(
    "str_05_late_rows",
    f"""WITH {views.SCORED_SQL}
SELECT site_id, cycle, provider, ts FROM scored WHERE cycle < {FIRST_TAKEN}""",
)
def str_05_late(spark, sf_dir):
    """Measurements of cycles already taken, stored apart from the decisions of the same stream."""
    session.use_rocksdb(spark)
    base = session.scratch_dir(spark, "late")
    decided = live_failover.select_stream(scored_stream(spark, sf_dir), PROVIDERS, first_cycle=FIRST_TAKEN, late_rows=True)
    handle = jobs.split_batches(f"{base}/out", f"{base}/late", f"{base}/counts")
    jobs.start(decided, f"{base}/checkpoint", handle, once=True).awaitTermination()
    return tables.read_actions(spark, f"{base}/late").select("site_id", "cycle", "provider", "ts")


@query("str_03_margin_stream", ORACLE_SQL["str_03_margin_fold"])
def str_03_stream(spark, sf_dir):
    """The decisions of the margin mode from keyed state."""
    session.use_rocksdb(spark)
    base = session.scratch_dir(spark, "margin")
    decided = live_failover.select_stream(scored_stream(spark, sf_dir), PROVIDERS, selection.MARGIN_ONLY)
    jobs.append_table(decided, f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("site_id", "cycle", "current_provider", "reason", "new_provider")


@query("str_05_cycle_documents", f"WITH RECURSIVE {panels.DOCS_SQL} SELECT *, CAST(ts AS DATE) AS dt FROM docs")
def str_05(spark, sf_dir):
    """One document per completed cycle, appended to its day."""
    base = session.scratch_dir(spark, "documents")
    docs = jobs.stream_documents(decided_stream(spark, sf_dir), PROVIDERS, [p[4] for p in P.DEFAULT_PROVIDERS])
    jobs.append_telemetry(docs, f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    return tables.read_telemetry(spark, f"{base}/out")


@query("str_07_policy_actions_stream", panels.ACTIONS_SQL)
def str_07_stream(spark, sf_dir):
    """Rule updates written as the changes happen."""
    base = session.scratch_dir(spark, "live-actions")
    dimension = stored_dimension(spark, sf_dir)
    rules = session.materialize(selection.rule_table(spark, sf_dir), "rules")
    handle = jobs.action_batches(dimension, rules, f"{base}/out")
    jobs.start(decided_stream(spark, sf_dir), f"{base}/checkpoint", handle, once=True).awaitTermination()
    return tables.read_actions(spark, f"{base}/out").drop("batch_id")


@query("str_07_merged_rules_stream", panels.MERGED_SQL)
def str_07_merged_stream(spark, sf_dir):
    """Whole rules after each update, written as the changes happen."""
    base = session.scratch_dir(spark, "live-rules")
    dimension = stored_dimension(spark, sf_dir)
    rules = session.materialize(selection.rule_table(spark, sf_dir), "rules")
    listed = session.materialize(panels.listed_rules(spark, sf_dir), "listed-rules")
    handle = jobs.action_batches(dimension, rules, f"{base}/out", listed=listed, merged_path=f"{base}/merged")
    jobs.start(decided_stream(spark, sf_dir), f"{base}/checkpoint", handle, once=True).awaitTermination()
    return panels.merged_columns(tables.read_actions(spark, f"{base}/merged"))


@query(
    "str_08_live_histogram",
    f"""WITH {views.SCORED_SQL}
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, provider, {cut_sql("avg(peer_avg)", 4)} AS peer_latency_ms
FROM scored GROUP BY ALL""",
)
def str_08(spark, sf_dir):
    """Hourly mean latency, refreshed with every micro-batch."""
    base = session.scratch_dir(spark, "histogram")
    means = jobs.live_histogram(scored_stream(spark, sf_dir), "1 hour", {"peer_latency_ms": "peer_avg"}, ["provider"])
    handle = jobs.latest_batches(f"{base}/out")
    jobs.start(means, f"{base}/checkpoint", handle, once=True, mode="update").awaitTermination()
    stored = tables.read_actions(spark, f"{base}/out")
    current = jobs.current_buckets(stored, ["bucket", "provider"])
    return current.withColumn("peer_latency_ms", scoring.cut("peer_latency_ms", 4))
