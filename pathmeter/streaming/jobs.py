"""Streaming jobs: ingestion, cycle documents, policy actions, live panels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathmeter.functions import probes, scoring, times
from pathmeter.operators import dashboard, failover
from pathmeter.params import Thresholds
from pathmeter.sources import tables

CYCLE_PAUSE = "30 seconds"


def measure_stream(reports: DataFrame, dimension: DataFrame) -> DataFrame:
    """Scored, imputed measurements from a stream of captured reports."""
    flat = probes.extract_metrics(probes.with_provider(reports, dimension))
    return scoring.with_score(scoring.impute_failed(flat))


def start(
    stream: DataFrame,
    checkpoint: str,
    handle: Callable[[DataFrame, int], None],
    once: bool = False,
    mode: str = "append",
) -> StreamingQuery:
    """Run ``handle`` on every micro-batch, each pause or once over what is there."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=CYCLE_PAUSE)).start()


def append_table(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to a Parquet table; the file sink's log makes it exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=CYCLE_PAUSE)).start()


def append_telemetry(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append cycle documents to their UTC day, exactly once."""
    writer = (
        stream.withColumn("dt", F.to_date("ts"))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("dt")
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=CYCLE_PAUSE)).start()


def stream_documents(
    decided: DataFrame, providers: list[str], versions: list[str], limits: Thresholds = Thresholds()
) -> DataFrame:
    """Cycle documents from the output of the selection stream, row by row."""
    per_cycle = dashboard.one_row_per_cycle(decided, providers, versions, limits)
    return dashboard.arrange_document(per_cycle.withColumnRenamed("reason", "change_reason"), providers)


def action_batches(
    dimension: DataFrame,
    rules: DataFrame,
    path: str,
    dry_run: bool = True,
    listed: DataFrame | None = None,
    merged_path: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler that writes the rule updates of all changes in it.

    With ``listed``, the rules as they stand (see ``failover.merged_rules``), the
    whole rule of each update goes to ``merged_path`` too. It is made from the
    actions as written, so the selection is not run again; both tables replace
    their folder of the batch, so a repeated batch leaves the same rows.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        switched = dashboard.change_events(batch)
        tables.write_actions(failover.policy_actions(switched, dimension, rules), path, batch_id, dry_run)
        if listed is not None:
            written = tables.read_actions(batch.sparkSession, path).where(F.col("batch_id") == batch_id)
            merged = failover.merged_rules(written.drop("batch_id", "dry_run"), listed)
            tables.write_actions(merged, merged_path, batch_id, dry_run)

    return handle


def split_batches(path: str, late_path: str, counts_path: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler that stores decisions and late rows apart, and how many of each a batch had.

    The batch is kept while it is written, so the selection runs once; each
    table replaces its folder of the batch.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            late = F.col("late_by").isNotNull()
            kept.where(~late).drop("late_provider", "late_by").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            rows = kept.where(late).select("site_id", "cycle", "ts", F.col("late_provider").alias("provider"), "late_by")
            rows.write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
            counts = kept.agg(F.count_if(~late).alias("decisions"), F.count_if(late).alias("late_rows"))
            counts.write.mode("overwrite").parquet(f"{counts_path}/batch_id={batch_id}")
        finally:
            kept.unpersist()

    return handle


def live_histogram(
    stream: DataFrame, width: str, values: dict, keys: list[str], delay: str = "2 minutes"
) -> DataFrame:
    """Time-bucket means on a stream; update mode refreshes the open buckets."""
    timed = stream.withColumn("ts", times.instant("ts")).withWatermark("ts", delay)
    means = dashboard.date_histogram(timed, width, values, keys)
    return means.withColumn("bucket", times.plain("bucket"))


def latest_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler that stores the refreshed buckets of each batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


def current_buckets(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The last refresh of every bucket."""
    values = [c for c in stored.columns if c not in {*keys, "batch_id"}]
    last = F.max_by(F.struct(*values), "batch_id").alias("_v")
    return stored.groupBy(*keys).agg(last).select(*keys, "_v.*")
